"""What a run needs on the driver: bounded pools, cancellation, subprocesses, one writer at a time, logs, health checks.

Work on rows is Spark's; here are only the few things around it.
"""

from __future__ import annotations

import logging
import re
import shutil
import signal
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AdjudicaError

EXIT_INTERRUPTED = 130


class Cancelled(AdjudicaError):
    exit_code = EXIT_INTERRUPTED


class Cancellation:
    """A flag that ends a job group: cancel() stops its Spark jobs, check() raises in driver code."""

    def __init__(self, spark: SparkSession | None = None, group: str = "adjudica"):
        self.spark, self.group, self.reason = spark, group, None
        self._event = threading.Event()
        if spark is not None:
            spark.sparkContext.setJobGroup(group, "cancellable run", interruptOnCancel=True)

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def cancel(self, reason: str = "cancelled") -> None:
        if not self._event.is_set():
            self.reason = reason
            self._event.set()
            if self.spark is not None:
                self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        if self._event.is_set():
            raise Cancelled(self.reason or "cancelled")

    @contextmanager
    def on_interrupt(self) -> Iterator[None]:
        """The first interrupt cancels, a second one ends the process."""

        def handle(number, frame):
            if self.cancelled:
                raise SystemExit(EXIT_INTERRUPTED)
            self.cancel("interrupted")

        before = signal.signal(signal.SIGINT, handle)
        try:
            yield
        finally:
            signal.signal(signal.SIGINT, before)


class Pool:
    """Calls from the driver (queries, requests), so many at once at most."""

    def __init__(self, size: int, cancellation: Cancellation | None = None):
        if size < 1:
            raise ValueError("a pool needs one place at least")
        self.size, self.cancellation = size, cancellation

    def map(self, call: Callable, items: Iterable) -> list:
        """Results in the order of items; the first error is raised after the calls under way have ended."""
        return list(self.iterate(call, items))

    def iterate(self, call: Callable, items: Iterable) -> Iterator:
        def one(x):
            if self.cancellation is not None:
                self.cancellation.check()
            return call(x)

        with ThreadPoolExecutor(self.size) as pool:
            yield from pool.map(one, items)

    def run_all(self, calls: Iterable[Callable]) -> list:
        return self.map(lambda f: f(), calls)


class SingleWriter:
    """Changes to one store, one at a time and in order of arrival."""

    def __init__(self):
        self._lock = threading.Lock()

    def run(self, change: Callable, *args):
        with self._lock:
            return change(*args)


def run_command(args: list[str], timeout: float = 60, grace: float = 5, cwd: str | None = None, text: str | None = None) -> subprocess.CompletedProcess:
    """A command without a shell. After ``timeout`` seconds it is asked to end, after ``grace`` more it is killed."""
    process = subprocess.Popen(args, stdin=subprocess.PIPE if text is not None else subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, cwd=cwd)
    try:
        out, err = process.communicate(text, timeout)
    except subprocess.TimeoutExpired as e:
        process.terminate()
        try:
            process.communicate(timeout=grace)
        except subprocess.TimeoutExpired:
            process.kill()
            process.communicate()
        raise AdjudicaError(f"{args[0]} took over {timeout} seconds", {"args": args}) from e
    return subprocess.CompletedProcess(args, process.returncode, out, err)


@lru_cache(64)
def tool_version(name: str) -> str | None:
    """The first line of ``name --version``, asked once for each process; None if the tool isn't there."""
    if shutil.which(name) is None:
        return None
    try:
        got = run_command([name, "--version"], timeout=10)
    except AdjudicaError:
        return None
    return (got.stdout or got.stderr).strip().partition("\n")[0] or None


def tool_output(spark: SparkSession, commands: dict[str, list[str]], cwd: str, pool: Pool | None = None) -> DataFrame:
    """(tool, json) of analysis tools that are installed, three at once; whatever exit code they end with. A tool that isn't
    there, or takes too long, has no rows."""

    def one(item):
        name, args = item
        if shutil.which(args[0]) is None:
            return None
        try:
            return name, run_command(args, cwd=cwd).stdout
        except AdjudicaError:
            return None

    got = [r for r in (pool or Pool(3)).map(one, commands.items()) if r and r[1]]
    return spark.createDataFrame(got, "tool string, json string")


#: Keys whose values never reach a log.
SECRET_KEYS = ("api_key", "apikey", "authorization", "token", "password", "secret", "access_token", "credential")
_SECRET = re.compile(r"""(?i)(["']?(?:%s)["']?\s*[:=]\s*)(?:bearer\s+)?["']?[^\s"',}]+["']?""" % "|".join(SECRET_KEYS))


class Redacting(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = _SECRET.sub(r"\1[redacted]", record.getMessage()), ()
        return True


def logger(name: str = "adjudica", level: int = logging.INFO) -> logging.Logger:
    """A logger whose messages lose the values of secret keys."""
    log = logging.getLogger(name)
    if not any(isinstance(f, Redacting) for f in log.filters):
        log.addFilter(Redacting())
    log.setLevel(level)
    return log


def overall(checks: DataFrame) -> DataFrame:
    """One row, ``overall`` and ``exit_code``, of checks (name, status): fail over warn over pass; only a failure has code 2."""
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.agg(F.coalesce(rank, F.lit(0)).alias("r")).select(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("r") + 1).alias("overall"), F.when(F.col("r") == 2, 2).otherwise(0).alias("exit_code"))


def doctor(spark: SparkSession, tools: Iterable[str] = ("git", "ruff", "mypy"), root: str = ".") -> DataFrame:
    """(name, status, detail) of checks of the environment."""
    from .plans.shared import folder
    from .sources.repository import git_root

    rows = [("spark", "pass" if int(spark.version.split(".")[0]) >= 4 else "fail", spark.version)]
    at = git_root(root)
    rows.append(("repository", "pass" if at else "warn", at or "none"))
    for t in tools:
        v = tool_version(t)
        rows.append((f"tool {t}", "pass" if v else "warn", v or "not installed"))
    try:
        rows.append(("shared folder", "pass", folder(spark)))
    except ValueError as e:
        rows.append(("shared folder", "fail", str(e)))
    return spark.createDataFrame(rows, "name string, status string, detail string")

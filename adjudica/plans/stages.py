"""Reviewers and critic as stages over tables: what is to run, calls with retries, defaults, token sums.

A reviewer is any object with ``review(request) -> DataFrame`` of findings; the default one is a set of rules. Models live
outside the engine and are plugged in by the same protocol.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, ModelError
from ..functions import text
from ..operators import relevance

MAX_RETRIES = 3


class Reviewer(Protocol):
    """Extension point: a source of findings."""

    def review(self, request: Mapping[str, DataFrame]) -> DataFrame: ...


class Renderer(Protocol):
    """Extension point: findings as a column of text."""

    def __call__(self, findings: DataFrame) -> DataFrame: ...


class RuleReviewer:
    """Findings from rules (pattern, title, severity, category): a row for each line of an added text that a pattern matches."""

    def __init__(self, rules: Iterable[tuple[str, str, str, str]], name: str = "structural"):
        self.rules, self.name = list(rules), name

    def review(self, request: Mapping[str, DataFrame]) -> DataFrame:
        lines = request["lines"].where("side = '+'")
        kinds = F.array(*[F.when(F.col("content").rlike(p), F.struct(F.lit(t).alias("title"), F.lit(s).alias("severity"), F.lit(c).alias("category"))) for p, t, s, c in self.rules])
        hits = lines.withColumn("r", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
        return hits.select("path", F.col("line").alias("start"), F.col("line").alias("end"), "r.title", F.col("r.title").alias("message"), "r.severity", "r.category", F.lit(0.6).alias("confidence"), F.lit(self.name).alias("reviewer"))


PROVIDERS: dict[str, Callable[..., Reviewer]] = {"rules": RuleReviewer}


def provider(kind: str, *args, **options) -> Reviewer:
    """A registered reviewer; an unknown or hosted one is an error."""
    if kind not in PROVIDERS:
        raise ConfigurationError(f"no reviewer {kind!r}; registered: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[kind](*args, **options)


def role_of(task: Column) -> Column:
    """The prompt that a task asks for, by the first role that it names."""
    low = F.lower(F.coalesce(task, F.lit("")))
    out = F.when(F.contains(low, F.lit("security")), "reviewer.security.v1").when(F.contains(low, F.lit("semantic")), "reviewer.semantic.v1")
    return out.when(F.contains(low, F.lit("critic")), "critic.v1").otherwise("reviewer.structural.v1")


def finish_reason(reason: Column) -> Column:
    return F.when(reason.isin("stop", "length", "content_filter"), reason).otherwise("stop")


def scheduled(changes: DataFrame, diffs: DataFrame, hunks: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(reviewer, runs) for changes (path): none if there are only documents and tests, else structural always, the others by
    their triggers."""
    p = F.col("path")
    quiet = changes.agg(((F.count("*") > 0) & (F.count_if(~text.is_doc_file(p) & ~text.is_test_file(p)) == 0)).alias("quiet"))
    flags = quiet.crossJoin(relevance.semantic_trigger(changes, hunks, symbols, lines)).crossJoin(relevance.security_trigger(changes, diffs, symbols))  # rows of one each
    rows = F.array(*[F.struct(F.lit(n).alias("reviewer"), (~F.col("quiet") & on).alias("runs")) for n, on in (("structural", F.lit(True)), ("semantic", F.col("semantic")), ("security", F.col("security")))])
    return flags.select(F.explode(rows).alias("r")).select("r.*")


def retry_delay(attempt: int, status: int | None, after: float | None, base: float = 1.0, most: float = 30.0, spread: Callable[[], float] = random.random) -> float | None:
    """Seconds until the next try, or None if there is none: never after 401 and 403, only after 429, 5xx and network errors
    (no status), MAX_RETRIES times. A stated wait goes before the back-off."""
    if attempt >= MAX_RETRIES or not (status is None or status == 429 or 500 <= status < 600):
        return None
    return after if after is not None else min(most, base * 2**attempt) * (0.5 + spread() / 2)


def with_retries(call: Callable[[], object], wait: Callable[[float], None] = time.sleep):
    """call() until it gives a result or retry_delay gives up; errors may carry ``status`` and ``retry_after``."""
    attempt = 0
    while True:
        try:
            return call()
        except Exception as e:
            delay = retry_delay(attempt, getattr(e, "status", None), getattr(e, "retry_after", None))
            if delay is None:
                if isinstance(e, ModelError):
                    raise
                raise ModelError(str(e), {"attempts": attempt + 1, "status": getattr(e, "status", None)}) from e
            wait(delay)
            attempt += 1


def replay_retries(log: DataFrame) -> DataFrame:
    """(request, attempts, outcome) of calls logged as (request, seq, status; null for a network error, 200 for success): what
    the retry rule makes of each request's log. Tries after the first that ends a request don't count."""
    end = lambda x: (x["status"] == 200) | ~(x["status"].isNull() | (x["status"] == 429) | x["status"].between(500, 599))
    state = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        out = F.when(F.coalesce(x["status"] == 200, F.lit(False)), "done").when(F.coalesce(x["status"].isin(401, 403), F.lit(False)), "refused").when(F.coalesce(end(x), F.lit(False)), "failed").when(n > MAX_RETRIES, "exhausted")
        return F.when(s["out"].isNotNull(), s).otherwise(F.struct(n.alias("n"), out.alias("out")))

    calls = F.array_sort(F.collect_list(F.struct("seq", "status")))
    return log.groupBy("request").agg(F.aggregate(calls, state, step).alias("s")).select("request", F.col("s.n").alias("attempts"), F.coalesce("s.out", F.lit("pending")).alias("outcome"))


def token_usage(calls: DataFrame, key: list[str]) -> DataFrame:
    """Sums of prompt_tokens, completion_tokens and total_tokens; a missing count is nothing."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return calls.groupBy(*key).agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).cast("long").alias(n) for n in names])


def run_reviewers(plan: DataFrame, reviewers: Mapping[str, Reviewer], request: Mapping[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """The findings of all reviewers that the plan runs, and a warning for each that failed; an error if all did."""
    found, warnings = [], []
    due = [r["reviewer"] for r in plan.where("runs").collect()]  # three at most
    for name in due:
        try:
            found.append(with_retries(lambda r=reviewers[name]: r.review(request)).withColumn("reviewer", F.coalesce("reviewer", F.lit(name))))
        except (KeyError, ModelError) as e:
            warnings.append(f"[{name}] reviewer failed: {e}")
    if due and not found:
        raise ModelError("all reviewers failed: " + "; ".join(warnings))
    out = None
    for df in found:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, warnings


#: What a critic's finding has if it says nothing itself.
CRITIC_DEFAULTS = {"trigger": "certain inputs lead to this defect", "critic_reason": "held against the repository and the patch", "introduced_by_patch": "introduced_by_patch", "critic_decision": "approved", "reviewer": "critic"}


def critic(findings: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, repair: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Findings that the floor left (dropped_by null), judged: judge may drop rows or set columns; if it fails, repair is tried
    once, and then the stage fails. Without any row the judge isn't asked. Missing columns get their defaults."""
    left = findings.where("dropped_by is null")
    if judge is not None and left.limit(1).count():
        try:
            left = judge(left)
        except Exception as first:
            try:
                left = (repair or judge)(left)
            except Exception as e:
                raise ModelError("the critic failed twice", {"first": str(first), "second": str(e)}) from e
    have = lambda c: F.col(c) if c in left.columns else F.lit(None).cast("string")
    loud = F.when(F.col("severity").isin("critical", "high"), "blocking").otherwise("advisory")
    filled = {k: F.coalesce(have(k), F.lit(v)) for k, v in CRITIC_DEFAULTS.items()}
    filled |= {
        "claim": F.coalesce(have("claim"), F.col("title")),
        "failure_mechanism": F.coalesce(have("failure_mechanism"), have("impact"), F.col("message")),
        "required_fix": F.coalesce(have("required_fix"), have("suggested_fix")),
        "suggested_disposition": F.coalesce(have("suggested_disposition"), loud),
    }
    return left.withColumns(filled)


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """(stage, n) of the rows of each stage, in one job."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def languages(files: DataFrame) -> DataFrame:
    """(language) of files (path), each once."""
    return files.select(text.language(F.col("path")).alias("language")).where("language is not null").distinct()


def categories(findings: DataFrame) -> DataFrame:
    return findings.select("category").distinct()

"""Shared plumbing: table access, scratch tables in the shared folder, row ids, Arrow batch helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; bounds its memory whatever the batch holds.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names, or a temporary one where all run in one
    process. On a cluster without a stated one the call fails."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="adjudica-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _root(spark: SparkSession, scope: str) -> str:
    return f"{shared_dir(spark)}/adjudica-{spark.sparkContext.applicationId}/{scope}"


def forget_at_exit(spark: SparkSession, folder: str) -> None:
    """A folder of scratch tables goes when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def store(spark: SparkSession, df: DataFrame, what: str, scope: str = "op") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, keeps column pruning."""
    path = f"{_root(spark, scope)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, _root(spark, scope))
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, scope: str = "op") -> None:
    """Deletes the scratch tables of a scope. Call it once their results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_root(spark, scope))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, jobs that run hand Python workers n rows at once: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spans(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges [a, b) whose sizes add up to about the limit; one larger is a range of its own."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """spans() of texts by their bytes."""
    return spans([len(t) for t in texts], limit)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text that are split at once.
PIECE = 1_000_000


def pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of the text, in pieces of about limit bytes."""
    a = 0
    while a < len(text):
        cut = _BLANK.search(text, a + limit) if len(text) - a > limit else None
        b = cut.start() if cut else len(text)
        yield text[a:b].split()
        a = b + 1


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)) for words in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if batch.num_rows:
            yield batch


#: Of this Python worker: the operator whose task it ran last, and how to drop what operators remember between tasks.
_served: list[str] = [""]
_drops: list[Callable[[], None]] = []


def on_release(drop: Callable[[], None]) -> None:
    """Calls drop before this worker serves another operator."""
    _drops.append(drop)


on_release(_hashes.clear)


def begin(operator: str) -> None:
    if _served[0] != operator:
        for drop in _drops:
            drop()
        _served[0] = operator
        trim()


def trim() -> None:
    """Gives freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def task(operator: str) -> Callable:
    """For functions that mapInArrow runs. Spark hands one worker to the tasks of many operators in turn: it drops what the
    last operator remembered, and gives back what a task has freed."""

    def wrap(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
        @wraps(run)
        def served(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(operator)
            try:
                yield from run(rows)
            finally:
                trim()

        return served

    return wrap

"""Operator 12, target-distribution importance resampling over hashed n-grams.

Features are runs of 1 to ``n`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo ``BUCKETS``. One scan of a document keeps the running CRC states of the last n - 1 starts in a ring: each new
word begins a state of its own and extends those of the ring by a space and itself, so no feature is ever spelled out.

A first scan counts the buckets of the corpus and of the target, densely for each task. The bucket gains, a table of fixed size, go
to the second scan, which weighs every document. The draw adds Gumbel noise from a hash of the id and takes the highest
scores: their order comes from counts by score, first by thousands, then within each, and from ids within a score.

Defined results: null or empty text has no features and weight 0. A null id has no noise: its score is null, it isn't drawn
and doesn't count among the N documents. Rows that share an id are each weighed and drawn for themselves; equal scores of
equal ids go by the number of features. Equal rows have ranks that follow each other. Extra columns aren't read. A very
long text is scanned in pieces, the ring goes on from one to the next. Without target rows T is 0; an empty corpus gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, store, task, utf8

BUCKETS, GRAMS, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
PIECE = 1_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def scan(text: bytes, n: int = GRAMS, piece: int = PIECE) -> Iterator[tuple[int, list[int]]]:
    """(number of words, CRC-32 of the features that end in them) for each piece of about so many bytes."""
    text, a = text.lower(), 0
    ring: list[int | None] = [None] * n  # at k: the state of the run of k + 1 words that ends at the last word
    while a < len(text):
        cut = _GAP.search(text, a + piece) if len(text) - a > piece else None
        b = cut.start() if cut else len(text)
        found = _WORD.findall(text, a, b)
        a = b
        if not found:
            continue
        spaced = [b" " + w for w in found]
        states = list(map(crc32, found))
        out, after = list(states), [states[-1]]
        for k in range(1, n):
            starts = [s for s in (ring[k - 1],) if s is not None] + states[:-1]
            states = list(map(crc32, spaced[len(spaced) - len(starts) :], starts))
            out += states
            after.append(states[-1] if states else None)
            if not states:
                break
        ring = after + [None] * (n - len(after))
        yield len(found), out


def bucket_counts(docs: DataFrame, n: int = GRAMS) -> DataFrame:
    """bucket, count over all texts."""

    @task(__name__)
    def run(rows):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches(rows):
            for text in utf8(batch.column("text")):
                for _, states in scan(text, n):
                    total += np.bincount(np.array(states, np.int64) % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "count"])

    return docs.select("text").mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def _dense(counts: DataFrame) -> np.ndarray:
    """At most BUCKETS rows."""
    out = np.zeros(BUCKETS, object)
    for r in counts.collect():
        out[r["bucket"]] = r["count"]
    return out


def gains(corpus: DataFrame, target: DataFrame, n: int = GRAMS) -> list[int]:
    """Of each bucket: floor(1000 ln) of its smoothed share in the target over that in the corpus."""
    s, t = _dense(bucket_counts(corpus, n)), _dense(bucket_counts(target, n))
    all_s, all_t = int(s.sum()), int(t.sum())
    return [math.floor(1000 * math.log((int(y) + 1) * (all_s + BUCKETS) / ((int(x) + 1) * (all_t + BUCKETS)))) for x, y in zip(s, t, strict=True)]


def weigh(docs: DataFrame, gain: list[int], n: int = GRAMS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_words, n_features, weight (floored mean gain of the features, 0 without)."""
    kept = docs.select(*keep)

    @task(__name__)
    def run(rows):
        gains_ = np.array(gain, np.int64)
        for batch in batches(rows):
            words, sizes, weights = [], [], []
            for text in utf8(batch.column("text")):
                n_words = size = total = 0
                for found, states in scan(text, n):
                    n_words, size = n_words + found, size + len(states)
                    total += int(gains_[np.array(states, np.int64) % BUCKETS].sum())
                words.append(n_words)
                sizes.append(size)
                weights.append(total // size if size else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in (words, sizes, weights))], names=[*keep, "n_words", "n_features", "weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, n_words long, n_features long, weight long")


def noisy(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: weight plus floored Gumbel noise of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def draw(spark: SparkSession, scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, scope: str = "op") -> DataFrame:
    """Adds rank: 1, 2, ... by falling score, then id, of the highest percent of the documents with least_words; null for the others."""
    rows = store(spark, scored.withColumn("_in", (F.col("n_words") >= least_words) & F.col("score").isNotNull()), "scored", scope)
    by_score = rows.where("_in").groupBy("score").agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("score") / 1000))
    by_score = store(spark, by_score, "scores", scope)
    # A score is a whole number between bounds that the logarithms set, so bins are some tens and scores of a bin 1000 at most.
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    bins = by_score.groupBy("_bin").agg(F.sum("_n").alias("_all"))
    above = bins.select("_bin", F.coalesce(F.sum("_all").over(Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"), F.sum("_all").over(Window.partitionBy()).alias("_total"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = by_score.withColumn("_within", within).join(above, "_bin")
    places = places.select("score", (F.col("_above") + F.col("_within")).alias("_before"), F.expr(f"({percent} * _total) div 100").alias("_drawn")).where("_before < _drawn")
    order = Window.partitionBy("score").orderBy("doc_id", "n_features")
    rank = F.col("_before") + F.row_number().over(order)
    ranked = rows.where("_in").join(places, "score").withColumn("rank", F.when(rank <= F.col("_drawn"), rank)).drop("_before", "_drawn")
    low = rows.where("_in").join(places.select("score"), "score", "left_anti").unionByName(rows.where("not _in")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(low).drop("_in")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = GRAMS, seed: int = SEED, scope: str = "op") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return draw(spark, noisy(weigh(docs, gains(docs, target, n), n), seed), scope=scope)

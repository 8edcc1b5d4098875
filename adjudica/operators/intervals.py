"""Inclusive integer intervals within a key: islands, overlap semi-joins, innermost containment, line coalescing.

Joins are equi-joins on the key and on a coarse bucket of the line, so that a key with very many intervals spreads over
tasks; a pair that shares several buckets is counted in the first of them only, so no distinct is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import dealt

BUCKET = 64


def islands(df: DataFrame, key: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Adds ``island``, the number within the key of the group of intervals that touch each other's lines.

    An interval whose end is before its start touches nothing and is an island of its own.
    """
    keys = [F.col(k) for k in key]
    w = Window.partitionBy(*keys, F.col(end) < F.col(start)).orderBy(F.col(start), F.col(end), *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before) | (F.col(end) < F.col(start)), 1).otherwise(0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(run))
    return numbered.withColumn("island", F.when(F.col(end) < F.col(start), -F.col("island")).otherwise(F.col("island"))).drop("_fresh")


def buckets(start: Column, end: Column, size: int = BUCKET) -> Column:
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end) / size))


def overlapping(left: DataFrame, right: DataFrame, key: str, tolerance: int = 0, size: int = BUCKET, n: int | None = None) -> DataFrame:
    """Pairs of left (key, start, end, …) and right (key, r_start, r_end, …) rows that overlap within the tolerance. n: partitions."""
    a = left.withColumn("_b", F.explode(buckets(F.col("start") - tolerance, F.col("end") + tolerance, size)))
    b = right.withColumn("_b", F.explode(buckets(F.col("r_start"), F.col("r_end"), size)))
    meet = (F.col("start") <= F.col("r_end") + tolerance) & (F.col("end") >= F.col("r_start") - tolerance)
    first = F.col("_b") == F.greatest(F.floor((F.col("start") - tolerance) / size), F.floor(F.col("r_start") / size))
    return dealt(a, n, key, "_b").join(dealt(b, n, key, "_b"), [key, "_b"]).where(meet & first).drop("_b")


def touching(rows: DataFrame, ranges: DataFrame, key: str, tolerance: int, kinds: dict[str, Column], n: int | None = None) -> DataFrame:
    """rows (key, start, end, …) with a boolean for each of ``kinds``: whether a range (key, r_start, r_end, …) of that condition lies
    within the tolerance of the row's lines. n: partitions.

    Rows and ranges of a key are sorted together, each row behind the ranges that begin by its end; the last line of those tells. So
    both are shuffled once, by the key, and nothing is paired, made distinct or joined back. A key is one window, which spills.
    """
    known = ranges.where(F.col(key).isNotNull() & F.col("r_start").isNotNull() & reduce(Column.__or__, kinds.values()))
    last = {k: f"_last_{i}" for i, k in enumerate(kinds)}
    # Few columns, as all of them are shuffled: a range's first line takes the place of a row's end.
    b = known.select(key, (F.col("r_start") - tolerance).cast(rows.schema["end"].dataType).alias("end"), F.lit(0).alias("_row"), *[F.when(kinds[k], F.col("r_end")).alias(c) for k, c in last.items()])
    both = dealt(rows.withColumn("_row", F.lit(1)).unionByName(b, allowMissingColumns=True), n, key)
    w = Window.partitionBy(key).orderBy("end", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.select(*rows.columns, "_row", *[F.coalesce(F.max(c).over(w) >= F.col("start") - tolerance, F.lit(False)).alias(k) for k, c in last.items()])
    return met.where("_row = 1").drop("_row")


def innermost(points: DataFrame, ranges: DataFrame, key: str, line: str, point: list[str]) -> DataFrame:
    """For each point (identified by ``point``), the smallest containing range (key, r_start, r_end, r_id); the first of equals."""
    p = points.select(key, *point, F.col(line).alias("start"), F.col(line).alias("end"))
    pairs = overlapping(p, ranges, key)
    return pairs.groupBy(*point).agg(F.min(F.struct((F.col("r_end") - F.col("r_start")).alias("span"), "r_id")).alias("_m")).select(*point, F.col("_m.r_id").alias("r_id"))


def with_innermost(rows: DataFrame, ranges: DataFrame, key: str, line: str, point: list[str], name: str, n: int | None = None) -> DataFrame:
    """rows, each identified by ``point``, with ``name``: innermost()'s r_id, null where no range has the line. A line lies in one
    bucket, so a row's ranges meet where the row is and all its columns stay there. n: partitions."""
    rest = [c for c in rows.columns if c not in (key, *point)]
    a = dealt(rows.withColumn("_b", F.floor(F.col(line) / BUCKET)), n, key, "_b")
    ranges = ranges.select(*[F.col(c).alias(c) for c in ranges.columns])  # own columns, also where both come from one table
    b = dealt(ranges.withColumn("_b", F.explode(buckets(F.col("r_start"), F.col("r_end")))), n, key, "_b")
    pairs = a.join(b.where("r_start <= r_end"), (a[key] == b[key]) & (a["_b"] == b["_b"]) & (a[line] >= b["r_start"]) & (a[line] <= b["r_end"]), "left").drop(b[key], b["_b"])
    found = F.min(F.when(F.col("r_id").isNotNull(), F.struct((F.col("r_end") - F.col("r_start")).alias("span"), "r_id"))).alias("_m")
    got = pairs.groupBy(key, "_b", *point).agg(found, *[F.first(c).alias(c) for c in rest])
    return got.select(*rows.columns, F.col("_m.r_id").alias(name))


def coalesce_lines(lines: DataFrame, key: list[str], line: str) -> DataFrame:
    """Runs of consecutive line numbers as intervals (key, start, end)."""
    w = Window.partitionBy(*key).orderBy(line)
    runs = lines.select(*key, line).distinct().withColumn("_g", F.col(line) - F.row_number().over(w))
    return runs.groupBy(*key, "_g").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_g")

"""Evaluation: matching findings with expected ones, metrics of each fixture, the scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import severity_level
from ..plans.shared import dealt, parts, store


def matched(findings: DataFrame, expected: DataFrame, tolerance: int = 1, n_rows: int | None = None) -> DataFrame:
    """(fixture, expected_id, finding_id) of pairs that agree: same file and category, lines within the tolerance, severity
    and confidence high enough, and a keyword in title or message if any are given. ``n_rows``: about how many findings there
    are, so that a task's share stays small."""
    n, keys = None if n_rows is None else parts(findings.sparkSession, n_rows), ["fixture", "file", "category"]
    f = findings.select("fixture", "file", "category", F.col("id").alias("finding_id"), "start_line", "end_line", F.col("severity").alias("_s"), "confidence", F.lower(F.concat_ws(" ", "title", "message")).alias("_t"))
    pairs = dealt(f, n, *keys).join(dealt(expected, n, *keys), keys)
    word = F.when(F.coalesce(F.size("keywords"), F.lit(0)) <= 0, True).otherwise(F.exists("keywords", lambda k: F.contains(F.col("_t"), F.lower(k))))
    near = (F.col("start_line") <= F.col("e_end") + tolerance) & (F.col("end_line") >= F.col("e_start") - tolerance)
    met = pairs.where(near & (severity_level(F.col("_s")) >= severity_level(F.col("e_severity"))) & (F.col("confidence") >= F.col("min_confidence")) & word)
    return dealt(met.select("fixture", "expected_id", "finding_id"), n, "fixture")


def fixture_metrics(findings: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fixture, true_positives, false_positives, false_negatives) from findings, expected rows and matched pairs."""
    a = findings.groupBy("fixture").agg(F.count("*").alias("found"))
    b = expected.groupBy("fixture").agg(F.count("*").alias("wanted"))
    c = pairs.groupBy("fixture").agg(F.countDistinct("finding_id").alias("good"), F.countDistinct("expected_id").alias("met"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    all_ = a.join(b, "fixture", "full_outer").join(c, "fixture", "left")
    return all_.select("fixture", zero("met").alias("true_positives"), (zero("found") - zero("good")).alias("false_positives"), (zero("wanted") - zero("met")).alias("false_negatives"))


#: Equal parts of the values' range in which a rank is looked for first.
PARTS = 1000


def nearest_ranks(rows: DataFrame, column: str, fractions: dict[str, tuple[float, bool]]) -> DataFrame:
    """One row, a column for each name: the exact value at rank floor(n * fraction) from 0, or at most the last one where the
    flag says so; null without rows. A null counts as least.

    Counts of parts of the range, at most PARTS + 1 and one for nulls, tell in which part a rank lies; only that part's
    distinct values are then put in order.
    """
    hist = store(rows.groupBy(F.col(column).cast("double").alias("_k"), F.col(column).alias("v")).agg(F.count("*").alias("c")), "histogram")
    span = hist.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.sum("c").alias("n"))
    part = F.coalesce(F.when(F.col("hi") > F.col("lo"), F.floor((F.col("_k") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS)).when(F.col("_k").isNotNull(), 0), F.lit(-1))
    placed = hist.crossJoin(span).select("_k", "v", "c", part.alias("part"))  # a row on the right
    counts = placed.groupBy("part").agg(F.sum("c").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("part"))
    counts = counts.select("part", (upto - F.col("_c")).alias("before"), upto.alias("upto"))
    rank = lambda f, last: F.least(F.col("n") - 1, F.floor(F.col("n") * f)) if last else F.floor(F.col("n") * f)
    wanted = span.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), rank(*x).alias("rank")) for k, x in fractions.items()])).alias("w")).select("w.*")
    near = counts.crossJoin(wanted).where("before <= rank and rank < upto").select("part", "before", "name", "rank")  # some rows by some
    seen = F.col("before") + F.sum("c").over(Window.partitionBy("name").orderBy("_k"))
    found = placed.join(near, "part").withColumn("_upto", seen).where("_upto > rank and _upto - c <= rank")
    return found.agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in fractions])


def scorecard(results: DataFrame) -> DataFrame:
    """One row over results (true_positives, false_positives, false_negatives, latency): sums, precision, recall, false
    positive rate, nearest-rank p50 and p95 of latency, and whether the quality gate passes. Percentiles are exact."""
    tp, fp, fn = (F.sum(c) for c in ("true_positives", "false_positives", "false_negatives"))
    results = store(results, "results")
    out = results.agg(F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    c = F.col
    both = out.crossJoin(nearest_ranks(results, "latency", {"p50": (0.5, False), "p95": (0.95, True)}))  # one row each
    precision, fpr, recall = ratio(c("tp"), c("tp") + c("fp"), 1.0), ratio(c("fp"), c("tp") + c("fp"), 0.0), ratio(c("tp"), c("tp") + c("fn"), 1.0)
    return both.select("n", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), fpr.alias("false_positive_rate"), "p50", "p95", ((precision >= 0.7) & (fpr <= 0.3) & (recall >= 0.7)).alias("passed"))

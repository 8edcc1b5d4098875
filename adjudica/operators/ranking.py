"""Ranking: composite scores, the comparator, truncation that keeps every critical finding, zero-filled counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, vocab
from ..plans.shared import parts


def scored(findings: DataFrame, dependents: Column | None = None) -> DataFrame:
    """Adds the six component scores and ``composite_score`` to findings (severity, confidence, n_evidence, n_files, tight, category, title, message)."""
    blast = scoring.blast_radius(F.lit(0) if dependents is None else dependents)
    out = findings.withColumns(
        {
            "severity_score": scoring.severity_score(F.col("severity")),
            "confidence_score": scoring.confidence_score(F.col("confidence")),
            "evidence_score": scoring.evidence_strength(F.col("n_evidence"), F.col("n_files"), F.col("tight")),
            "blast_score": blast,
            "security_score": scoring.security_impact(F.col("category"), F.col("severity"), F.concat_ws(" ", "title", "message")),
        }
    )
    out = out.withColumn("regression_score", scoring.regression_probability(F.col("category"), F.col("blast_score")))
    return out.withColumn("composite_score", scoring.composite(*[F.col(f"{x}_score") for x in ("severity", "confidence", "evidence", "blast", "security", "regression")]))


def comparator(*ties: str) -> list[Column]:
    """Score, severity and confidence downwards, then file and line, then the ties given."""
    return [F.desc("composite_score"), F.desc("severity_level"), F.desc("confidence"), F.asc("file"), F.asc("start_line"), *[F.asc(t) for t in ties]]


def protected_top(ranked: DataFrame, most: int, ties: list[str], min_severity: str = "info") -> DataFrame:
    """All critical findings, and the best others up to ``most`` in all. The others are a top-k, which each task reduces
    before anything is shuffled; the number of critical ones is a count."""
    kept = ranked.withColumn("severity_level", scoring.severity_level(F.col("severity"))).where(F.col("severity_level") >= vocab.SEVERITY_LEVEL[min_severity])
    critical = kept.where(F.col("severity") == "critical")
    room = max(0, most - critical.count())
    others = kept.where(F.col("severity") != "critical").orderBy(*comparator(*ties)).limit(room)
    return critical.unionByName(others)


def zero_filled(spark: SparkSession, counts: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(value, n) for every value of the domain, 0 where nothing was counted."""
    values = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(counts.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(F.col(column), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def nav_list(findings: DataFrame, ties: list[str], n_rows: int | None = None) -> DataFrame:
    """Severity groups in fixed order, a header row with the group's count before its findings, best score first. ``n_rows``:
    about how many findings there are, so that a task's share of the sort stays small."""
    level = scoring.severity_level(F.col("severity"))
    heads = findings.groupBy("severity").agg(F.count("*").alias("n")).select("severity", level.alias("severity_level"), F.lit(0).alias("detail"), F.lit(None).cast("double").alias("composite_score"), *[F.lit(None).cast(findings.schema[t].dataType).alias(t) for t in ties], "n")
    rows = findings.select("severity", level.alias("severity_level"), F.lit(1).alias("detail"), F.col("composite_score").cast("double").alias("composite_score"), *ties, F.lit(None).cast("long").alias("n"))
    order = [F.desc("severity_level"), F.asc("detail"), F.desc("composite_score"), *[F.asc(t) for t in ties]]
    both = heads.unionByName(rows)
    n = None if n_rows is None else parts(findings.sparkSession, n_rows)
    return (both.repartitionByRange(n, *order) if n else both).orderBy(*order)

"""The review plan: score, cluster and merge, consolidate, gate, and summarise, as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bind
from ..functions import scoring, vocab
from ..operators import gate, linkage, ranking
from ..sources.readers import table
from .shared import dealt, parts


def merged_findings(findings: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Overlapping findings of a file as one, with the columns that scoring and the gate need. ``n_rows``: about how many findings
    there are, so that a task's share stays small."""
    n = None if n_rows is None else parts(findings.sparkSession, n_rows)
    df = linkage.overlap_clusters(dealt(findings, n, "file"), ["id"]).withColumns({"severity_level": scoring.severity_level(F.col("severity")), "evidence_key": F.concat_ws(":", F.col("file").cast("string"), F.col("start_line").cast("string"))})
    merged = linkage.survive(df, ["file", "cluster"])
    names = {v: k for k, v in vocab.SEVERITY_LEVEL.items()}
    severity = F.element_at(F.array(*[F.lit(names[i]) for i in range(1, 6)]), F.col("severity_level"))
    return merged.withColumns({"severity": severity, "n_evidence": F.size("evidence_keys").cast("long"), "n_files": F.lit(1), "tight": F.lit(True), "id": F.col("rep_id")})


def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and best score of merged findings by disposition and severity."""
    ranked = ranking.scored(merged_findings(bind.findings(spark, sf_dir), table(spark, sf_dir, "lineitem").count()))
    none = F.lit(None).cast("string")
    ready = ranked.withColumns(
        {
            "failure_mechanism": none, "impact": none, "trigger": none, "introduced_by_patch": F.lit("introduced_by_patch"), "critic_decision": none, "suggested_disposition": none, "n_contradictions": F.lit(0),
            "v_valid": F.lit(True), "v_n_valid": F.lit(1), "v_n_invalid": F.lit(0), "v_direct": F.lit(True), "v_strength": F.lit(75), "v_fabricated": F.lit(False),
        }
    )
    got = gate.gated(ready)
    return got.groupBy("final_disposition", "severity").agg(F.count("*").alias("n"), F.max("composite_score").alias("best"))

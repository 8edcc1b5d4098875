"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _decontaminate
from . import divergence, html_extract, importance, language_id, line_dedup, mixing, near_dedup, secrets, substring_dedup, token_blocks, url_filter, webp
from .common import sweep, table
from .oracles import SQL

Query = Callable[[SparkSession, str], DataFrame]


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = language_id.identify(spark, docs, allowed=~held_out(F.col("doc_id")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(spark, table(spark, sf_dir, "documents")))


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media(spark, table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.near_lines(spark, table(spark, sf_dir, "documents")))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.tokenize(spark, table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _decontaminate.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near_terms=9)
    return got.drop("text_hash")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = importance.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _pipeline() -> Query | None:
    """run() of corpus_pipeline.py at the repository's top, if that file is there."""
    path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    if not path.exists():
        return None

    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.run(spark, sf_dir)

    return pipeline


def queries() -> dict[str, Query]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    pipeline = _pipeline()
    return own | ({"pipeline": pipeline} if pipeline else {})


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries", "sweep"]

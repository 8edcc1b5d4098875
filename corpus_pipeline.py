"""From raw documents to token blocks: language ID, near-duplicate removal, decontamination, source mixing, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. A
stage may thus clear the scratch tables of the one before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import decontaminate as decontamination
from adjudica.llm import language_id, mixing, near_dedup, token_blocks
from adjudica.llm.common import forget_at_exit, shared_dir, sweep, table

SCOPE = "pipeline"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no letters (null and empty texts too), or far from every learned
    language. Repeated rows, null ids and texts of any length are judged alike; extra columns go."""
    sweep(spark, SCOPE)
    got = language_id.identify(spark, docs.select(*COLUMNS), keep=COLUMNS)
    return got.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id; rows without words stay too. Rows that
    share an id but not the text are judged each for itself; of rows that repeat both one stays."""
    sweep(spark, SCOPE)
    return near_dedup.without_near_duplicates(spark, docs.select(*COLUMNS), words=WORDS, percent=PERCENT, scope=SCOPE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in which a window of a benchmark item occurs, each judged by its own text, with or without an id."""
    sweep(spark, SCOPE)
    judged = decontamination.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), near_terms=None, scope=SCOPE)
    gone = judged.where("contaminated").select("doc_id", "text_hash").distinct()
    rows = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["_hash"] == gone["text_hash"])
    return rows.join(gone, same, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows in the order of the mix: the files' order is the slots' order, and so is the rows' within a file. All rows
    stay; rows of one id, null too, stand together. A null source is a source of its own."""
    sweep(spark, SCOPE)
    order = mixing.mixed(spark, docs, scope=SCOPE).select("doc_id", "slot", "place")
    order = order.groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("_at"))  # rows of one id stay together
    placed = docs.select(*COLUMNS).join(order, docs["doc_id"].eqNullSafe(order["doc_id"])).drop(order["doc_id"])
    return placed.repartitionByRange("_at").sortWithinPartitions("_at").select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks in the stored order of docs (file, then row), or by id where docs isn't read from files. Null and empty
    texts have the end id only."""
    sweep(spark, SCOPE)
    placed, order = docs, ("doc_id",)
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput()
    if "_metadata" in [hidden.apply(i).name() for i in range(hidden.size())]:
        file = F.col("_metadata.file_name")
        placed = docs.select("doc_id", "text", F.length(file).alias("_f"), file.alias("_n"), F.col("_metadata.row_index").alias("_r"))
        order = ("_f", "_n", "_r")
    return token_blocks.tokenize(spark, placed, order=order, scope=SCOPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token blocks", write_tokens),
]

#: SQL can't express the language model, the schedule and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{at}/{k}")
        forget_at_exit(spark, at)
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

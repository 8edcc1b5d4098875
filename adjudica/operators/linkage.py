"""Entity resolution of findings: clusters within a file and survivorship merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import parts, store
from .intervals import islands


def overlap_clusters(findings: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``cluster``: findings of a file whose lines overlap, directly or through others."""
    return islands(findings, ["file"], "start_line", "end_line", order).withColumnRenamed("island", "cluster")


#: Edges that a task contracts at once.
CHUNK = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, in order, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)  # the roots meet, so what hangs on them comes along
        np.minimum.at(label, label[y], low)
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as (id, root): each node of a chunk with the least node that the chunk's edges join to it."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(*ends)], ["id", "root"])

    held: list[pa.RecordBatch] = []
    for x in batches:
        held.append(x)
        if sum(map(len, held)) >= CHUNK:
            yield chunk(held)
            held = []
    if held:
        yield chunk(held)


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of (a, b): id and the smallest id reachable. Null ends aren't edges.

    Tasks contract their edges in chunks first, in whatever order they lie. Nodes that two chunks gave different roots join
    those roots; only that graph, empty where components lie together, goes by rounds over all tasks.
    """
    known = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    stars = store(known.mapInArrow(_contract, "id long, root long"), f"{what}-stars")
    least = store(stars.groupBy("id").agg(F.min("root").alias("label"), F.max("root").alias("_most")), f"{what}-least")
    split = least.where("_most > label").select("id", F.col("label").alias("b"))
    apart = store(stars.join(split, "id").where("root <> b").select(F.col("root").alias("a"), "b").distinct(), f"{what}-apart")
    if not apart.limit(1).count():
        return least.select("id", "label")
    joined = _rounds(apart, what).select(F.col("id").alias("label"), F.col("label").alias("_r"))
    return least.select("id", "label").join(joined, "label", "left").select("id", F.coalesce("_r", "label").alias("label"))


def _rounds(edges: DataFrame, what: str) -> DataFrame:
    """components() by min-label propagation with pointer jumping.

    Labels are stored after every round, so lineage stays short and a lost executor costs one round. Rounds grow with
    the logarithm of the longest path; only whether any label moved reaches the driver.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), f"{what}-edges")
    label = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"), F.lit(True).alias("moved")), what)
    while label.where("moved").limit(1).count():
        near = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("_n")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_n").alias("_n"))
        low = label.join(near, "id").select("id", F.col("label").alias("_old"), F.least("label", "_n").alias("label"))
        root = label.select(F.col("id").alias("label"), F.col("label").alias("_r"))
        jumped = low.join(root, "label").select("id", F.least("label", "_r").alias("label"), "_old")
        label = store(jumped.select("id", "label", (F.col("label") < F.col("_old")).alias("moved")), what)
    return label.select("id", "label")


def consolidate(findings: DataFrame, order: list[str], keep: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Adds ``cluster`` to findings (id, file, start_line, end_line, category, symbol, norm_title): linked if in one file and
    overlapping, or of one innermost symbol and category, or of one normalised title. ``keep``: the columns that stay, else all;
    ``n_rows``: about how many findings there are, so that a task's share stays small.

    Rows are linked to hubs instead of to each other: an edge for each row and reason, never a pair of rows. All hubs lie in a
    file, so windows name each by its first row where the file is; islands are then the nodes.
    """
    first = lambda *by: F.min("_head").over(Window.partitionBy("file", *by))
    kept = findings.columns if keep is None else keep
    n = None if n_rows is None else parts(findings.sparkSession, n_rows)
    dealt = findings.repartition(n, "file") if n else findings.repartition("file")  # once, for all windows
    rows = islands(dealt, ["file"], "start_line", "end_line", order)
    rows = rows.withColumn("_head", F.min("id").over(Window.partitionBy("file", "island")))
    rows = rows.withColumn("_symbol", F.when(F.col("symbol").isNotNull(), first("symbol", "category"))).withColumn("_title", first("norm_title"))
    rows = store(rows.select(*kept, "_head", "_symbol", "_title"), "consolidate")
    edges = rows.select(F.col("_head").alias("a"), F.explode(F.array("_symbol", "_title")).alias("b")).where("a <> b")
    label = components(edges, "consolidate").withColumnRenamed("id", "_head")
    return rows.join(label, "_head", "left").select(*kept, F.coalesce("label", "_head").alias("cluster"))


def survive(findings: DataFrame, by: list[str], cap: int = 5, said: tuple[str, ...] = ("title", "message", "category")) -> DataFrame:
    """One row for each cluster: highest severity level and confidence, the lines' hull, the representative's id, title and
    message (most confident, then longest message, then first), all reviewers, related files and symbols where there are such
    columns of arrays, and up to ``cap`` evidence items in order. ``said``: what is asked of the representative. The message's length
    may be a column, ``message_length``, instead of the message."""
    length = F.col("message_length") if "message_length" in findings.columns else F.length("message")
    first = F.struct(F.col("confidence"), length.alias("_length"), (-F.col("id")).alias("_neg"))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c]))
    related = [c for c in ("related_files", "related_symbols") if c in findings.columns]
    return findings.groupBy(*by).agg(
        F.max("severity_level").alias("severity_level"),
        F.max("confidence").alias("confidence"),
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.max_by(F.struct("id", *said), first).alias("_rep"),
        F.slice(ordered("evidence_key"), 1, cap).alias("evidence_keys"),
        F.array_sort(F.collect_set("reviewer")).alias("reviewers"),
        F.count("*").alias("members"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in related],
    ).select(*by, "severity_level", "confidence", "start_line", "end_line", "evidence_keys", "reviewers", "members", *related, F.col("_rep.id").alias("rep_id"), *[F.col(f"_rep.{c}").alias(c) for c in said])


def before_critic(findings: DataFrame, order: list[str], cap: int = 5) -> DataFrame:
    """Findings of a file whose lines overlap as one, before the critic sees them: by lines alone, not by symbols or titles."""
    return survive(overlap_clusters(findings, order), ["file", "cluster"], cap)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given (all remaining columns travel with it)."""
    rest = [c for c in df.columns if c not in key]
    least = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*key).agg(F.min(least).alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])

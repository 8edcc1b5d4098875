"""Operator 6, mixing sources to target weights by Pfair scheduling.

A source's documents are ranked and cut into blocks. With integer weights of sum W, block k (from 1) of a source of
weight w is released in slot floor((k-1)W/w) and due by slot ceil(kW/w); in each slot the released block with the
earliest deadline goes out. Every source's count of blocks is then within one of its share after each slot. The
schedule repeats every W slots, so one period is enough: an SQL fold over W slots makes it, and each block's slot
follows from its rank by arithmetic. When a source has run out, a new epoch starts with the weights that remain; the
slots of an epoch after which a source is empty belong to the next. There are at most as many epochs as sources.

Ranks don't sort a source in one task: rows are dealt to buckets by a hash of their id, ranked within (source, bucket),
and the buckets' counts give offsets. Only per-source counts reach the driver, at most ``source_bound`` rows; beyond it
the call fails, as does a weight sum over ``period_bound``.

Weights: given by source (positive integers; sources without one get 1), or else from the counts tempered by
``temperature`` and scaled to ``units`` in all, at least 1 each.

Defined results: documents without a source form a source of their own. Every row is placed once; ties of id are ranked
by text hash, and equal rows in any order. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

BUCKETS = 1024
#: Rows that a plan may have: (epochs) x (slots of a period).
ROW_BOUND = 2_000_000
_NONE = "\u0000none"


def _period(spark: SparkSession, weights: list[int]) -> list[int]:
    """Which source (by place in weights) each of the sum(weights) slots of a period goes to: earliest deadline first."""
    total = sum(weights)
    w = "array(" + ", ".join(f"{x}L" for x in weights) + ")"
    # State: blocks sent of each source, and the slots so far. At slot t a source may send block k+1 if k*W <= t*w (released); its deadline is ceil((k+1)W/w).
    fold = f"""
      aggregate(sequence(0L, {total - 1}L),
        named_struct('sent', array_repeat(0L, {len(weights)}), 'slots', cast(array() as array<int>)),
        (s, t) -> transform(array(array_min(filter(transform(s.sent, (k, i) ->
            if(k * {total} < (t + 1) * {w}[i] and k < {w}[i],
               named_struct('due', ((k + 1) * {total} + {w}[i] - 1) div {w}[i], 'i', i), null)), x -> x is not null)).i),
          pick -> named_struct('sent', transform(s.sent, (k, i) -> if(i = pick, k + 1, k)), 'slots', array_append(s.slots, pick)))[0],
        s -> s.slots)"""
    return list(spark.range(1).selectExpr(f"{fold} as slots").first()["slots"])


def plan(spark: SparkSession, blocks: dict[str, int], weights: dict[str, int]) -> list[tuple]:
    """Rows (source, first block, last block, place in period, blocks a period, base, period): the slot of a block b of
    that place is base + ((b - first) div per) * period + slot. blocks: the number of blocks of each source."""
    left, base, rows = dict(blocks), 0, []
    done = dict.fromkeys(blocks, 0)
    while active := sorted(s for s in left if left[s] > 0):
        common = math.gcd(*(weights[s] for s in active))
        w = [weights[s] // common for s in active]
        slots = _period(spark, w)
        places = [[] for _ in active]
        for t, i in enumerate(slots):
            places[i].append(t)
        # The epoch ends with the slot in which the first source sends its last block.
        end = min((left[s] - 1) // w[i] * sum(w) + places[i][(left[s] - 1) % w[i]] for i, s in enumerate(active)) + 1
        for i, s in enumerate(active):
            sent = end // sum(w) * w[i] + sum(t < end % sum(w) for t in places[i])
            if sent:
                rows += [(s, done[s], done[s] + sent - 1, k, w[i], base + t, sum(w)) for k, t in enumerate(places[i])]
            done[s] += sent
            left[s] -= sent
        base += end
        if len(rows) > ROW_BOUND:
            raise ValueError(f"the plan has over {ROW_BOUND} rows")
    return rows


def mixed(
    spark: SparkSession,
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    temperature: float = 0.5,
    units: int = 200,
    block_rows: int = 16,
    source_bound: int = 1_000,
    period_bound: int = 10_000,
    scope: str = "op",
    text_ties: bool = True,
) -> DataFrame:
    """doc_id, source, block (of its source, from 0), slot, place (in the block): (slot, place) is the order of the mix."""
    tie = F.xxhash64("text") if text_ties else F.lit(0)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("_s"), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("_b"), tie.alias("_t"))
    rows = store(spark, rows, "rows", scope)
    counts = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    sums = counts.groupBy("_s").agg(F.sum("_n").alias("n")).limit(source_bound + 1).collect()
    if len(sums) > source_bound:
        raise ValueError(f"over {source_bound} sources")
    n = {r["_s"]: r["n"] for r in sums}
    if weights is None:
        whole = sum(v**temperature for v in n.values())
        units = max(units, len(n))
        given = {s: max(1, round(units * v**temperature / whole)) for s, v in n.items()}
    else:
        given = {s: int(weights.get(s, 1)) for s in n}
    if any(v < 1 for v in given.values()) or sum(given.values()) > period_bound:
        raise ValueError(f"weights must be positive and of sum {period_bound} at most")
    schedule = plan(spark, {s: -(-v // block_rows) for s, v in n.items()}, given)
    table = spark.createDataFrame(schedule or [], "_s string, _first long, _last long, _k long, _per long, _at long, _period long")
    per_bucket = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(per_bucket), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_s", "_b").orderBy("doc_id", "_t")
    ranked = rows.withColumn("_r", F.row_number().over(within)).join(offsets, ["_s", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_off") + F.col("_r") - 1).withColumn("block", F.expr(f"_rank div {block_rows}"))
    blocks = ranked.groupBy("_s", "block").agg(F.lit(1)).select("_s", "block")
    epochs = table.select("_s", "_first", "_last", "_per").distinct()
    slot = blocks.join(epochs, "_s").where("block between _first and _last").withColumn("_k", F.expr("(block - _first) % _per"))
    slot = slot.join(table.drop("_last", "_per"), ["_s", "_first", "_k"]).select("_s", "block", (F.expr("(block - _first) div _per") * F.col("_period") + F.col("_at")).alias("slot"))
    return ranked.join(slot, ["_s", "block"]).select("doc_id", "source", "block", "slot", F.expr(f"cast(_rank % {block_rows} as int)").alias("place"))

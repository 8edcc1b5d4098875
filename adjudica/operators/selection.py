"""Token-budgeted selection: the tiered greedy knapsack with rollover, and diff packing. Folds over sorted arrays.

A group is one review's candidates, so its array is one row. The fold is a built-in higher-order expression; items that
don't fit are skipped, not ended at, as later ones may be smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scoring import lookup

#: Shares of the budget in per cent, by tier; the last takes the remainder.
TIER_SHARES = (45, 20, 20)


def tier_budgets(total: int) -> list[int]:
    """Of a total clamped to 8000..16000."""
    total = min(16000, max(8000, total))
    parts = [total * s // 100 for s in TIER_SHARES]
    return [*parts, total - sum(parts)]


def _fold(items: Column, used: Column, fits, budget: int) -> Column:
    start = F.struct(used.cast("long").alias("used"), F.array(*[F.lit(0).cast("long")] * 5).alias("tier_used"), F.array().cast("array<bigint>").alias("picked"))

    def step(s: Column, x: Column) -> Column:
        ok = (s["used"] + x["cost"] <= budget) & fits(s, x)
        tiers = F.transform(s["tier_used"], lambda v, i: F.when(ok & (i == x["tier"]), v + x["cost"]).otherwise(v))
        return F.struct((s["used"] + F.when(ok, x["cost"]).otherwise(0)).cast("long").alias("used"), tiers.alias("tier_used"), F.when(ok, F.array_append(s["picked"], x["id"])).otherwise(s["picked"]).alias("picked"))

    return F.aggregate(items, start, step)


def select_context(candidates: DataFrame, group: str, total: int = 12000) -> DataFrame:
    """candidates (group, id, type, cost, score): per group the picked ids in order, and the context's metrics.

    Each tier is filled by falling score within its own budget and the total; then what is left competes for the rest by
    score, without tier budgets. Equal scores go by id.
    """
    budgets = tier_budgets(total)
    total = min(16000, max(8000, total))
    tier = lookup(F.col("type"), vocab.CANDIDATE_TIER, 4)
    item = F.struct(tier.alias("tier"), (-F.col("score")).alias("neg"), F.col("id").cast("long").alias("id"), F.col("cost").cast("long").alias("cost"))
    grouped = candidates.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    caps = F.array(F.lit(0), *map(F.lit, budgets))
    first = grouped.withColumn("_a", _fold(F.col("items"), F.lit(0), lambda s, x: F.get(s["tier_used"], x["tier"]) + x["cost"] <= F.get(caps, x["tier"]), total))
    rest = F.array_sort(F.transform(F.filter("items", lambda x: ~F.array_contains(F.col("_a.picked"), x["id"])), lambda x: F.struct(x["neg"].alias("neg"), x["tier"].alias("tier"), x["id"].alias("id"), x["cost"].alias("cost"))))
    second = first.withColumn("_b", _fold(rest, F.col("_a.used"), lambda s, x: F.lit(True), total))
    tokens = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    picked = F.concat("_a.picked", "_b.picked")
    used = F.col("_b.used")
    return second.select(group, picked.alias("picked"), F.size("items").alias("candidate_count"), F.size(picked).alias("selected_count"), tokens.alias("candidate_tokens"), used.alias("selected_tokens"), F.when(tokens > 0, F.floor(used / tokens * 10000 + 0.5) / 10000).otherwise(1.0).alias("selection_ratio"))


def pack_sections(sections: DataFrame, group: str, budget: int, reserve: int = 40) -> DataFrame:
    """Diff sections (group, id, path_class: logic, test, doc or lock, cost) packed greedily by class into half the budget."""
    room = budget // 2 - reserve
    priority = lookup(F.col("path_class"), {"logic": 1, "test": 2, "doc": 3, "lock": 4}, 4)
    item = F.struct(priority.alias("tier"), F.col("id").cast("long").alias("id"), F.col("cost").cast("long").alias("cost"))
    grouped = sections.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.withColumn("_a", _fold(F.col("items"), F.lit(0), lambda s, x: F.lit(True), room)).select(group, F.col("_a.picked").alias("picked"), F.col("_a.used").alias("used"), (F.size("items") - F.size("_a.picked")).alias("omitted"))

"""Reachability on commit graphs by a stored index, so that rounds don't go by generations.

First parents make a forest. Its subtree sizes come from an Euler tour whose list is ranked by pointer jumping; each commit's
largest child goes on its chain (heavy paths), so a way along first parents crosses a logarithmic number of chains. A commit
is then (chain, pos), pos counted from the chain's oldest commit; a chain's commits up to a position are all ancestors of
the one there. Edges that leave a chain are its hops. What a commit reaches is one position for each chain, found in
as many rounds as hops lie behind each other; all questions asked at once share them.

Commits are rows (oid, parent, nth, …), one for each parent, nth from 1, a root with a null parent; parents that aren't there
(of a shallow clone) end the history. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import store


def _jump(rows: DataFrame, key: list[str], to: list[str], added: tuple[str, ...], what: str) -> DataFrame:
    """Pointer jumping: rows (key, to, added) until no ``to`` is left, the added numbers summed along the way; rows without a
    pointer aren't joined again."""
    rows = store(rows, what)
    while rows.where(F.col(to[0]).isNotNull()).limit(1).count():
        ahead = rows.select(*(F.col(k).alias(t) for k, t in zip(key, to, strict=True)), *(F.col(t).alias(f"_{t}") for t in to), *(F.col(a).alias(f"_{a}") for a in added))
        moved = rows.where(F.col(to[0]).isNotNull()).join(ahead, to)
        moved = moved.select(*key, *(F.col(f"_{t}").alias(t) for t in to), *((F.col(a) + F.col(f"_{a}")).alias(a) for a in added))
        rows = store(rows.where(F.col(to[0]).isNull()).select(*moved.columns).unionAll(moved), what)
    return rows


def _sizes(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """(oid, size, depth) of every commit in the forest of first parents (oid, parent)."""
    of = Window.partitionBy("parent").orderBy("oid")
    beside = first.select("oid", "parent", F.lead("oid").over(of).alias("sibling"))
    child = first.groupBy(F.col("parent").alias("oid")).agg(F.min("oid").alias("child"))
    rows = nodes.select("oid").join(child, "oid", "left").join(beside, "oid", "left")
    down = rows.select("oid", F.lit(True).alias("down"), F.coalesce("child", "oid").alias("n_oid"), F.col("child").isNotNull().alias("n_down"), F.lit(1).cast("long").alias("steps"), F.lit(1).cast("long").alias("level"))
    up = rows.select("oid", F.lit(False).alias("down"), F.coalesce("sibling", "parent").alias("n_oid"), F.when(F.coalesce("sibling", "parent").isNotNull(), F.col("sibling").isNotNull()).alias("n_down"), F.lit(1).cast("long").alias("steps"), F.lit(-1).cast("long").alias("level"))
    ranked = _jump(down.unionAll(up), ["oid", "down"], ["n_oid", "n_down"], ("steps", "level"), "tour")
    mine = lambda c, d: F.max(F.when(F.col("down") == d, F.col(c)))
    return ranked.groupBy("oid").agg(((mine("steps", True) - mine("steps", False) + 1) / 2).cast("long").alias("size"), (-mine("level", True)).alias("depth"))


class CommitIndex:
    """Stored tables: nodes (oid, chain, pos, depth, at), hops (chain, pos, to_chain, to_pos), edges (oid, parent, nth)."""

    def __init__(self, commits: DataFrame, order: str = "time"):
        """``order``: the column by which the log is sorted, latest first; no commit may lie before its parents in it."""
        nodes = store(commits.groupBy("oid").agg(F.max(order).alias("at")), "commits")
        there = nodes.select(F.col("oid").alias("parent"))
        self.edges = edges = store(commits.select("oid", "parent", "nth").where("parent is not null").distinct().join(there, "parent", "left_semi").select("oid", "parent", "nth"), "edges")
        first = edges.where("nth = 1").select("oid", "parent")
        sizes = store(_sizes(nodes, first), "sizes")
        heavy = first.join(sizes, "oid").groupBy("parent").agg(F.max(F.struct("size", "oid"))["oid"].alias("oid"))
        # A chain's oldest commit is found by pointers along heavy edges; depths along them add up to the position.
        links = sizes.select("oid").join(heavy, "oid", "left").select("oid", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("oid").alias("last"))
        placed = self._starts(links)
        self.nodes = store(placed.join(sizes.select("oid", "depth"), "oid").join(nodes, "oid"), "nodes")
        at = self.nodes.select("oid", "chain", "pos")
        light = edges.join(heavy.withColumn("nth", F.lit(1)), ["oid", "parent", "nth"], "left_anti")
        hops = light.join(at, "oid").join(at.select(F.col("oid").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos")), "parent")
        self.hops = store(hops.select("chain", "pos", "to_chain", "to_pos"), "hops")

    @staticmethod
    def _starts(links: DataFrame) -> DataFrame:
        """(oid, chain, pos) of pointers (oid, to, pos): to is null at a chain's oldest commit."""
        rows = store(links.select("oid", "to", F.coalesce("to", "oid").alias("chain"), "pos"), "chains")
        while rows.where("to is not null").limit(1).count():
            ahead = rows.select(F.col("oid").alias("to"), F.col("to").alias("_to"), F.col("chain").alias("_chain"), F.col("pos").alias("_pos"))
            moved = rows.where("to is not null").join(ahead, "to").select("oid", F.col("_to").alias("to"), F.col("_chain").alias("chain"), (F.col("pos") + F.col("_pos")).alias("pos"))
            rows = store(rows.where("to is null").unionAll(moved), "chains")
        return rows.select("oid", "chain", "pos")

    def reach(self, starts: DataFrame, within: int | None = None) -> DataFrame:
        """(ref, chain, upto) of starts (ref, oid): on each chain the latest position reached. ``within``: hops are followed
        only from the latest so many commits of a chain."""
        fresh = starts.join(self.nodes, "oid").groupBy("ref", "chain").agg(F.max("pos").alias("upto")).withColumn("old", F.lit(-1).cast("long"))
        fresh = store(fresh, "reach")
        state = fresh.select("ref", "chain", "upto")
        while fresh.limit(1).count():
            near = (F.col("pos") <= F.col("upto")) & (F.col("pos") > F.col("old"))
            if within is not None:
                near &= F.col("pos") > F.col("upto") - within
            out = fresh.join(self.hops, "chain").where(near).groupBy("ref", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("new"))
            fresh = out.join(state, ["ref", "chain"], "left").select("ref", "chain", F.col("new").alias("upto"), F.coalesce("upto", F.lit(-1)).alias("old")).where("upto > old")
            fresh = store(fresh, "reach")
            state = store(state.unionAll(fresh.select("ref", "chain", "upto")).groupBy("ref", "chain").agg(F.max("upto").alias("upto")), "reached")
        return state

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """(ref, oid) reachable from starts (ref, oid), starts included."""
        return self.reach(starts).join(self.nodes, "chain").where("pos <= upto").select("ref", "oid")

    def common(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored (id, side, chain, upto) that the sides of pairs (id, a, b) reach, and (id, chain, upto) that both do."""
        starts = pairs.select(F.struct("id", F.lit(0).alias("side")).alias("ref"), F.col("a").alias("oid")).unionAll(pairs.select(F.struct("id", F.lit(1).alias("side")).alias("ref"), F.col("b").alias("oid")))
        state = self.reach(starts.distinct()).select(F.col("ref.id").alias("id"), F.col("ref.side").alias("side"), "chain", "upto")
        return state, store(state.groupBy("id", "chain").agg(F.count("*").alias("k"), F.min("upto").alias("upto")).where("k = 2"), "common")

    def best(self, common: DataFrame) -> DataFrame:
        """(id, oid) of common()'s commits without a child among them."""
        led = common.join(self.hops, "chain").where("pos <= upto").select("id", F.col("to_chain").alias("chain"), F.col("to_pos").alias("upto")).distinct()
        best = common.join(led, ["id", "chain", "upto"], "left_anti")
        return best.join(self.nodes, (best["chain"] == self.nodes["chain"]) & (best["upto"] == self.nodes["pos"])).select("id", "oid")

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """(id, oid): all best common ancestors of pairs (id, a, b). What both reach is closed under parents, so its best are
        those without a child in it."""
        return self.best(self.common(pairs)[1])

    def log(self, oid: str, depth: int = 100) -> DataFrame:
        """(oid, at) of the latest ``depth`` commits reachable from oid. A commit so far down its chain has as many after it, so
        neither it nor what lies behind it is read."""
        start = self.nodes.sparkSession.createDataFrame([("log", oid)], "ref string, oid string")
        seen = self.reach(start, depth).join(self.nodes, "chain").where((F.col("pos") <= F.col("upto")) & (F.col("pos") > F.col("upto") - depth))
        return seen.orderBy(F.desc("at"), F.desc("depth"), "oid").limit(depth).select("oid", "at")

    def back(self, starts: DataFrame) -> DataFrame:
        """(ref, oid) n steps along first parents from starts (ref, oid, n); refs whose line is shorter are left out."""
        left = store(starts.join(self.nodes, "oid").select("ref", "chain", "pos", F.col("n").cast("long").alias("n")), "back")
        found: DataFrame | None = None
        line = self.edges.where("nth = 1").join(self.nodes.select("oid", "chain", "pos").where("pos = 0"), "oid").select("chain", "parent")
        line = line.join(self.nodes.select(F.col("oid").alias("parent"), F.col("chain").alias("_chain"), F.col("pos").alias("_pos")), "parent").drop("parent")
        while True:
            here = left.where("n <= pos").select("ref", "chain", (F.col("pos") - F.col("n")).alias("pos")).join(self.nodes, ["chain", "pos"]).select("ref", "oid")
            found = here if found is None else found.unionAll(here)
            left = store(left.where("n > pos").join(line, "chain").select("ref", F.col("_chain").alias("chain"), F.col("_pos").alias("pos"), (F.col("n") - F.col("pos") - 1).alias("n")), "back")
            if not left.limit(1).count():
                return found

    def parent(self, starts: DataFrame) -> DataFrame:
        """(ref, oid) of the n-th parents of starts (ref, oid, n); n = 0 is the commit itself."""
        asked = starts.select("ref", "oid", F.col("n").alias("nth"))
        return asked.where("nth = 0").select("ref", "oid").unionAll(asked.join(self.edges, ["oid", "nth"]).select("ref", F.col("parent").alias("oid")))


# Questions about a history's end, without an index of all of it.

#: Rows of the first part of a history that is read, and how much larger each next one is.
FIRST, WIDER = 4096, 8


def _parts(commits: DataFrame, starts: DataFrame, order: str) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Growing parts of a history that have all commits from some time on to the latest start (oid), starts included, each with
    its edges (oid, parent) that lead out of it; at last the whole, with None.

    No commit lies before its parents in the order, so a part has all ways between its commits that the starts have.
    """
    at = F.col(order)
    span = commits.join(starts.select("oid").distinct(), "oid", "left_semi").agg(F.min(at), F.max(at)).first()
    if span[1] is not None:
        before = commits.where(at <= F.lit(span[1]))
        n = before.count()
        sizes = [s for s in (FIRST * WIDER**k for k in range(20)) if s * 2 < n]
        lows = before.agg(F.percentile_approx(at, F.array(*[F.lit(1 - s / n) for s in sizes]), F.lit(100_000))).first()[0] if sizes else []
        for low in lows:
            part = store(before.where(at >= F.lit(min(low, span[0]))), "part")
            yield part, part.where("parent is not null").join(part.select(F.col("oid").alias("parent")).distinct(), "parent", "left_anti").select("oid", "parent")
    yield commits, None


def merge_bases(commits: DataFrame, pairs: DataFrame, order: str = "time") -> DataFrame:
    """CommitIndex.merge_bases of as late a part of the history as tells them. A best common ancestor before the part is reached
    from both sides by ways that leave it at commits that aren't common; where a side has none, the part has all."""
    starts = pairs.select(F.col("a").alias("oid")).unionAll(pairs.select("b"))
    for part, out in _parts(commits, starts, order):
        index = CommitIndex(part, order)
        state, common = index.common(pairs)
        if out is not None:
            left = out.join(index.nodes, "oid").select("chain", "pos").join(state, "chain").where("pos <= upto").select("id", "side", "chain", "pos")
            left = left.join(common.select("id", "chain", F.col("upto").alias("_both")), ["id", "chain"], "left").where("_both is null or pos > _both")
            if left.groupBy("id").agg(F.countDistinct("side").alias("k")).where("k = 2").limit(1).count():
                continue
        return index.best(common)
    raise AssertionError("the last part is the whole")


def log(commits: DataFrame, oid: str, depth: int = 100, order: str = "time") -> DataFrame:
    """CommitIndex.log of as late a part of the history as has that many commits, no two of one time: among those the depth in
    the whole history would tell."""
    start = commits.sparkSession.createDataFrame([(oid,)], "oid string")
    for part, out in _parts(commits, start, order):
        index = CommitIndex(part, order)
        if out is not None:
            got = index.log(oid, depth + 1).agg(F.count("*"), F.countDistinct("at")).first()
            if got[0] <= depth or got[1] < got[0]:
                continue
        return index.log(oid, depth)
    raise AssertionError("the last part is the whole")

"""Directed multigraphs: reciprocal edges, one-hop neighbours by proximity, dependency classes, cycles and their paths, merge bases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.scoring import lookup
from ..plans.shared import store
from .history import CommitIndex


def reciprocal(edges: DataFrame) -> DataFrame:
    """Every edge (src, dst, kind) and its mirror."""
    mirror = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), lookup(F.col("kind"), vocab.EDGE_MIRROR).alias("kind"))
    return edges.select("src", "dst", "kind").unionAll(mirror)


def proximity(same_dir: Column, same_package: Column, is_test: Column) -> Column:
    """4 for tests, 1 in the same directory, 2 in the same package, 3 elsewhere."""
    return F.when(is_test, 4).when(same_dir, 1).when(same_package, 2).otherwise(3)


def nearest(callers: DataFrame, key: str, score: str, order: list[str], limit: int = 10) -> DataFrame:
    """Up to ``limit`` callers of each key, nearest first. Rank filters of this form are cut to a limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(score, *order)
    return callers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def dependents(callers: DataFrame, importers: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Number of dependents of each key: callers up to ``limit``, and all importers."""
    a = callers.groupBy(key).agg(F.least(F.lit(limit), F.count("*")).alias("n"))
    b = importers.groupBy(key).agg(F.count("*").alias("n"))
    return a.unionAll(b).groupBy(key).agg(F.sum("n").alias("dependents"))


def classify_imports(imports: DataFrame, files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(src, specifier) to (src, dst, is_external, is_workspace): a workspace package, a known file, or an external package."""
    package = text.package_name(F.col("specifier"))
    rows = imports.withColumn("package", package)
    known = files.select(F.col("path").alias("specifier"), F.lit(True).alias("_file"))
    own = workspaces.select(F.col("name").alias("package"), F.lit(True).alias("_own"))
    joined = rows.join(known, "specifier", "left").join(own, "package", "left")
    external = F.col("_file").isNull() & F.col("_own").isNull()
    return joined.select("src", F.when(external, F.col("package")).otherwise(F.col("specifier")).alias("dst"), external.alias("is_external"), F.col("_own").isNotNull().alias("is_workspace")).distinct()


_UP = ["up_src", "up_first"]


def _raked(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (src, dst, …) whose src has an incoming and whose dst has an outgoing edge, and their number."""
    ends = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    kept = store(edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select(*edges.columns), "cycle")
    return kept, kept.count()


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Ways through nodes of one incoming and one outgoing edge, each as one edge; None if there are no such nodes.

    Edges are (src, first, dst, len): a way of len edges from src to dst whose first step leads to ``first``; (src, first) tells it
    from others at every stage. Also gives each edge's place: (src, first, up_src, up_first, off), off edges behind the start of
    the new edge (up_src, up_first). Of nodes in a row those of the least hash stay, so rings keep a node and ways between
    two that stay are short; a row shrinks by half at least.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.min("src").alias("before"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.min("dst").alias("after"))
    least = (F.xxhash64("node") <= F.xxhash64("before")) & (F.xxhash64("node") <= F.xxhash64("after"))
    inner = store(ins.where("i = 1").join(outs.where("o = 1"), "node").where(~least).select("node"), "inner")
    if not inner.limit(1).count():
        return None
    behind = inner.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("to_src"), F.col("first").alias("to_first"), F.col("len").alias("off")), "node")
    rows = edges.join(behind.withColumnRenamed("node", "src"), "src", "left")
    rows = rows.select("src", "first", "dst", "len", "to_src", "to_first", F.coalesce("to_src", "src").alias("up_src"), F.when(F.col("to_src").isNull(), F.col("first")).otherwise(F.col("to_first")).alias("up_first"), F.coalesce("off", F.lit(0).cast("long")).alias("off"))
    rows = store(rows, "places")
    while rows.where("to_src is not null").limit(1).count():
        ahead = rows.select(F.col("src").alias("to_src"), F.col("first").alias("to_first"), F.col("to_src").alias("_s"), F.col("to_first").alias("_f"), *(F.col(c).alias(f"_{c}") for c in _UP), F.col("off").alias("_off"))
        moved = rows.where("to_src is not null").join(ahead, ["to_src", "to_first"]).select("src", "first", "dst", "len", F.col("_s").alias("to_src"), F.col("_f").alias("to_first"), *(F.col(f"_{c}").alias(c) for c in _UP), (F.col("off") + F.col("_off")).alias("off"))
        rows = store(rows.where("to_src is null").unionAll(moved), "places")
    whole = rows.groupBy(*_UP).agg(F.max_by("dst", "off").alias("dst"), F.sum("len").alias("len"))
    return store(whole.select(F.col("up_src").alias("src"), F.col("up_first").alias("first"), "dst", "len"), "cycle"), rows.select("src", "first", *_UP, "off")


def _colored(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (src, first, dst, len), the largest number that reaches a node being its colour: edges inside the strong components
    that hold a colour's own node, with ``component``, and the edges that are left inside colours."""
    pairs = left.select("src", "dst").distinct()
    color = store(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("color"), F.lit(True).alias("moved")), "color")
    while color.where("moved").limit(1).count():
        near = pairs.join(color.where("moved").select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("_c"))
        color = store(color.select("node", "color").join(near, "node", "left").select("node", F.greatest("color", "_c").alias("color"), F.coalesce(F.col("_c") > F.col("color"), F.lit(False)).alias("moved")), "color")
    tint = color.select("node", "color")
    inside = left.join(tint.select(F.col("node").alias("src"), F.col("color").alias("_a")), "src").join(tint.select(F.col("node").alias("dst"), F.col("color").alias("_b")), "dst")
    inside = store(inside.where("_a = _b").select(*left.columns, F.col("_a").alias("component")), "inside")
    parts = [store(tint.where("node = color").select("node"), "back")]
    while True:  # colours don't share nodes
        seen = reduce(DataFrame.unionAll, parts)
        step = inside.join(parts[-1].withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti")
        step_back = store(step, "back")
        if not step_back.limit(1).count():
            break
        parts = [store(seen.unionAll(step_back), "back-all"), step_back] if len(parts) > 16 else [*parts, step_back]
    done = store(reduce(DataFrame.unionAll, parts).distinct(), "components")
    src, dst = done.withColumnRenamed("node", "src"), done.withColumnRenamed("node", "dst")
    rest = store(inside.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*left.columns), "cycle")
    return inside.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "first", "component"), rest


def _unit(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) as ways of one step."""
    return edges.select("src", "dst").where("src <> dst").distinct().select("src", F.col("dst").alias("first"), "dst", F.lit(1).cast("long").alias("len"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (src, dst) in strong components of two nodes or more; a component goes by its
    largest node.

    Dead ends are raked off while that takes a tenth of the edges each time; then ways without branches become single edges, so
    that the next rake takes whole ways and long ones cost rounds by the logarithm of their size; what branches both ways is coloured forward and searched backward, until no edge is left. The
    edges found, each a way, are then taken apart in the opposite order.
    """
    left = store(_unit(edges), "cycle")
    n, steps = left.count(), []
    while n:
        before = n
        left, n = _raked(left)
        if not n or 10 * n <= 9 * before:
            continue
        if (made := _compressed(left)) is not None:
            whole, places = made
            loops = store(whole.where("src = dst").select("src", "first"), "loops")
            left = whole.where("src <> dst")
            n = left.count()
            steps += [("places", places), ("loops", loops)]
        if 10 * n > 9 * before:
            found, left = _colored(left)
            steps.append(("found", found))
            n = left.count()
    kept = store(edges.select("src", F.col("dst").alias("first"), F.col("src").alias("component")).limit(0), "kept")
    for kind, rows in reversed(steps):
        if kind == "places":
            kept = rows.join(kept.select(F.col("src").alias("up_src"), F.col("first").alias("up_first"), "component"), _UP).select("src", "first", "component")
        elif kind == "loops":
            kept = kept.unionAll(rows.join(kept.select("src", "component").distinct(), "src", "left").select("src", "first", F.coalesce("component", "src").alias("component")))
        else:
            kept = kept.unionAll(rows)
        kept = store(kept, "kept")
    nodes = kept.select(F.col("src").alias("node"), F.col("component").alias("_c")).distinct()
    return nodes.join(nodes.groupBy("_c").agg(F.max("node").alias("component")), "_c").select("node", "component")


def in_cycle(edges: DataFrame) -> DataFrame:
    """Nodes of (src, dst) that lie on a cycle: of strong components of several nodes, and with an edge to themselves."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    return strong_components(edges).select("node").unionAll(loops).distinct()


def edge_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst, cycle): for every edge (src, dst) on a cycle a shortest cycle through it, as its nodes from the smallest on,
    without the first again at the end; of several shortest, the one whose way back from dst is least, node by node.

    Inside strong components, ways without branches are made single edges: all edges of such a way have the same cycle. All
    ways back from the ends of these edges are then searched for at once: each round settles for each end (root) the nodes
    at its least distance that is left, with their least ways. A root whose incoming edges all have their cycle drops out, so
    rounds and rows go by the branchings on cycles, not by the components' size.
    """
    parts = strong_components(edges)
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    inside = store(_unit(edges).join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "first", "dst", "len"), "inside")
    loops = edges.where("src = dst").select("src", "dst", F.array("src").alias("cycle")).distinct()
    places = inside.select("src", "first", F.col("src").alias("up_src"), F.col("first").alias("up_first"), F.lit(0).cast("long").alias("off"))
    n, before = inside.count(), 0
    while n != before and (made := _compressed(inside)) is not None:
        inside, more = made
        up = more.select(F.col("src").alias("up_src"), F.col("first").alias("up_first"), *(F.col(c).alias(f"_{c}") for c in _UP), F.col("off").alias("_off"))
        places = store(places.join(up, _UP).select("src", "first", *(F.col(f"_{c}").alias(c) for c in _UP), (F.col("off") + F.col("_off")).alias("off")), "places")
        n, before = inside.count(), n
    nodes = places.groupBy(F.col("up_src").alias("src"), F.col("up_first").alias("first")).agg(F.array_sort(F.collect_list(F.struct("off", "src"))).alias("nodes"))
    ways = store(inside.join(nodes, ["src", "first"]).select("src", "first", "dst", "len", F.transform("nodes", lambda x: x["src"]).alias("nodes")), "ways")
    open_ = ways.select(F.col("dst").alias("root"), F.col("src").alias("node"), "first")
    pending = store(open_.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("dist"), F.array("root").alias("way")), "pending")
    seen, found = pending.limit(0).select("root", "node"), None
    while pending.limit(1).count():
        least = pending.groupBy("root").agg(F.min("dist").alias("_least"))
        front = store(pending.join(least, "root").withColumn("_now", F.col("dist") == F.col("_least")).drop("_least"), "front")
        late, front = (front.where(c).drop("_now") for c in ("not _now", "_now"))
        closed = store(open_.join(front, ["root", "node"]).select("root", "node", "first", "way"), "closed")
        found = closed if found is None else found.unionAll(closed)
        open_ = store(open_.join(closed.select("root", "node", "first"), ["root", "node", "first"], "left_anti"), "open")
        roots = open_.select("root").distinct()
        seen = store(seen.unionAll(front.select("root", "node")).join(roots, "root", "left_semi"), "seen")
        step = front.join(roots, "root", "left_semi").join(ways.select(F.col("src").alias("node"), F.col("dst").alias("to"), "len", "nodes"), "node")
        step = step.select("root", F.col("to").alias("node"), (F.col("dist") + F.col("len")).alias("dist"), F.concat("way", F.slice("nodes", F.lit(2), F.size("nodes")), F.array("to")).alias("way"))
        step = step.unionAll(late.join(roots, "root", "left_semi")).join(seen, ["root", "node"], "left_anti")
        pending = store(step.groupBy("root", "node").agg(F.min(F.struct("dist", "way")).alias("_m")).select("root", "node", "_m.*"), "pending")
    if found is None:
        return loops
    # The way back ends at the first of the edge's own nodes, and begins at its last.
    whole = found.withColumnRenamed("node", "src").join(ways.select("src", "first", "nodes"), ["src", "first"]).select(F.col("src").alias("up_src"), F.col("first").alias("up_first"), F.concat(F.slice("way", F.lit(1), F.size("way") - 1), "nodes").alias("cycle"))
    least = F.array_position("cycle", F.array_min("cycle")).cast("int")
    turned = F.concat(F.slice("cycle", least, F.size("cycle")), F.slice("cycle", F.lit(1), least - 1))
    whole = whole.select(*_UP, turned.alias("cycle"))
    return loops.unionAll(places.join(whole, _UP).select("src", F.col("first").alias("dst"), "cycle"))


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length): the shortest cycles through the edges of (src, dst), each once."""
    return edge_cycles(edges).select("cycle").distinct().select("cycle", F.size("cycle").alias("length"))


def merge_base(commits: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(oid, generation): the best common ancestor of highest generation of the refs a and b (each one row of oid); generation is
    a commits column. For all best ones, or many pairs, see history.CommitIndex."""
    order = Window.partitionBy("oid").orderBy("parent")
    rows = commits if "nth" in commits.columns else commits.withColumn("nth", F.row_number().over(order))
    pairs = a.select(F.lit(1).alias("id"), F.col("oid").alias("a")).crossJoin(b.select(F.col("oid").alias("b")))  # a row each
    best = CommitIndex(rows, "generation").merge_bases(pairs)
    return best.join(commits.select("oid", "generation").distinct(), "oid").orderBy(F.desc("generation"), "oid").limit(1).select("oid", "generation")

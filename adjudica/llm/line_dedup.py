"""Operator 7, line dedup by a segment-partition edit join. DataFrame functions only.

Two lines are linked if their edit distance is at most one for each ``per`` characters of the shorter, and ``edits`` at
most: with 10 and 2, lines of 20 characters and more may differ by two edits, of 10 to 19 by one, shorter ones by none.
Equal lines are one text, so the join runs over distinct texts. A text of length L is cut into edits + 1 even segments;
each is indexed under (L, segment's number, segment). If two texts are within the distance, one segment of the shorter
stands unchanged in the longer, at a place that the number of edits before and after it limits. A text thus probes, for
each length L from its own down to its own less edits, the few substrings that the multi-match-aware rule leaves.

One pass finds the keys that two texts share; rows of all others go no further. Index keys of more than ``crowded`` texts
(many variants of one line) aren't joined blindly: their rows carry the text,
and the distance is tested inside the join, so only links leave it. A signature of character counts spares most tests.
All candidates are verified by a banded bit-parallel edit distance, written as a fold over the characters between the
pair's common prefix and suffix.

Links make classes (min-label propagation). In each class the first line by (doc_id, place) is kept.

Defined results: null and empty texts hold one empty line, whose class is all empty lines; empty lines are always kept.
Lines of a null doc_id sort first. Repeated rows are lines of their own; ties of doc_id go by row number, then place. Extra
columns aren't read. A line of any length is one text; only pairs that share a segment are held together. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store
from .near_dedup import components

#: Prefix lengths that are tried for a pair, the largest first; their sum bounds what is trimmed, not what is compared.
_STEPS = [1 << k for k in range(20, -1, -1)]


def _key(text: Column, length: Column, edits: int, i: Column, shift: Column) -> Column:
    """The key of segment i (from 0) of texts of this length, read from the text with its start shifted. Segments are even,
    longer ones last."""
    n = edits + 1
    short = (length / n).cast("int")
    over = F.greatest(F.lit(0), i - (n - length % n))  # so many longer segments are before this one
    size = short + F.when(i >= n - length % n, 1).otherwise(0)
    return F.xxhash64(length, i, F.substring(text, (short * i + over + shift + 1).cast("int"), size.cast("int")))


def _rows(table: list[tuple[int, ...]], *names: str) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in table]))


def index_keys(texts: DataFrame, edits: int) -> DataFrame:
    """id and key: a row for each segment of texts (id, line, len). Rows of a small table are exploded first, so that one
    short expression makes all keys."""
    rows = texts.select("id", "line", "len", _rows([(i,) for i in range(edits + 1)], "i").alias("p"))
    return rows.select("id", _key(F.col("line"), F.col("len"), edits, F.col("p.i"), F.lit(0)).alias("key"))


def probe_keys(texts: DataFrame, edits: int) -> DataFrame:
    """id, key and less: the keys under which a text asks for texts that are shorter (less) or as long as itself, but for its
    own segments, whose rows the index has already."""
    table = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            after = edits - i
            for shift in range(max(-i, less - after), min(i, less + after) + 1):
                if less or shift:
                    table.append((less, i, shift))
    rows = texts.select("id", "line", "len", _rows(table, "less", "i", "shift").alias("p"))
    less = F.col("p.less")
    return rows.select("id", _key(F.col("line"), F.col("len") - less, edits, F.col("p.i"), F.col("p.shift")).alias("key"), (less > 0).alias("less"))


#: Characters that a line's signature counts, and the bits of each count.
COUNTED, COUNT_BITS = "eatinosr", 6


def signature(text: Column) -> Column:
    """The counts of a few characters, modulo 2**COUNT_BITS, in one word."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(COUNTED):
        n = (F.length(text) - F.length(F.replace(text, F.lit(c)))).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
        out = out.bitwiseOR(F.shiftleft(n.cast("long"), k * COUNT_BITS))
    return out


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether two signatures allow the distance: an edit changes two counts by one at most."""
    mask = (1 << COUNT_BITS) - 1
    total = F.lit(0)
    for k in range(len(COUNTED)):
        d = (F.shiftright(a, k * COUNT_BITS) - F.shiftright(b, k * COUNT_BITS)).bitwiseAND(F.lit(mask))
        total = total + F.least(d, F.lit(mask + 1) - d)
    return total <= 2 * edits


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    most = F.least(F.length(a), F.length(b))
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substring(a, 1, n + s) == F.substring(b, 1, n + s)), n + s).otherwise(n))


def within(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of a and b (a not longer, by edits at most), or a larger number if it is over edits.

    Bit k of a word of 2 * edits + 2 bits is row i + edits - (bits - 1) + k of column i. The distance is followed down
    the band's lowest diagonal to the last row, and then along it.
    """
    bits = 2 * edits + 2
    full, top = (1 << bits) - 1, bits - 1
    m = F.size(a)

    def step(s: Column, i: Column) -> Column:
        match = F.lit(0)
        for k in range(bits):
            match = match.bitwiseOR(F.when(F.get(a, i + (edits - top + k)) == F.get(b, i), 1 << k).otherwise(0))

        def words(x: Column) -> Column:
            vp, vn, pm = x["vp"], x["vn"], x["pm"]
            return ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full))

        with_match = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("pm"))
        with_zero = F.transform(F.array(with_match), lambda x: F.struct(x["vp"].alias("vp"), x["vn"].alias("vn"), x["d"].alias("d"), words(x).alias("d0")))
        flip = lambda x: x.bitwiseXOR(F.lit(full))
        with_h = F.transform(with_zero, lambda x: F.struct(x["d"].alias("d"), x["d0"].alias("d0"), x["vn"].bitwiseOR(flip(x["d0"].bitwiseOR(x["vp"]))).alias("hp"), x["d0"].bitwiseAND(x["vp"]).alias("hn")))

        def last(x: Column) -> Column:
            low = F.shiftright(x["d0"], 1)
            at = F.greatest(F.lit(0), F.lit(top - 1) - (i - (m - edits)))  # the last row's bit, once the band has reached it
            bit = lambda w: F.getbit(w, at).cast("int")
            along = bit(x["hp"]) - bit(x["hn"])
            down = F.lit(1) - F.shiftright(x["d0"], top)
            return F.struct(
                x["hn"].bitwiseOR(flip(low.bitwiseOR(x["hp"]))).alias("vp"),
                low.bitwiseAND(x["hp"]).alias("vn"),
                (x["d"] + F.when(i < m - edits, down).otherwise(along)).alias("d"),
            )

        return F.transform(with_h, last)[0]

    start = F.struct(F.lit(full ^ ((1 << (bits - edits - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda s: s["d"])


def distance(a: Column, b: Column, edits: int) -> Column:
    """within() of the parts between common prefix and suffix. A few equal characters in front keep both longer than edits."""
    front = "\u0001" * (edits + 1)

    def middle(x: Column) -> Column:
        size = lambda t: F.greatest(F.length(t) - x["p"] - x["s"], F.lit(0))
        return F.struct(*[F.split(F.concat(F.lit(front), F.substring(t, x["p"] + 1, size(t))), "").alias(n) for t, n in ((a, "a"), (b, "b"))])

    def suffix(x: Column) -> Column:
        rest = lambda t: F.reverse(F.substring(t, x["p"] + 1, F.length(t)))
        return F.struct(x["p"].alias("p"), _common(rest(a), rest(b)).alias("s"))

    cut = F.transform(F.transform(F.transform(F.array(_common(a, b)), lambda p: F.struct(p.alias("p"))), suffix), middle)
    return F.transform(cut, lambda x: within(x["a"], x["b"], edits))[0]


def lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, place and line of every line."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("_lines"))
    return rows.select("row", "doc_id", F.posexplode("_lines").alias("place", "line"))


def allowed(length: Column, edits: int, per: int) -> Column:
    """Edits by which a pair may differ whose shorter text has this length: one for each ``per`` characters, ``edits`` at most."""
    return F.least(F.lit(edits), F.floor(length / per)).cast("int")


def long_enough(texts: DataFrame, edits: int, per: int) -> DataFrame:
    """id, line and len of the texts (id, line) that are long enough for an edit."""
    return texts.where(F.length("line") >= max(per, edits + 1)).select("id", "line", F.length("line").alias("len"))


def links(spark: SparkSession, long: DataFrame, edits: int = 2, per: int = 10, crowded: int = 16, scope: str = "op") -> DataFrame:
    """Pairs (a, b) of ids of texts (long_enough(), all different) within the distance that their length allows, each once."""
    index = index_keys(long, edits)
    counts = index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    # Rows whose key meets another text: of the index where several texts have the key, of the probes where any has.
    own = index.join(counts.where("n > 1"), "key").select("key", "id", "n", "low", F.lit(False).alias("less"), F.lit(True).alias("own"))
    ask = probe_keys(long, edits).join(counts, "key").select("key", "id", "n", "low", "less", F.lit(False).alias("own"))
    met = store(spark, own.unionAll(ask), "met", scope)
    held = met.where("own").select("key", "id", "n").unionAll(met.where("n = 1").select("key", F.col("low").alias("id"), "n").distinct())
    named = met.select("id").unionAll(held.select("id")).distinct()
    some = store(spark, long.join(named, "id", "left_semi").select("id", "line", signature(F.col("line")).alias("sig")), "named", scope)

    def sides(few: bool) -> tuple[DataFrame, DataFrame]:
        at = F.col("n") <= crowded if few else F.col("n") > crowded
        with_text = lambda df, x: df.where(at).join(some, "id").withColumnsRenamed({"id": x, "sig": f"s{x}", "line": f"l{x}"}).drop("n")
        x, y = with_text(held, "a"), with_text(met.select("key", "id", "n", "less"), "b").withColumnRenamed("key", "_key")
        return (x.drop("la"), y.drop("lb")) if few else (x, y)

    right = (F.col("key") == F.col("_key")) & (F.col("a") != F.col("b")) & (F.col("less") | (F.col("a") < F.col("b"))) & may_be_near(F.col("sa"), F.col("sb"), edits)
    (x, y), (hx, hy) = sides(True), sides(False)
    cold = x.join(y, right).select("a", "b")
    # Hot keys: rows carry their texts, and the join's own condition is the distance.
    hot = hx.join(hy, right & (F.levenshtein("la", "lb", edits) >= 0)).select("a", "b")
    pairs = store(spark, cold.unionAll(hot).distinct(), "pairs", scope)

    one = some.select(F.col("id").alias("a"), F.col("line").alias("la"))
    two = some.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    most = allowed(F.least(F.length("la"), F.length("lb")), edits, per)
    return pairs.join(one, "a").join(two, "b").where(distance(F.col("la"), F.col("lb"), edits) <= most).select("a", "b")


def near_lines(spark: SparkSession, docs: DataFrame, edits: int = 2, per: int = 10, crowded: int = 16, scope: str = "op") -> DataFrame:
    """row, doc_id, place, class_id (hex digest of a text of the class), n_links (other texts within the distance), kept."""
    all_lines = lines(docs.select("doc_id", "text"))
    texts = all_lines.groupBy("line").agg(F.count("*").alias("n"))
    texts = store(spark, texts.select(F.monotonically_increasing_id().alias("id"), F.md5("line").alias("digest"), "n", "line"), "texts", scope)
    found = links(spark, long_enough(texts.select("id", "line"), edits, per), edits, per, crowded, scope)
    digest = texts.select("id", "digest")
    found = found.join(digest.select(F.col("id").alias("a"), F.col("digest").alias("da")), "a").join(digest.select(F.col("id").alias("b"), F.col("digest").alias("db")), "b")
    found = store(spark, found.select(F.col("da").alias("a"), F.col("db").alias("b")), "links", scope)
    label = components(spark, found, scope).select(F.col("id").alias("digest"), F.col("label").alias("class_id"))
    degree = found.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
    # Only lines that are repeated or linked can have a line before them in their class; empty ones are always kept.
    shared = label.join(degree, "digest").unionByName(texts.where("n > 1 and line <> ''").join(label, "digest", "left_anti").select("digest", F.col("digest").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    placed = all_lines.select("row", "doc_id", "place", F.md5("line").alias("digest")).join(shared, "digest", "left")
    placed = store(spark, placed.select("row", "doc_id", "place", "digest", "class_id", "n_links"), "placed", scope)
    several = placed.where("class_id is not null")
    first = several.groupBy("class_id").agg(F.min(F.struct("doc_id", "row", "place")).alias("f")).select("f.row", "f.place", F.lit(True).alias("_first"))
    kept = several.join(first, ["row", "place"], "left").select("row", "doc_id", "place", "class_id", "n_links", F.coalesce("_first", F.lit(False)).alias("kept"))
    alone = placed.where("class_id is null").select("row", "doc_id", "place", F.col("digest").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return alone.unionByName(kept)


def digest(near: DataFrame) -> DataFrame:
    """One row for each document: lines, kept lines, linked lines, links, and the digest of its lines' classes in order."""
    own = F.sort_array(F.collect_list(F.struct("place", "class_id")))
    out = near.groupBy("row", "doc_id").agg(F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), F.count_if(F.col("n_links") > 0).alias("n_linked"), F.sum("n_links").alias("n_links"), own.alias("_c"))
    return out.select("doc_id", "n_lines", "n_kept", "n_linked", "n_links", F.md5(F.array_join(F.transform("_c", lambda x: x["class_id"]), ",")).alias("classes"))

"""Operator 10, near duplicates by SuperMinHash.

Every document becomes the set of its distinct word shingles (64-bit hashes). Documents with equal sets form a class,
and its smallest id goes on alone. SuperMinHash gives each element one pseudo-random permutation of the registers; in
step j an element offers register p(j) the value j + u, so values of later steps are larger and a document stops as
soon as all its registers hold values of earlier steps. Bands of registers make buckets.

Rows are never paired within a bucket. First each class is compared with one member of its buckets: the likeliest of
their most popular members (those that meet most others in all their buckets, as the origin of a group of copies does)
and smallest members. Links found make components by union-find as a distributed min-label propagation with pointer
jumping. Then, in buckets that still hold several components, the members outside the largest one meet the members of
other components. Members of the buckets with one largest component meet in blocks of ``BLOCK`` documents: a pair of
blocks is first a row of signatures, without texts; the documents that its estimates leave then stream by with their texts,
and at most one link for each two components leaves it. Estimates only spare comparisons that are five standard errors or
more below the threshold; every comparison that counts is made on full shingle sets.

Defined results: null or empty text, or text without words, has an empty set, 0 shingles and its own id as component.
Text of fewer words than a shingle has one shingle, the whole sequence. Rows are judged each by its own text, also where
they share an id; the component's id is its smallest one that isn't null, and null if there is none. Rows with a null id
aren't kept. Equal shares go to the larger class number. Extra columns aren't read. A very long text is hashed in pieces;
its shingle set is held in one worker. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import common
from .common import SLICE_BYTES, batch_rows, batches, slices, store, task, utf8

BANDS, ROWS = 24, 4
#: Registers of a signature; the first BANDS * ROWS make the bands, all serve the estimate.
REGISTERS = 256
#: Members of a bucket that are compared with each other at once, and their shingles, in expectation.
BLOCK, BLOCK_SHINGLES = 64, 400_000
#: Tiles that a worker is given at once.
TILES = 256
#: Parts into which the rows of one crowded bucket are dealt for a join.
SALTS = 16
#: Elements whose permutations are held at once.
ELEMENTS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash of each word, in order. Words are hashed as whole strings, so that no rule of letters
    makes different ones alike."""
    each = [common.word_hashes(t.lower()) for t in texts]
    return np.repeat(np.arange(len(texts)), [len(h) for h in each]), np.concatenate([np.zeros(0, np.uint64), *each])


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles, sorted within each text, and the end of each text's part."""
    of, h = word_hashes(texts)
    n = len(texts)
    count = np.bincount(of, minlength=n)
    first = np.cumsum(count) - count
    acc = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for i in range(words):
        acc = mix(acc * _STEP + h[i : i + len(acc)])
    whole = of[: len(acc)] == of[words - 1 :][: len(acc)] if len(acc) else np.zeros(0, bool)
    keep, owner = acc[whole], of[: len(acc)][whole]
    short = np.flatnonzero((count > 0) & (count < words))
    single = np.zeros(len(short), np.uint64)
    for k, d in enumerate(short):
        x = np.uint64([count[d]])
        for w in h[first[d] : first[d] + count[d]]:
            x = mix(x * _STEP + w)
        single[k] = x[0]
    per = np.bincount(owner, minlength=n)
    per[short] = 1
    out = np.empty(per.sum(), np.uint64)
    end = np.cumsum(per)
    place = np.ones(len(out), bool)
    place[end[short] - 1] = False
    out[place] = keep
    out[end[short] - 1] = single
    for a, b in zip(end - per, end, strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[(end - per)[per > 0]] = True
    return out[fresh], np.cumsum(np.add.reduceat(np.append(fresh, False).astype(np.int64), np.minimum(end - per, len(out))) * (per > 0))


def superminhash(elements: np.ndarray, end: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers, (texts, m): the step in the upper and the random part in the lower 32 bits.

    A register is a minimum over the elements, so a very large set is done in parts.
    """
    if len(end) == 1 and len(elements) > ELEMENTS:
        parts = [superminhash(elements[a : a + ELEMENTS], np.array([min(ELEMENTS, len(elements) - a)]), m) for a in range(0, len(elements), ELEMENTS)]
        return np.minimum.reduce(parts)
    n = len(end)
    size = np.diff(end, prepend=0)
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    of = np.repeat(np.arange(n), size)
    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    at = np.arange(len(elements))
    for j in range(m):
        if not len(at):
            break
        r = mix(elements[at] + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        reg = order[at, k]
        order[at, k] = order[at, j]
        np.minimum.at(best, of[at] * m + reg, np.uint64(j << 32) | (r & np.uint64(0xFFFFFFFF)))
        open_ = best.reshape(n, m).max(1) >= np.uint64((j + 1) << 32)
        at = at[open_[of[at]]]
    return best.reshape(n, m)


def bands(registers: np.ndarray) -> np.ndarray:
    """A bucket number for each band, (texts, BANDS)."""
    parts = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        h = mix(h * _STEP + parts[:, :, i])
    return h.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null for an empty set), buckets, registers (their lowest bytes)."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            ids, hashes, texts = batch.column("doc_id"), batch.column("text_hash"), utf8(batch.column("text"))
            for a, b in slices(texts, SLICE_BYTES // 2):
                el, end = shingle_sets(texts[a:b], words)
                size = np.diff(end, prepend=0)
                keys = [xxhash.xxh3_128_digest(el[e - s : e].tobytes()) if s else None for e, s in zip(end, size, strict=True)]
                reg = superminhash(el, end)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(bands(reg).reshape(-1)))
                low = [x.tobytes() for x in reg.astype(np.uint8)]
                columns = [ids.slice(a, b - a).cast(pa.int64()), hashes.slice(a, b - a), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), buckets, pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "set_key", "buckets", "registers"])

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, buckets array<long>, registers binary")


def _bytes(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the share of registers that agree."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            share = (_bytes(batch.column("_ra").to_pylist()) == _bytes(batch.column("_rb").to_pylist())).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"])

    one = classes.select(F.col("id").alias("a"), F.col("registers").alias("_ra"))
    two = classes.select(F.col("id").alias("b"), F.col("registers").alias("_rb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_ra", "_rb").mapInArrow(run, "a long, b long, share double")


def _agree(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets satisfy 100 * intersection >= percent * union."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def tiles(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """main, one, two and, of each, ids, parts and registers: the pairs of blocks in which components are to be compared.

    Blocks are dealt by a hash of the id, of ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles in expectation; texts stay
    out of them. Keys of the joins are salted or name a block, so no crowded bucket is a key of its own.
    """
    rows = open_.select("main", "id", "part").distinct().join(classes.select("id", "n_shingles", "registers"), "id")
    many = rows.groupBy("main").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    spread = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    full = rows.withColumn("salt", salt).join(spread, ["main", "salt"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), "blocks"))
    member = F.collect_list(F.struct("id", "part", "registers"))
    held = full.groupBy("main", F.col("block").alias("two")).agg(member.alias("y"))
    minor = full.where("part <> main").groupBy("main", F.col("block").alias("one"), "blocks").agg(member.alias("x"))
    asked = minor.withColumn("two", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in ("x", "y") for name in ("id", "part", "registers")]
    return asked.join(held, ["main", "two"]).select("main", "one", "two", *lists)


def mates(tiled: DataFrame, least: float) -> DataFrame:
    """main, one, two, id, part, mates: the members of a tile that may be near members of other components. Each such pair
    is listed once, as a mate of one of the two."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            keys = [batch.column(c).to_pylist() for c in ("main", "one", "two")]
            out: list[list] = [[] for _ in range(6)]
            sides = {}
            for side in ("x", "y"):
                lists = [batch.column(f"{side}_{c}") for c in ("id", "part", "registers")]
                sides[side] = [*(x.flatten().to_numpy(zero_copy_only=False) for x in lists[:2]), lists[2].flatten(), np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])]
            for k in range(batch.num_rows):
                (ix, px, rx), (iy, py, ry) = ([v[e[k] : e[k + 1]] for v in lists] for *lists, e in (sides["x"], sides["y"]))
                x, y = _bytes(rx.to_pylist()), _bytes(ry.to_pylist())
                found: dict[int, list[int]] = {}
                part = {}
                for i in range(len(ix)):
                    at = np.flatnonzero((py != px[i]) & ((py == keys[0][k]) | (ix[i] < iy)))
                    share = (y[at] == x[i]).mean(1)
                    at, share = at[share >= least], share[share >= least]
                    if len(at):
                        at = at[np.argsort(-share, kind="stable")]
                        found[int(ix[i])] = iy[at].tolist()
                        part[int(ix[i])] = int(px[i])
                        part |= zip(iy[at].tolist(), py[at].tolist(), strict=True)
                for i, p in part.items():
                    for column, value in zip(out, (*(c[k] for c in keys), i, p, found.get(i, [])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.list_(pa.int64()))], names=["main", "one", "two", "id", "part", "mates"])

    return tiled.mapInArrow(run, "main long, one long, two long, id long, part long, mates array<long>")


def crossing(spark: SparkSession, open_: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int, least: float, scope: str = "op") -> DataFrame:
    """Links (a, b) between components that share a bucket of open_ (bucket, id, part, main), enough to join them.

    Members that pass the estimate meet tile by tile, as a stream of rows sorted by tile; a tile gives one link at most
    for each two components.
    """
    with batch_rows(spark, TILES):
        met = store(spark, mates(tiles(open_, classes), least), "mates", scope)

    def tile(rows: dict[int, tuple[int, list[int], bytes]], found: list[tuple[int, int]]) -> None:
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def root(p: int) -> int:
            while (q := parent.get(p, p)) != p:
                p = q
            return p

        def elements(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets([rows[i][2]], words)[0]
            return sets[i]

        for i, (part, others, _) in rows.items():
            for j in others:
                a, b = root(part), root(rows[j][0])
                if a != b and _agree(elements(i), elements(j), percent):
                    parent[a] = b
                    found.append((i, j))

    @task(__name__)
    def run(rows):
        at, held = None, {}
        for batch in batches(rows):
            found: list[tuple[int, int]] = []
            columns = (*(batch.column(c).to_pylist() for c in ("main", "one", "two", "id", "part", "mates")), utf8(batch.column("text")))
            for main, one, two, i, part, others, text in zip(*columns, strict=True):
                if (main, one, two) != at:
                    tile(held, found)
                    at, held = (main, one, two), {}
                held[i] = part, others, text
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = []
        tile(held, found)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    key = ["main", "one", "two"]
    return met.join(texts, "id").repartition(*key).sortWithinPartitions(*key, "id").select(*key, "id", "part", "mates", "text").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets satisfy 100 * intersection >= percent * union."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = utf8(batch.column("_ta")), utf8(batch.column("_tb"))
            keep, memo, held = [], {}, 0
            for i in range(len(a)):
                sets = []
                for k, t in ((a[i], ta[i]), (b[i], tb[i])):
                    if k not in memo:
                        if held > 4 * SLICE_BYTES:
                            memo, held = {}, 0
                        memo[k] = shingle_sets([t], words)[0]
                        held += memo[k].nbytes
                    sets.append(memo[k])
                if _agree(*sets, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("_ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("_tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


def components(spark: SparkSession, links: DataFrame, scope: str = "op") -> DataFrame:
    """id and the smallest id reachable from it, for every id of the links (a, b)."""
    edges = store(spark, links.select("a", "b").union(links.select("b", "a")), "edges", scope)
    label = store(spark, edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"), F.lit(1).alias("moved")), "labels", scope)
    while label.where("moved = 1").limit(1).count():
        near = edges.join(label.select(F.col("id").alias("b"), F.col("label").alias("_l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_l").alias("_l"))
        step = label.join(near, "id").select("id", F.col("label").alias("_old"), F.least("label", "_l").alias("label"))
        root = label.select(F.col("id").alias("label"), F.col("label").alias("_r"))
        jumped = step.join(root, "label").select("id", F.least("label", "_r").alias("label"), "_old")
        label = store(spark, jumped.select("id", "label", (F.col("label") < F.col("_old")).cast("int").alias("moved")), "labels", scope)
    return label.select("id", "label")


#: Id and text of a document without nulls, so that the partitions of joins on them serve the steps after them.
KEY = ["_key_id", "_key_null", "_key_text"]


def _key(text_hash: F.Column) -> list[F.Column]:
    doc = F.col("doc_id").cast("long")
    return [c.alias(n) for c, n in zip((F.coalesce(doc, F.lit(0).cast("long")), doc.isNull(), text_hash), KEY, strict=True)]


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, scope: str = "op") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, group_id (a number of the component), head (whether the row is
    the component's first by id and text) and kept, for each row."""
    sketch = store(spark, sketches(docs, words), "sketches", scope)
    real = sketch.where("set_key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    sets = real.groupBy("set_key").agg(first.alias("m"), *(F.first(c).alias(c) for c in ("n_shingles", "buckets", "registers")))
    classes = store(spark, sets.select("set_key", F.monotonically_increasing_id().alias("id"), F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), "n_shingles", "buckets", "registers"), "classes", scope)
    member = classes.select("id", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
    crowd = store(spark, member.join(shared, "bucket"), "crowd", scope)
    popular = crowd.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = crowd.select("bucket", "id").join(popular, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", (-F.col("id")).alias("k"))).alias("hub"))
    star = crowd.join(hubs, "bucket").select(F.col("id").alias("a"), F.explode(F.array("hub", "low")).alias("b")).where("a <> b").distinct()
    pairs = likely(star, classes)
    named = classes.join(crowd.select("id").distinct(), "id", "left_semi").select(*_key(F.col("text_hash")), "id")
    sources = docs.select(*_key(F.xxhash64("text")), "text")
    texts = store(spark, sources.join(named, KEY).dropDuplicates(KEY).select("id", "text"), "texts", scope)

    goal = percent / 100
    least = goal - 5 * math.sqrt(goal * (1 - goal) / REGISTERS)
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"), F.max("share").alias("share")).where(F.col("share") >= least)
    first = store(spark, confirmed(best.select("a", "b"), texts, words, percent), "links", scope)
    part = components(spark, first, scope)

    at = F.coalesce("label", "id").alias("part")
    placed = store(spark, crowd.select("bucket", "id", "n").join(part, "id", "left").select("bucket", "id", "n", at), "placed", scope)
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    cross = crossing(spark, placed.join(mixed, "bucket"), classes, texts, words, percent, least, scope)
    links = store(spark, first.union(cross), "links", scope)
    final = components(spark, links, scope)

    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    owner = classes.select("set_key", "id", head.alias("head")).join(final, "id", "left")
    linked = owner.where("label is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    lowest = linked.groupBy("label").agg(F.min("head").alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.drop("head").join(lowest, ["label", "salt"]).select("set_key", F.col("label").alias("group_id"), "head")
    owner = linked.unionAll(owner.where("label is null").select("set_key", F.col("id").alias("group_id"), "head"))
    first = F.col("head.none").eqNullSafe(F.col("doc_id").isNull()) & F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_hash") == F.col("text_hash"))
    full = real.select("doc_id", "text_hash", "n_shingles", "set_key").join(owner, "set_key").select("doc_id", "text_hash", "n_shingles", F.col("head.doc_id").alias("component_id"), "group_id", first.alias("head"))
    void = sketch.where("set_key is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id"), F.lit(True).alias("head"))
    return full.union(void).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, scope: str = "op") -> DataFrame:
    """The rows of docs that stay: one of each group, of the smallest id (then text hash), and all without words.

    Documents are told apart by id and text: rows that share an id but not the text are judged each for itself. Rows that
    repeat both are one document, of which one row stays. A null id is larger than any other.
    """
    judged = near_duplicates(spark, docs, words, percent, scope).where("group_id is not null")
    each = judged.groupBy(*_key(F.col("text_hash"))).agg(F.count("*").alias("n"), F.bool_or("head").alias("stays"))
    marked = store(spark, each.where("not stays or n > 1"), "marked", scope)
    rows = docs.select("*", *_key(F.xxhash64("text")))
    alone = rows.join(marked.select(*KEY), KEY, "left_anti")
    repeated = rows.join(marked.where("stays").select(*KEY), KEY, "left_semi").dropDuplicates(KEY)
    return alone.unionByName(repeated).select(*docs.columns)

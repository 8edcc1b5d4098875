"""Operator 13, substring dedup with fixed-block anchors.

A window of ``WINDOW`` words goes if the same words start earlier: in a document of smaller id, or before it in the same
one. Non-overlapping blocks of ``BLOCK`` words are the index; as two blocks less one word fit into a window, each window
that occurs earlier holds a whole block there. Every rolling run of ``BLOCK`` words is a probe. Hits are extended on both
sides: each window around a hit gets a key of 96 bits of its ``WINDOW`` words, and the first holder of each key is found.
Runs of windows that start earlier are the maximal exact repeats; their words go.

Documents are sorted by id and packed into shards, so a shard's number tells which of two came first. Index, probes and
keys travel as sorted, packed integers, one row for each shard and hash range; each distinct one goes once for a shard, so
a passage that a third of all documents hold is one entry for each shard. The hash ranges answer with bits in the same
order. Ranges grow in number with the corpus (``bucket_words`` words each); a worker holds one shard or one range.

Defined results: null or empty text has no words; nothing is removed and the digest is that of no bytes. A document of
fewer words than a window keeps all. A null id is later than all others. Rows that share an id are documents of their own,
in the order of their texts' hashes; of rows that repeat both, the first keeps its words and the others are copies. Extra
columns aren't read. A very long text is a shard of its own, hashed in pieces. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, batches, begin, pieces, store, task, word_hashes

WINDOW, BLOCK = 20, 10
#: Text bytes of a shard, words of a hash range.
SHARD_BYTES, BUCKET_WORDS = 3_000_000, 4_000_000
LEAST_BITS = 6
#: Documents, and shards, that a Python worker is handed at once.
DOC_ROWS, SHARD_ROWS = 256, 8

_ODD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: One for each run of BLOCK / 2 words in a window: powers of an odd number, so that no two are alike.
_FACTORS = [np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) for k in range(1, 5)]


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One well-mixed number for each two, in their order."""
    x = left * _ODD
    x += right
    for factor in (_MIX1, _MIX2):
        x ^= x >> np.uint64(32)
        x *= factor
    x ^= x >> np.uint64(32)
    return x


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of BLOCK / 2 words and of BLOCK words, built from runs of half the length; BLOCK is 10."""
    longer = lambda a, b, k: _pair(a[: max(0, len(b) - k)], b[k:])  # noqa: E731  a's run, then b's from k words on
    two = longer(hashes, hashes, 1)
    five = longer(longer(two, hashes, 2), two, 3)
    return five, longer(five, five, BLOCK // 2)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of the differences, which compress well where the array is sorted."""
    return np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel(), dtype=kind)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted 64-bit keys by their top bits; ranges without keys are left out."""
    top = keys >> np.uint64(64 - bits)
    ends = [0, *(np.flatnonzero(top[1:] != top[:-1]) + 1).tolist(), len(keys)]
    return ((int(top[a]), a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b)


class Shard:
    """The texts of a shard, and the hashes of their words in one array."""

    def __init__(self, payload: bytes, sizes: list[int]):
        whole, self.texts, a = zstandard.ZstdDecompressor().decompress(payload), [], 0
        for n in sizes:
            self.texts.append(whole[a : a + n])
            a += n
        each = [word_hashes(t) for t in self.texts]
        self.counts = np.array([len(x) for x in each], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        ends = np.cumsum(self.counts)
        place = np.arange(len(self.hashes))
        self.left = np.repeat(ends, self.counts) - place  # words to the document's end
        self.place = place - np.repeat(ends - self.counts, self.counts)
        self.ends = ends

        self.runs = _runs(self.hashes)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of BLOCK words, and where they lie within one document."""
        found = self.runs[1]
        return found, self.left[: len(found)] >= BLOCK

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that hold a shared block, and their keys in two parts. shared: sorted hashes."""
        found, inside = self.probes()
        n = max(0, len(self.hashes) - WINDOW + 1)
        if not n or not len(shared):
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), none, none
        at = np.minimum(np.searchsorted(shared, found), len(shared) - 1)
        hits = np.concatenate([[0], np.cumsum((shared[at] == found) & inside)])
        starts = np.flatnonzero((hits[WINDOW - BLOCK + 1 :][:n] > hits[:n]) & (self.left[:n] >= WINDOW))
        second = np.zeros(len(starts), np.uint64)
        for k, factor in zip(range(0, WINDOW, BLOCK // 2), _FACTORS, strict=True):
            second += self.runs[0][starts + k] * factor
        return starts, _pair(found[starts], found[starts + BLOCK]), second >> np.uint64(32)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys (equal ones by place), where each distinct key begins in it, and the number of each one's key."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """shard, n_words, ids, sizes, payload: the documents in order, packed."""

    @task(__name__)
    def run(rows):
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def out():
            nonlocal number, size
            n = sum(len(words) for t in texts for words in pieces(t))
            payload = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            row = [pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            number, size = number + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(row, names=["shard", "n_words", "ids", "sizes", "payload"])

        for batch in batches(rows):
            for i, t in _each(batch, "doc_id", "text"):
                t = t or b""
                if texts and size + len(t) > limit:
                    yield out()
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield out()

    order = [F.col("doc_id").asc_nulls_last(), F.col("_h").asc()]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("doc_id", "text").mapInArrow(run, "shard long, n_words long, ids array<long>, sizes array<long>, payload binary")


def _each(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """Values of the columns row by row, so that one shard at a time is held."""
    columns = [batch.column(n).cast(pa.binary()) if n == "text" else batch.column(n) for n in names]
    return ([c[i].as_py() for c in columns] for i in range(batch.num_rows))


def _rows(made: list[tuple], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(types)], names=list(names))


def probes(stored: DataFrame, bits: int) -> DataFrame:
    """bucket, shard, n, hashes, more (in the shard more than once), blocks (in the index): distinct probes of each shard."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            for shard, sizes, payload in _each(batch, "shard", "sizes", "payload"):
                s = Shard(payload, sizes)
                found, inside = s.probes()
                keys, count = np.unique(found[inside], return_counts=True)
                index = np.zeros(len(keys), bool)
                index[np.searchsorted(keys, found[inside & (s.place[: len(found)] % BLOCK == 0)])] = True
                short = (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
                made = [(k, shard, b - a, _planes(short[a:b]), _bits(count[a:b] > 1), _bits(index[a:b])) for k, a, b in _ranges(keys, bits)]
                yield _rows(made, ("bucket", "shard", "n", "hashes", "more", "blocks"), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))

    return stored.select("shard", "sizes", "payload").mapInArrow(run, "bucket int, shard long, n long, hashes binary, more binary, blocks binary")


def _answers(table: pa.Table, flags: np.ndarray) -> pa.Table:
    """The flags of all rows of the table, in their order, as bits for each row that has some."""
    made, a = [], 0
    for k, shard, n in zip(*(table.column(c).to_pylist() for c in ("bucket", "shard", "n")), strict=True):
        if flags[a : a + n].any():
            made.append((k, shard, _bits(flags[a : a + n])))
        a += n
    return pa.Table.from_batches([_rows(made, ("bucket", "shard", "bits"), (pa.int32(), pa.int64(), pa.binary()))])


def shared_blocks(asked: DataFrame) -> DataFrame:
    """bucket, shard, bits: which probes hold the words of an index block that occur more than once."""

    def run(table):
        begin(__name__)
        sizes = table.column("n").to_pylist()
        columns = [table.column(c).to_pylist() for c in ("hashes", "more", "blocks")]
        found = np.concatenate([_unplanes(x, np.uint32) for x in columns[0]])
        more, index = (np.concatenate([_flags(x, n) for x, n in zip(c, sizes, strict=True)]) for c in columns[1:])
        blocks = distinct(found[index])
        if not len(blocks):
            return _answers(table, np.zeros(len(found), bool))
        at = np.minimum(np.searchsorted(blocks, found), len(blocks) - 1)
        hit = blocks[at] == found
        times = np.bincount(at[hit], minlength=len(blocks)) + np.bincount(at[hit & more], minlength=len(blocks))
        return _answers(table, hit & (times > 1)[at])

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, shard long, bits binary")


def _shared(s: Shard, answers: list[dict] | None, bits: int) -> np.ndarray:
    """The shard's probes that its answers name, sorted."""
    found, inside = s.probes()
    keys = distinct(found[inside])
    spans = {k: (a, b) for k, a, b in _ranges(keys, bits)}
    parts = [keys[slice(*spans[x["bucket"]])][_flags(x["bits"], spans[x["bucket"]][1] - spans[x["bucket"]][0])] for x in sorted(answers or (), key=lambda x: x["bucket"])]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def window_keys(joined: DataFrame, bits: int) -> DataFrame:
    """bucket, shard, n, first, second: distinct keys of the windows around each shard's hits."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            for shard, sizes, payload, answers in _each(batch, "shard", "sizes", "payload", "hits"):
                s = Shard(payload, sizes)
                _, first, second = s.windows(_shared(s, answers, bits))
                order, begins, _ = _distinct(first, second)
                a, b = first[order[begins]], second[order[begins]].astype(np.uint32)
                made = [(k, shard, y - x, _planes(a[x:y]), b[x:y].tobytes()) for k, x, y in _ranges(a, bits)]
                yield _rows(made, ("bucket", "shard", "n", "first", "second"), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    return joined.select("shard", "sizes", "payload", "hits").mapInArrow(run, "bucket int, shard long, n long, first binary, second binary")


def earlier(asked: DataFrame) -> DataFrame:
    """bucket, shard, bits: which keys an earlier shard holds."""

    def run(table):
        begin(__name__)
        sizes = np.array(table.column("n").to_pylist(), np.int64)
        first = np.concatenate([_unplanes(x, np.uint64) for x in table.column("first").to_pylist()])
        second = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("second").to_pylist()])
        shard = np.repeat(np.array(table.column("shard").to_pylist(), np.int64), sizes)
        order = np.lexsort((shard, second, first))
        a, b = first[order], second[order]
        flags = np.zeros(len(order), bool)
        flags[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        return _answers(table, flags)

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, shard long, bits binary")


def _gone(s: Shard, hits: list[dict] | None, later: list[dict] | None, bits: int) -> np.ndarray:
    """Which words of the shard a repeated window covers."""
    starts, first, second = s.windows(_shared(s, hits, bits))
    order, begins, number = _distinct(first, second)
    known = np.zeros(len(begins), bool)
    spans = {k: (a, b) for k, a, b in _ranges(first[order[begins]], bits)}
    for x in later or ():
        a, b = spans[x["bucket"]]
        known[a:b] = _flags(x["bits"], b - a)
    again = known[number]
    rest = np.ones(len(order), bool)
    rest[begins] = False
    again |= rest
    cover = np.zeros(len(s.hashes) + 1, np.int32)
    np.add.at(cover, starts[order[again]], 1)
    np.add.at(cover, starts[order[again]] + WINDOW, -1)
    return np.cumsum(cover)[:-1] > 0


def _spans(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _results(joined: DataFrame, bits: int, texts: bool) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *(("kept_text",) if texts else ()))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, *((pa.string(),) if texts else ()))

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            for ids, sizes, payload, hits, later in _each(batch, "ids", "sizes", "payload", "hits", "later"):
                s, made = Shard(payload, sizes), []
                gone = _gone(s, hits, later, bits)
                for i, text, end, n in zip(ids, s.texts, s.ends.tolist(), s.counts.tolist(), strict=True):
                    own = gone[end - n : end]
                    digest, kept, a, some = hashlib.sha256(), [], 0, own.any()
                    for words in pieces(text):
                        part = list(compress(words, (~own[a : a + len(words)]).tolist())) if some else words
                        a += len(words)
                        if part:
                            joint = (b" " if kept else b"") + b" ".join(part)
                            digest.update(joint)
                            kept = [*kept, joint] if texts else [b""]
                    made.append((i, n, int(own.sum()), digest.hexdigest(), _spans(own) if some else [], *((b"".join(kept).decode(),) if texts else ())))
                yield _rows(made, names, types)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: long, end: long>>" + ", kept_text string" * texts
    return joined.select("ids", "sizes", "payload", "hits", "later").mapInArrow(run, schema)


def dedup(spark: SparkSession, docs: DataFrame, texts: bool = False, bucket_words: int = BUCKET_WORDS, shard_bytes: int = SHARD_BYTES, scope: str = "op") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (maximal repeats as word ranges), and with texts kept_text, of every row."""
    with batch_rows(spark, DOC_ROWS):
        stored = store(spark, shards(docs, shard_bytes), "shards", scope)
    words = stored.agg(F.sum("n_words")).first()[0] or 0
    bits = max(LEAST_BITS, (words // bucket_words).bit_length())

    def by_shard(answers: DataFrame, name: str) -> DataFrame:  # at most a bit for each word of the shard
        return answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    with batch_rows(spark, SHARD_ROWS):
        hits = by_shard(store(spark, shared_blocks(probes(stored, bits)), "hits", scope), "hits")
        later = by_shard(store(spark, earlier(window_keys(stored.join(hits, "shard"), bits)), "later", scope), "later")
        return store(spark, _results(stored.join(hits.join(later, "shard", "left"), "shard", "left"), bits, texts), "results", scope)

"""Operator 9, benchmark decontamination with a positional inverted index.

Benchmark items become windows of consecutive words. A first pass over the corpus counts the benchmark's terms; each
window's few rarest terms are its anchors. A second pass stores the index: postings (term, document, position) of benchmark
terms. Postings further from every anchor's occurrence than a window reaches can't belong to a match, so they are left
out; nothing else is. A search starts from the anchors' lists, which give candidate starts by their offsets in the
windows, and intersects them with the offset-adjusted lists of the other terms: a start at which all terms agree is an
exact phrase, one with ``near_terms`` of them at least (if given) is a proximity match, words replaced in place.

The benchmark's vocabulary is broadcast to the corpus passes if it has at most ``vocabulary_bound`` terms; beyond that
the passes count and post all terms, and joins select.

Defined results: null text has no words and no hits. An item without words has no window. Items with a null id take part
in hits but aren't listed. Equal windows of several items are searched once and count for each. Repeated documents are
judged each on their own, also where they share an id, which may be null. Terms of equal number go by hash, then offset.
A window with more than one place near in a document counts once in n_near, also if it is exact elsewhere. Extra columns
aren't read. A very long text is one row of the index. Without benchmark rows nothing is hit; an empty corpus gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, store, task, utf8

#: Bytes as words have them; a space for those that stand between words.
_SHOWN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    """Words [0-9a-z\\x80-\\xff]+ of UTF-8 text, A-Z lower-cased."""
    return text.translate(_SHOWN).split()


def term(word: bytes) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, window (hash of its terms), terms. Items of fewer words than size, but not none, are one window."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
                terms = [term(w) for w in words(text)]
                for i in range(max(1, len(terms) - size + 1) if terms else 0):
                    part = terms[i : i + size]
                    out.append((item, term(np.array(part, np.int64).tobytes()), part))
            item, window, terms = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "window", "terms"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, window long, terms array<long>")


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """How often each term of the vocabulary (a broadcast dict by word, or None for all) occurs in the corpus."""

    @task(__name__)
    def run(rows):
        known = vocabulary.value if vocabulary else None
        total: Counter = Counter()

        def out():
            pairs = [(known[w] if known is not None else term(w), n) for w, n in total.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["term", "n"])

        for batch in batches(rows):
            for text in utf8(batch.column("text")):
                found = words(text)
                total.update(found if known is None else filter(known.__contains__, found))
                if len(total) > 200_000:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, vocabulary, anchors, reach: int) -> DataFrame:
    """row, doc_id, text_hash, n_words, terms, places: the document's postings that can belong to a match."""

    @task(__name__)
    def run(rows):
        known, chosen = (vocabulary.value, anchors.value) if vocabulary else (None, None)
        row = TaskContext.get().partitionId() << 36
        if known is not None:
            numbers = {w: i for i, w in enumerate(known)}
            hashes = np.fromiter(known.values(), np.int64, len(known))
            anchor = np.fromiter((h in chosen for h in known.values()), bool, len(known))
            number = numbers.get
        for batch in batches(rows):
            ids, ns, terms, places, ends = [], [], [], [], [0]
            kept = [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash")]
            for text in utf8(batch.column("text")):
                found = words(text)
                if known is None:
                    at, own = np.arange(len(found)), np.fromiter(map(term, found), np.int64, len(found))
                else:
                    of = np.fromiter((number(w, -1) for w in found), np.int64, len(found))
                    at = np.flatnonzero(of >= 0)
                    spots = at[anchor[of[at]]] if len(at) else at
                    if len(spots):
                        near = np.zeros(len(found) + 2 * reach + 1, np.int32)
                        np.add.at(near, spots, 1)
                        np.add.at(near, spots + 2 * reach + 1, -1)
                        at = at[np.cumsum(near)[at + reach] > 0]
                        own = hashes[of[at]]
                    else:
                        at = own = np.zeros(0, np.int64)
                ids.append(row)
                row += 1
                ns.append(len(found))
                terms.append(own)
                places.append(at)
                ends.append(ends[-1] + len(at))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *kept, pa.array(ns, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms).astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places).astype(np.int32)))],
                names=["row", "doc_id", "text_hash", "n_words", "terms", "places"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "row long, doc_id long, text_hash long, n_words long, terms array<long>, places array<int>")


def _vocabulary(benchmark: DataFrame, bound: int) -> dict[bytes, int] | None:
    """All words of the benchmark with their terms, or None if there are more than bound."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            found = sorted({w for text in utf8(batch.column("text")) for w in words(text)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["word"])

    got = benchmark.select("text").mapInArrow(run, "word binary").distinct().limit(bound + 1).collect()
    return None if len(got) > bound else {bytes(r["word"]): term(bytes(r["word"])) for r in got}


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int, vocabulary_bound: int, near_terms: int | None, scope: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored documents (row, doc_id, text_hash, n_words), the stored windows, and the matches (row, window, start, size, exact)."""
    item_windows = store(spark, windows(benchmark, size), "windows", scope)
    distinct = item_windows.groupBy("window").agg(F.first("terms").alias("terms"))
    known = _vocabulary(benchmark, vocabulary_bound)
    vocabulary = None if known is None else spark.sparkContext.broadcast(known)
    counts = store(spark, term_counts(docs, vocabulary), "counts", scope)
    spread = distinct.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    # At most ``miss`` terms of a match disagree. So one of the miss + 1 rarest agrees, and all but miss of the miss + 2 rarest.
    miss = 0 if near_terms is None else size - near_terms
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))), 1, miss + 2)
    rare = spread.join(counts, "term").groupBy("window").agg(ranked.alias("a"), F.count("*").alias("found"), F.first("size").alias("size"))
    # A window with a term that the corpus lacks has no exact match.
    rare = rare.where((F.col("found") == F.col("size")) | F.lit(near_terms is not None) & (F.col("found") >= F.lit(near_terms)))
    needed = F.greatest(F.lit(1), F.size("a") - miss).alias("needed")
    anchored = rare.select("window", "size", needed, F.posexplode("a").alias("k", "a")).select("window", "size", "needed", (F.col("k") <= miss).alias("first"), F.col("a.term").alias("term"), F.col("a.offset").alias("offset"))
    anchored = store(spark, anchored, "anchors", scope)
    anchors = None if known is None else spark.sparkContext.broadcast({r["term"] for r in anchored.where("first").select("term").distinct().collect()})
    stored = store(spark, index(docs, vocabulary, anchors, size - 1), "index", scope)
    posted = stored.where(F.size("terms") > 0).select("row", "n_words", F.explode(F.arrays_zip("terms", "places")).alias("p"))
    postings = posted.select("row", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))
    starts = posted.select("row", "n_words", F.col("p.terms").alias("term"), F.col("p.places").alias("place")).join(anchored, "term")
    # A window lies inside the document. A start is a candidate if enough of the rarest terms agree on it.
    starts = starts.select("row", "window", (F.col("place") - F.col("offset")).alias("start"), "size", "n_words", "needed").where("start >= 0 and start + size <= n_words")
    starts = starts.groupBy("row", "window", "start").agg(F.count("*").alias("agree"), F.first("needed").alias("needed")).where("agree >= needed").select("row", "window", "start")
    whole = distinct.select("window", "terms", F.size("terms").alias("size"))
    candidates = store(spark, starts.join(whole, "window"), "candidates", scope)
    wanted = candidates.select("row", "window", "start", "size", F.posexplode("terms").alias("offset", "term")).withColumn("place", F.col("start") + F.col("offset"))
    agreed = wanted.join(postings, ["row", "term", "place"]).groupBy("row", "window", "start", "size").agg(F.count("*").alias("agree"))
    found = agreed.where((F.col("agree") == F.col("size")) | F.lit(near_terms is not None) & (F.col("agree") >= F.lit(near_terms)))
    return stored.select("row", "doc_id", "text_hash", "n_words"), item_windows.select("item_id", "window"), found.select("row", "window", "start", "size", (F.col("agree") == F.col("size")).alias("exact"))


def _covered(spans: F.Column) -> F.Column:
    """Number of places in a sorted array of struct<start, size>."""
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        state,
        lambda s, x: F.struct(
            F.greatest(s["end"], (x["start"] + x["size"]).cast("long")).alias("end"),
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["size"] - F.greatest(s["end"], x["start"].cast("long")))).alias("n"),
        ),
        lambda s: s["n"],
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, vocabulary_bound: int = 1_000_000, near_terms: int | None = None, scope: str = "op") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated and n_near (windows met only nearly) for each document."""
    documents, items, found = matches(spark, docs, benchmark, size, vocabulary_bound, near_terms, scope)
    found = store(spark, found, "found", scope)
    exact = found.where("exact")
    hits = exact.groupBy("row").agg(_covered(F.array_sort(F.collect_set(F.struct("start", "size")))).alias("n_hit"))
    named = exact.select("row", "window").distinct().join(items.where("item_id is not null").distinct(), "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    near = found.where("not exact").groupBy("row").agg(F.countDistinct("window").alias("n_near"))
    out = documents.join(hits.join(named, "row", "left"), "row", "left").join(near, "row", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))

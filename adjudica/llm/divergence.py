"""Operator 11, source divergence audit: how far the term shares of a language's sources lie from each other.

Each language keeps the terms of at least ``LEAST_DOCS`` of its documents. A share is p(c) = 1 + floor(10^9 (c + 5) /
(N + 5 V)) of a term's count c, exact in whole numbers. The distance of two sources, the sum of |p - q| over all kept terms, is taken by inclusion
and exclusion over their supports: counts of one source against the other's share of no count, priced from the source's
histogram of counts; for terms in both supports, found by joining sparse postings, that price of both sides is replaced by
the right one; terms in neither cost a constant each. So no table of all terms by all sources is ever made.

Terms are counted in Arrow tasks, for each (lang, source) and task first, so a hot source is a row for each task and term.

Defined results: null text, lang and source are ''. Rows are counted each, also repeated ones and those that share an id; ids aren't
read. A group whose documents have no term has no count, its shares are those of no count. Without kept terms all distances
are 0 and there is no term row. Equal values go by the item's bytes. Extra columns aren't read. A very long text is counted in
pieces. An empty table gives no rows; a lang of one source has no pair rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, store, task, utf8

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task holds before it hands its counts on, and bytes of a text counted at once.
HELD, PIECE = 300_000, 1_000_000
SALTS = 16

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")


def _counted(text: bytes) -> Counter:
    text, a, out = text.lower(), 0, Counter()
    while a < len(text):
        cut = _GAP.search(text, a + PIECE) if len(text) - a > PIECE else None
        b = cut.start() if cut else len(text)
        out.update(_TERM.findall(text, a, b))
        a = b
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). Every group has a row with a null term too."""

    @task(__name__)
    def run(rows):
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def out():
            made = [(lang, source, t, n, d[t]) for (lang, source), (c, d) in held.items() for t, n in c.items()]
            made += [(lang, source, None, 0, 0) for lang, source in held]
            held.clear()
            columns = zip(*made, strict=True) if made else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches(rows):
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, utf8(batch.column("text")), strict=True):
                count, having = held[lang, source]
                own = _counted(text)
                size -= len(count)
                count.update(own)
                having.update(own.keys())
                size += len(count)
                if size > HELD:
                    yield out()
                    size = 0
        yield out()

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    found = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.withColumn("term", F.col("term").cast("string"))


def _share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH kept)) in whole numbers of up to 38 digits; 1 where nothing is kept."""
    divisor = f"(cast({total} as decimal(19,0)) + {SMOOTH} * cast({kept} as decimal(18,0)))"
    return F.expr(f"case when {kept} = 0 then 1L else 1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))) div {divisor} end")


class Audit:
    """Stored tables: groups (lang, source, total, kept, none, support), postings (lang, source, term, n, p), terms (lang, term, n, p)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, scope: str = "op"):
        counts = store(spark, term_counts(docs), "counts", scope)
        terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "n")
        terms = store(spark, terms, "terms", scope)
        langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
        kept = store(spark, counts.where("term is not null").select("lang", "source", "term", "n").join(terms.select("lang", "term"), ["lang", "term"]), "kept", scope)
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "support", "kept")))
        self.groups = store(spark, groups.withColumn("none", _share("0", "total", "kept")), "groups", scope)
        priced = kept.join(self.groups.select("lang", "source", "total", "kept", "none"), ["lang", "source"])
        self.postings = store(spark, priced.select("lang", "source", "term", "n", "none", _share("n", "total", "kept").alias("p")), "postings", scope)
        self.terms = terms.join(langs, "lang").select("lang", "term", _share("n", "lang_total", "kept").alias("q"))

    def distances(self) -> DataFrame:
        """lang, a, b, value for each two sources a < b of a lang."""
        side = lambda x, c: F.col(c).alias(f"{c}_{x}")
        left = self.groups.select("lang", F.col("source").alias("a"), side("a", "none"), side("a", "support"), "kept").withColumn("_salt", F.pmod(F.hash("a"), F.lit(SALTS)))
        right = self.groups.select("lang", F.col("source").alias("b"), side("b", "none"), side("b", "support")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = left.join(right, ["lang", "_salt"]).where("a != b").drop("_salt")
        # One-sided prices: the counts of a against b's share of no count, from a's histogram.
        histogram = self.postings.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("m"))
        sided = histogram.join(pairs.select("lang", "a", "b", "none_b"), ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("none_b"))).alias("v"))
        sided = sided.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("v").alias("sided"))
        # Terms of both supports: their two one-sided prices give way to the right one.
        one = self.postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("za"))
        two = self.postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("zb"))
        right_price = F.expr("abs(pa - pb) - abs(pa - zb) - abs(pb - za)")
        both = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(right_price).alias("change"), F.count("*").alias("common"))
        all_ = pairs.where("a < b").join(sided, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
        neither = F.col("kept") - F.col("support_a") - F.col("support_b") + F.coalesce("common", F.lit(0))
        value = F.coalesce("sided", F.lit(0)) + F.coalesce("change", F.lit(0)) + neither * F.abs(F.col("none_a") - F.col("none_b"))
        return all_.select("lang", "a", "b", F.when(F.col("kept") == 0, 0).otherwise(value).cast("long").alias("value"))

    def excess(self) -> DataFrame:
        """lang, source, term, value: kept terms that the source uses more than its lang."""
        found = self.postings.join(self.terms, ["lang", "term"]).where("p > q")
        return found.select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))


def audit(spark: SparkSession, docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, scope: str = "op") -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by distance, and the top terms by excess."""
    of = Audit(spark, docs, least_docs, scope)
    distances = store(spark, of.distances(), "distances", scope)
    pairs = distances.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(distances.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = of.excess().withColumnRenamed("term", "item").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

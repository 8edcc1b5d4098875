"""Operator 1, language identification.

An interpolated Kneser-Ney character model per language. Fitting runs on a bounded sample of labelled rows
(``sample_rows`` per language and ``sample_total`` in all, each row of its first ``sample_chars``
characters); scoring covers every whole text. The models are kept as sorted hash arrays: for each order, the sorted 64-bit hashes of the n-grams
that any language has seen, and a row of log probabilities (one column for each language) for each. Log probabilities
are interpolated at fitting time, so that scoring looks up the longest known n-gram and adds the back-off weights of
its longer contexts.

The language with the lowest cross-entropy per character wins. A document is rejected if its text has no letter or
if that cross-entropy is above a limit calibrated on sample rows that the counts didn't use.

Defined results: null text or text without letters gives ``und``, score 0, rejected. Equal cross-entropies go to the
language that sorts first. With no labelled row to learn from, every text gives ``und``. Rows with a null id and repeated
rows are judged like any other. A very long text is scored in pieces that give what the
whole gives. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, task

ORDER = 4
DISCOUNT = 0.75
#: Characters scored at once in a worker. Longer texts are scored in pieces, each after the last characters of the one before.
PIECE = 400_000
#: Languages whose models share one table of n-grams.
GROUP = 64
#: Code points that separate texts in a buffer; no letter maps to it.
EDGE = 0
SPACE = 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for whatever is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(x := chr(c))[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """For each position, the hash of the n characters that end there; the first n - 1 positions wrap and are for edges only."""
    h = np.full(len(chars), n, np.uint64)
    wide = chars.astype(np.uint64)
    for back in range(n - 1, -1, -1):
        h = _mix((h + np.roll(wide, back)) * _STEP)
    return h


def buffer(texts: list[str], heads: list[np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as letters and single spaces, each after ORDER - 1 edges, or after the characters (heads) that it goes on
    from; the number of the text at each position, and whether the position is the text's own."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = letters()[raw]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    space = chars == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1] & (of[1:] == of[:-1])
    before = np.full((len(texts), ORDER - 1), EDGE, np.uint32)
    if heads is not None:
        first = np.searchsorted(of, np.arange(len(texts)))
        for i, head in enumerate(heads):
            if head is not None:
                before[i] = head
                if texts[i] and head[-1] not in (EDGE, SPACE):
                    keep[first[i]] = True
    chars, of = chars[keep], of[keep]
    starts = np.searchsorted(of, np.arange(len(texts)))
    at = np.repeat(starts, ORDER - 1)
    own = np.insert(np.ones(len(chars), bool), at, False)
    return np.insert(chars, at, before.reshape(-1)), np.insert(of, at, np.repeat(np.arange(len(texts)), ORDER - 1)), own


class Model:
    """Sorted hash arrays: keys[n] are hashes of n-grams, logp[n] their rows; ctx[n] and back[n] the same for contexts of n characters."""

    def __init__(self, langs: list[str]):
        self.langs, self.keys, self.logp, self.ctx, self.back = langs, {}, {}, {}, {}
        self.unseen = np.zeros(len(langs), np.float32)
        self._radix: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_radix": {}}

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the sorted keys, or -1. A radix table of the leading bits narrows each search to a few keys."""
        if not len(keys):
            return np.full(len(h), -1)
        if (got := self._radix.get(id(keys))) is None:
            bits = max(1, math.ceil(math.log2(len(keys))) + 1)
            shift = np.uint64(64 - bits)
            first = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            got = self._radix[id(keys)] = shift, first, int(np.diff(first).max())
        shift, first, deep = got
        top = (h >> shift).astype(np.int64)
        at, end = first[top], first[top + 1]
        out = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, want = at[left], end[left], h[left]
        for _ in range(deep):
            hit = keys[at] == want
            out[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            if not go.any():
                break
            left, at, end, want = left[go], at[go], end[go], want[go]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Total log probability of each text under each language, and the number of its letters."""
        total = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts), np.int64)
        pieces, owner, room = [], [], 0

        def flush() -> None:
            nonlocal pieces, owner, room
            if pieces:
                got, n, letter, _ = self._score(pieces)
                total[owner] += got
                size[owner] += letter
                chars[owner] += n
            pieces, owner, room = [], [], 0

        chars = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if len(t) > PIECE:
                head = None
                for a in range(0, len(t), PIECE):
                    got, n, letter, last = self._score([t[a : a + PIECE]], [head])
                    total[i] += got[0]
                    size[i] += letter[0]
                    chars[i] += n[0]
                    head = last
                continue
            if room + len(t) > PIECE:
                flush()
            pieces.append(t)
            owner.append(i)
            room += len(t)
        flush()
        return total / np.maximum(chars, 1)[:, None], size

    def _score(self, texts: list[str], heads: list[np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of log probabilities, numbers of characters and of letters of each text, and the last ORDER - 1 characters."""
        chars, of, real = buffer(texts, heads)
        k = len(self.langs)
        rows = np.zeros((len(chars), k), np.float32)
        left = np.flatnonzero(real)
        for n in range(ORDER, 0, -1):
            if not len(left):
                break
            if n == ORDER:
                h = gram_hashes(chars, n)[left]
            else:
                h = self._gather(chars, left, n)
            at = self.find(self.keys[n], h)
            hit = at >= 0
            rows[left[hit]] += self.logp[n][at[hit]]
            left = left[~hit]
            if n > 1 and len(left):
                c = self.find(self.ctx[n - 1], self._gather(chars, left - 1, n - 1))
                seen = c >= 0
                rows[left[seen]] += self.back[n - 1][c[seen]]
        rows[left] += self.unseen
        sums = np.zeros((len(texts), k))
        starts = np.searchsorted(of, np.arange(len(texts)))
        full = np.flatnonzero(np.diff(np.append(starts, len(of))) > 0)
        if len(full):
            sums[full] = np.add.reduceat(rows, starts[full], axis=0, dtype=np.float64)
        n = np.bincount(of[real], minlength=len(texts))
        letter = np.bincount(of[real & (chars != SPACE)], minlength=len(texts))
        return sums, n, letter, chars[len(chars) - ORDER + 1 :]

    @staticmethod
    def _gather(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for back in range(n - 1, -1, -1):
            h = _mix((h + chars[at - back].astype(np.uint64)) * _STEP)
        return h


class Ensemble:
    """The models of all languages, GROUP of them to a table; sharpness and limit hold for all together."""

    def __init__(self, models: list[Model]):
        self.models, self.langs = models, [x for m in models for x in m.langs]
        self.sharpness, self.limit = 1.0, math.inf

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [m.entropies(texts) for m in self.models]
        return np.concatenate([p[0] for p in parts], axis=1), parts[0][1]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy in nats a character, whether rejected."""
        if not self.langs:
            none = np.zeros(len(texts))
            return ["und"] * len(texts), none, none, np.ones(len(texts), bool)
        logp, size = self.entropies(texts)
        best = logp.argmax(1)
        score = self.posterior(logp).max(1)
        cross = -logp[np.arange(len(texts)), best]
        void = size == 0
        lang = ["und" if v else self.langs[b] for v, b in zip(void, best, strict=True)]
        score[void] = 0
        cross[void] = 0
        return lang, score, cross, void | (cross > self.limit)

    def posterior(self, logp: np.ndarray, sharp: float | None = None) -> np.ndarray:
        z = (logp - logp.max(1, keepdims=True)) * (sharp or self.sharpness)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


#: Nats a character above the held-out texts' cross-entropy: half the way to the texts of a left-out language, within these.
MIN_SLACK, SLACK = 0.02, 1.5


def fit(rows: list[tuple[int, str, str]], order: int = ORDER) -> Ensemble:
    """rows: (a number, text, language). A fifth of them, by that number, calibrates; the rest is counted, as are all rows of
    a language that would have none left."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Ensemble([])
    told = {r[2] for r in rows if r[0] % 5}
    counted = [r for r in rows if r[0] % 5 or r[2] not in told]
    held = [r for r in rows if not r[0] % 5] or rows
    alphabet = len({c for _, t, _ in counted for c in np.unique(buffer([t])[0]).tolist()} - {EDGE}) + 1
    model = Ensemble([_fit(langs[i : i + GROUP], counted, alphabet, order) for i in range(0, len(langs), GROUP)])
    _calibrate(model, held)
    return model


def _fit(langs: list[str], counted: list[tuple[int, str, str]], alphabet: int, order: int) -> Model:
    model = Model(langs)
    grams: dict[str, dict[int, tuple]] = {}
    for lang in langs:
        chars, _, own = buffer([t for _, t, x in counted if x == lang] or [""])
        grams[lang] = {}
        real = np.flatnonzero(own)
        for n in range(1, order + 1):
            h = Model._gather(chars, real, n)
            low = Model._gather(chars, real, n - 1) if n > 1 else np.zeros(len(real), np.uint64)  # the last n - 1 characters
            ctx = Model._gather(chars, real - 1, n - 1) if n > 1 else np.zeros(len(real), np.uint64)
            keys, first, c = np.unique(h, return_index=True, return_counts=True)
            grams[lang][n] = keys, c, low[first], ctx[first]
    model.unseen[:] = math.log(1 / (alphabet * 20))
    union = {n: np.unique(np.concatenate([grams[x][n][0] for x in langs])) for n in range(1, order + 1)}
    parts = {n: {} for n in union}
    for lang in langs:
        for n in union:  # what the union's other languages know of an n-gram: its suffix and context
            keys, _, low, ctx = grams[lang][n]
            at = np.searchsorted(union[n], keys)
            a, b = parts[n].setdefault("of", (np.zeros(len(union[n]), np.uint64), np.zeros(len(union[n]), np.uint64)))
            a[at], b[at] = low, ctx
    for n in union:
        model.keys[n], model.logp[n] = union[n], np.zeros((len(union[n]), len(langs)), np.float32)
        if n < order:
            model.ctx[n] = np.unique(parts[n + 1]["of"][1])
            model.back[n] = np.zeros((len(model.ctx[n]), len(langs)), np.float32)
    for j, lang in enumerate(langs):
        below = None
        for n in range(1, order + 1):
            keys, count, _, ctx = grams[lang][n]
            if n < order:  # continuation counts: in how many different longer n-grams the n-gram ends
                count = np.zeros(len(keys), np.int64)
                lows = grams[lang][n + 1][2]
                at = np.searchsorted(keys, lows)
                good = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == lows) if len(keys) else np.zeros(len(lows), bool)
                np.add.at(count, at[good], 1)
                count = np.maximum(count, 1)
            low_all, ctx_all = parts[n]["of"]
            if n == 1:
                total = count.sum()
                p = np.full(len(union[1]), DISCOUNT * len(keys) / max(total, 1) / alphabet)
                p[np.searchsorted(union[1], keys)] += np.maximum(count - DISCOUNT, 0) / max(total, 1)
                p = np.maximum(p, 1e-12)
                model.unseen[j] = math.log(max(DISCOUNT * len(keys) / max(total, 1) / alphabet, 1e-9))
            else:
                cs, inv = np.unique(ctx, return_inverse=True)
                total = np.bincount(inv, count, len(cs)) if len(cs) else np.zeros(0)
                kinds = np.bincount(inv, minlength=len(cs))
                gamma = DISCOUNT * kinds / np.maximum(total, 1)
                where = np.searchsorted(cs, ctx_all)
                known = (where < len(cs)) & (cs[np.minimum(where, len(cs) - 1)] == ctx_all) if len(cs) else np.zeros(len(ctx_all), bool)
                weight = np.ones(len(ctx_all))
                weight[known] = gamma[where[known]]
                p = weight * below[np.searchsorted(union[n - 1], low_all)]
                p[np.searchsorted(union[n], keys)] += np.maximum(count - DISCOUNT, 0) / np.maximum(total[inv], 1)
                seen = np.searchsorted(cs, model.ctx[n - 1])
                known = (seen < len(cs)) & (cs[np.minimum(seen, len(cs) - 1)] == model.ctx[n - 1]) if len(cs) else np.zeros(len(model.ctx[n - 1]), bool)
                model.back[n - 1][known, j] = np.log(gamma[seen[known]])
            model.logp[n][:, j] = np.log(np.maximum(p, 1e-12))
            below = p
    return model


def _calibrate(model: Ensemble, held: list[tuple[int, str, str]]) -> None:
    """Sets the scores' sharpness and the limit of rejection by rows that weren't counted."""
    langs = model.langs
    logp, size = model.entropies([t for _, t, _ in held])
    truth = np.array([langs.index(x) for _, _, x in held])
    use = size > 0
    if use.any():
        losses = [(-np.log(np.maximum(model.posterior(logp[use], s)[np.arange(use.sum()), truth[use]], 1e-9)).mean(), s) for s in (1, 2, 4, 8, 16)]
        model.sharpness = float(min(losses)[1])
        known = float(np.quantile(-logp[use].max(1), 0.999))
        slack = SLACK
        if len(langs) > 1:  # what the texts of each language cost the models of all others, as an unlearned language's would
            others = logp[use].copy()
            others[np.arange(use.sum()), truth[use]] = -np.inf
            slack = min(max((float(np.quantile(-others.max(1), 0.01)) - known) / 2, MIN_SLACK), SLACK)
        model.limit = known + slack


#: Rows of each language that are learned from at least, however many languages there are.
LEAST_ROWS = 16


def sampled(docs: DataFrame, allowed: F.Column, sample_rows: int, sample_chars: int, sample_total: int) -> list[tuple[int, str, str]]:
    """A bounded sample of labelled rows: of each language the sample_rows with the smallest hashes of id and text, or fewer
    where all languages together would have over sample_total. First the hash that bounds each language's sample is found,
    without texts; rows that repeat id and text have one hash, so the second pick counts again."""
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("place"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # the languages that a result may name
    if not counts:
        return []
    sample_rows = min(sample_rows, max(LEAST_ROWS, sample_total // len(counts)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    bounds = known.select("lang", "place").withColumn("k", nth).where(F.col("k") <= sample_rows).groupBy("lang").agg(F.max("place").alias("bound")).collect()
    bound = F.element_at(F.create_map(*[F.lit(x) for r in bounds for x in (r["lang"], r["bound"])]), F.col("lang"))
    got = known.where(F.col("place") <= bound).select("place", F.substring("text", 1, sample_chars).alias("text"), "lang").withColumn("k", nth).where(F.col("k") <= sample_rows)
    return sorted((r["place"], r["text"], r["lang"]) for r in got.collect())


def identify(
    spark: SparkSession,
    docs: DataFrame,
    allowed: F.Column | None = None,
    sample_rows: int = 400,
    sample_chars: int = 20_000,
    sample_total: int = 8_000,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """keep's columns of docs with lang_pred, score, cross_entropy and rejected. Learns from rows where allowed holds."""
    learn = docs.select("doc_id", "text", "lang")
    model = spark.sparkContext.broadcast(fit(sampled(learn, F.lit(True) if allowed is None else allowed, sample_rows, sample_chars, sample_total)))
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(*f) for f in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType()))])
    extra = [c for c in keep if c != "text"]

    @task(__name__)
    def score(rows):
        judge = model.value.judge
        for batch in batches(rows):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            lang, points, cross, bad = judge(texts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(lang), pa.array(points, pa.float64()), pa.array(cross, pa.float64()), pa.array(bad)], names=out.names)

    return docs.select(*extra, "text").mapInArrow(score, out)

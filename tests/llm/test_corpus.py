"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from adjudica.llm import divergence, importance, substring_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, rank int, hits string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, -1, -1, "x") for r in rows], SCHEMA)


def passages(seed, n=60):
    """Texts that share passages of 15 to 60 words, cut anywhere, with copies within and across."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("aé bc def Ghi jkl m".split()) + str(rnd.randrange(60))
    shared = [[word() for _ in range(60)] for _ in range(4)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [word() for _ in range(rnd.randrange(30))]
            p, a = rnd.choice(shared), rnd.randrange(40)
            words += p[a : a + rnd.randrange(15, 61)]
        out.append(rnd.choice([" ", "\t", " \n"]).join(words))
    return out


ODD = [None, "", " \n\t", "one", "one two", "ends in space ", " Ünï ß  x", "w " * 45, "a b " * 25]


# Substring dedup


def kept_by_force(rows):
    """(doc_id, n_words, n_removed, sha, spans) by the set of all windows so far, in order of id (null last)."""
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def kept(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_repeats_as_by_force(spark):
    texts = passages(1) + ODD + ODD
    rows = [(3 * i, t, "en", "s") for i, t in enumerate(texts)]
    want = sorted(kept_by_force([r[:2] for r in rows]), key=str)
    random.Random(2).shuffle(rows)
    docs = frame(spark, rows).repartition(5)
    assert sum(r[2] for r in want) > 500
    assert kept(substring_dedup.dedup(spark, docs)) == want
    # Small shards and hash ranges give the same.
    assert kept(substring_dedup.dedup(spark, docs, bucket_words=40, shard_bytes=900)) == want


def test_repeats_and_kept_text_agree(spark):
    texts = passages(5, 20)
    docs = frame(spark, [(i, t, "", "") for i, t in enumerate(texts)])
    for r in substring_dedup.dedup(spark, docs, texts=True).collect():
        words = texts[r.doc_id].split()
        left = [w for j, w in enumerate(words) if not any(x.start <= j < x.end for x in r.repeats)]
        assert r.kept_text == " ".join(left) and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert all(x.end - x.start >= 20 and (i == 0 or r.repeats[i - 1].end < x.start) for i, x in enumerate(r.repeats))


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long, "", ""), (7, long, "", ""), (7, long, "", ""), (7, "x " + long + " y", "", ""), (9, long + " z", "", "")]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(spark, frame(spark, rows)).collect()]
    assert (None, 30, 30) in got and (9, 31, 30) in got
    assert sorted(n for i, _, n in got if i == 7) == [0, 30, 30]


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    words = [f"t{rnd.randrange(10**6)}" for _ in range(700_000)]
    words[500_000:500_040] = words[100:140]
    rows = [(1, " ".join(words), "", ""), (2, " ".join(words[300_000:300_100]), "", ""), (3, "q" * 3_000_000, "", "")]
    assert len(rows[0][1]) > 5_000_000
    got = {r.doc_id: r for r in substring_dedup.dedup(spark, frame(spark, rows)).collect()}
    assert [(x.start, x.end) for x in got[1].repeats] == [(500_000, 500_040)]
    assert (got[2].n_removed, got[3].n_words, got[3].n_removed) == (100, 1, 0)


def test_empty_table(spark):
    none = frame(spark, [(1, "x", "", "")]).where("doc_id < 0")
    assert substring_dedup.dedup(spark, none).count() == 0
    assert importance.resample(spark, none, none).count() == 0
    assert divergence.audit(spark, none).count() == 0


def test_runs_are_told_apart():
    """Words in a Thue-Morse order and their complement, which hashes by powers of one base confuse."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    h = substring_dedup.word_hashes(" ".join("ab"[x] for x in bits).encode())
    for k, found in zip((5, 10), substring_dedup._runs(h), strict=True):
        of = [tuple(bits[i : i + k]) for i in range(4096 - k + 1)]
        assert len(found) == len(of) and len(set(zip(found.tolist(), of, strict=True))) == len(set(of)) == len(set(found.tolist()))
    assert [len(x) for x in substring_dedup._runs(h[:4])] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_packed_integers_come_back(values):
    a = np.sort(np.array(values, np.uint32))
    assert (substring_dedup._unplanes(substring_dedup._planes(a), np.uint32) == a).all()
    assert (substring_dedup._unplanes(substring_dedup._planes(a.astype(np.uint64) << 31), np.uint64) == a.astype(np.uint64) << 31).all()


# Importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def features_of(text, n=2):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def drawn_by_force(rows, target):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features_of(t))
    s, t = count(r[1] for r in rows), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text in rows:
        f = [gain(zlib.crc32(x.encode()) % 10000) for x in features_of(text)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    ranks = {r[0]: k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted((*r[:4], ranks.get(r[0])) for r in out)


def test_draw_as_by_force(spark):
    texts = passages(11, 400) + ODD + ["x" * 50_000 + " Y" * 400]
    rows = [(i, t) for i, t in enumerate(texts)]
    target = [*texts[3:9], None, "", "A-b_C d"]
    docs = frame(spark, [(*r, "", "") for r in rows]).repartition(4)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(spark, docs, items).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == drawn_by_force(rows, target)


def test_query_12_as_by_force(spark, duck):
    from adjudica.llm.queries import op12_importance_resampling

    rows = duck.sql("select doc_id, text from documents").fetchall()
    want = drawn_by_force(rows, [r[0] for r in duck.sql("select text from benchmark").fetchall()])
    got = op12_importance_resampling(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == want


def test_draw_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = frame(spark, [(None, text, "", "")] * 5 + [(4, text, "", "")] * 8)
    got = importance.resample(spark, docs, docs.limit(0)).collect()
    assert all(r.score is None and r["rank"] is None for r in got if r.doc_id is None)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 13


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB é-9\n", max_size=80), st.integers(1, 4), st.integers(1, 30))
def test_ring_across_pieces(text, n, piece):
    parts = list(importance.scan(text.encode(), n, piece))
    assert sum(p[0] for p in parts) == len(words_of(text))
    assert sorted(x for p in parts for x in p[1]) == sorted(zlib.crc32(f.encode()) for f in features_of(text, n))


# Source divergence


def audit_by_force(rows, least):
    terms_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        groups.add((lang, source))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = shares(counts[lang, source])
        q = shares(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        far = [(sum(abs(p[t] - o[t]) for t in kept), s) for x, s in groups if x == lang and s != source for o in [shares(counts[x, s])]]
        more = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", far, None), ("term", more, 50)):
            found.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_divergence_as_by_force(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(600):
        lang, k = rnd.choice(["en", "en", "en", "de", None]), rnd.randrange(30)
        own = [f"t{chr(97 + rnd.randrange(26))}{chr(97 + (k * rnd.randrange(4)) % 26)}" for _ in range(rnd.randrange(40))]
        rows.append((i, rnd.choice([" ", "1", "-É "]).join(own).title(), lang, None if k == 0 else f"s{k % 9}" if k < 20 else "hot"))
    rows += [(1000 + i, t, "xx", f"s{i % 3}") for i, t in enumerate([*ODD, None])] + [(2000, "a", "lone", "s"), (2000, "a", "lone", "s")]
    docs = frame(spark, rows).repartition(6)
    for least in (1, 5, 10_000):
        assert audited(divergence.audit(spark, docs, least_docs=least)) == audit_by_force(rows, least)


def test_shares_of_very_large_counts(spark):
    row = spark.createDataFrame([(9 * 10**15, 9 * 10**17, 10**12)], "n long, total long, kept long")
    got = row.select(divergence._share("n", "total", "kept").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9 * 10**15 + 5) // (9 * 10**17 + 5 * 10**12)

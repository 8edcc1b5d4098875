import math

import numpy as np
from pyspark.sql import functions as F

from adjudica.llm import language_id as L
from adjudica.llm.queries import op1_language_id

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = op1_language_id(spark, DATA).join(docs, "doc_id").where("held_out")
    assert got.where(F.col("lang") == F.col("lang_pred")).count() / got.count() > 0.95
    assert op1_language_id(spark, DATA).where("rejected").count() == 0


def test_probabilities_of_a_context_sum_to_one():
    text = "the cat sat on the mat and the dog ran to the cat " * 3
    (m,) = L.fit([(i, text[i:], "en") for i in range(1, 4)]).models
    letters = sorted(set(text) | {"z"})
    for ctx in ("the", "cat", "zzz"):
        total = 0.0
        for c in letters[:-1]:
            chars, _, _ = L.buffer([ctx + c])
            at = np.array([len(chars) - 1])
            lp = 0.0
            for n in range(L.ORDER, 0, -1):
                k = m.find(m.keys[n], L.Model._gather(chars, at, n))[0]
                if k >= 0:
                    lp += m.logp[n][k, 0]
                    break
                if n > 1 and (j := m.find(m.ctx[n - 1], L.Model._gather(chars, at - 1, n - 1))[0]) >= 0:
                    lp += m.back[n - 1][j, 0]
            total += math.exp(lp)
        assert 0.9 < total <= 1.001


def test_edges():
    m = L.fit([(i, "bonjour le monde " * 5, "fr") for i in range(5)] + [(i, "hello the world " * 5, "en") for i in range(5)])
    lang, score, cross, bad = m.judge(["", "123 !?", "le monde", "the world", "жук" * 20])
    assert lang[:4] == ["und", "und", "fr", "en"] and list(bad[:4]) == [True, True, False, False]
    assert bad[4] and score.min() >= 0 and score.max() <= 1
    assert L.fit([]).judge(["x"])[0] == ["und"]


def test_pieces_give_what_the_whole_gives(monkeypatch):
    m = L.fit([(i, "hello the world and all its people " * 20, "en") for i in range(5)] + [(i, "bonjour le monde et tous les gens " * 20, "fr") for i in range(5)])
    text = "the people  of the, world --   et tous " * 60 + " " * 500 + "fin x"
    whole, letters = m.entropies([text, "x", ""])
    for piece in (1, 2, 3, 7, 100, 499):
        monkeypatch.setattr(L, "PIECE", piece)
        got, n = m.entropies([text, "x", ""])
        assert np.allclose(got, whole, rtol=1e-6) and (n == letters).all()


def test_groups_of_languages_give_one_model_s_numbers(monkeypatch):
    rows = [(i, f"{w} " * 30, w) for w in ("aba", "bcb", "cdc", "ded", "efe") for i in range(5)]
    whole = L.fit(rows).entropies(["aba bcb zz", "efe"])[0]
    monkeypatch.setattr(L, "GROUP", 2)
    m = L.fit(rows)
    assert len(m.models) == 3 and m.judge(["bcb bcb", "efe"])[0] == ["bcb", "efe"]
    assert np.allclose(m.entropies(["aba bcb zz", "efe"])[0], whole, rtol=1e-5)


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").select("doc_id", F.substring("text", 1, 1500).alias("text"), "lang").collect()
    by = {}
    for r in sorted(docs):
        by.setdefault(r.lang, []).append(r.text)
    for out in by:
        rows = [(i, t, x) for x in by if x != out for i, t in enumerate(by[x][: len(by[x]) * 3 // 4])]
        m = L.fit(rows)
        assert m.judge(by[out][:60])[3].mean() > 0.9, (out, m.limit)
        for x in by:
            if x != out:
                assert not m.judge(by[x][len(by[x]) * 3 // 4 :])[3].any(), (out, x, m.limit)


def test_long_texts_are_learned_from_in_part(spark):
    docs = spark.createDataFrame([(i, "abc " * 1000, "xx") for i in range(20)], "doc_id long, text string, lang string")
    got = L.sampled(docs, F.lit(True), 400, 100, 8000)
    assert len(got) == 20 and {len(t) for _, t, _ in got} == {100}


def test_a_language_of_long_rows_only_is_learned(spark):
    docs = spark.createDataFrame([(1, "le monde est grand et les gens aussi " * 1000, "fr"), (2, "the world is large and so are the people", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(spark, docs).collect()}
    assert got == {1: "fr", 2: "en"}


def test_sample_is_bounded_whatever_ids_repeat(spark):
    null = [(None, f"text {i} of many", "en") for i in range(5000)]
    same = [(None, "one text", "fr")] * 900 + [(7, "one text", "fr")] * 900
    few = [(i, f"selten {i}", "de") for i in range(3)]
    docs = spark.createDataFrame(null + same + few, "doc_id long, text string, lang string").repartition(5)
    got = L.sampled(docs, F.lit(True), 400, 100, 8000)
    count = lambda lang: sum(x == lang for *_, x in got)
    assert (count("en"), count("fr"), count("de")) == (400, 400, 3)
    assert got == L.sampled(docs.repartition(2), F.lit(True), 400, 100, 8000)

"""The pipeline on a small fixture against brute force, and every query on awkward and on empty tables."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from adjudica.llm.queries import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, bench=(), pages=()):
    spark.createDataFrame(list(docs), COLUMNS + ", id long, row string, label string, a long, kind int, block string, slot long, bucket long, term long, _s string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string, row string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string, host string, row long").write.parquet(f"{path}/pages.parquet")
    return path


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), 1, "r", "l", 2, 3, "b", 4, 5, 6, "z")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    texts = [None, "", " \n\t ", "a", "12 34", "The same text for two rows of this table", "The same text for two rows of this table", "é" * 5000 + " " + "word " * 4000, "x=\x00\ue000\ue001 token=abcdefgh1"]
    docs = [row(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 2}") for i, t in enumerate(texts)]
    docs += [row(5, texts[5]), row(None, "a row without an id but with some words in it"), row(None, None, None, None)]
    bench = [(1, "the same text for two rows", "r"), (None, None, "r"), (2, "", "r")]
    pages = [(1, None, None, "h", 1), (None, "http://a.example/x", "<p>t", None, None), (2, "", "", None, 2), (2, "", "", None, 2)]
    return write(spark, str(tmp_path_factory.mktemp("awkward")), docs, bench, pages)


@pytest.mark.parametrize("name", sorted(queries()))
def test_awkward_rows(spark, awkward, name):
    n = queries()[name](spark, awkward).count()
    if name == "op11_source_divergence":  # a row for each two sources of a lang; no term is in 30 documents
        assert n == 4 * 3 + 2
    elif name != "pipeline":
        assert n == spark.read.parquet(f"{awkward}/{'pages' if name in ('op2_html_extract', 'op5_url_filter') else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, tmp_path, name):
    assert queries()[name](spark, write(spark, str(tmp_path), [])).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 6)))
    base = [" ".join(word() for _ in range(60)) for _ in range(40)]
    item = " ".join(word() for _ in range(14))
    docs = [row(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    docs += [row(100 + i, base[i] + (" extra" if i % 2 else ""), "en", "s0") for i in range(10)]
    docs += [row(200, base[39] + " " + item, "en", "s1"), row(201, " ".join(word() for _ in range(20)) + " " + item, "en", "s2"), row(300, None), row(301, "!!! 123")]
    path = write(spark, str(tmp_path), docs, [(7, item, "r")])
    got = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, got, path)
        if k < 4:
            assert got.columns == list(corpus_pipeline.COLUMNS)
        got.write.parquet(f"{path}/out{k}")
        got = spark.read.parquet(f"{path}/out{k}")
        seen.append(sorted(r.doc_id for r in got.collect()))
    assert set(range(200)) - set(seen[0]) == set(range(200)) - {d[0] for d in docs}
    assert not {300, 301} & set(seen[0])
    sets = {d[0]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d in docs if d[1] and (w := re.findall(r"\S+", d[1]))}
    kept, alive = [], [i for i in seen[0]]
    for i in sorted(alive):
        if not any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in kept):
            kept.append(i)
    assert seen[1] == kept
    assert seen[2] == [i for i in kept if item not in dict((d[0], d[1]) for d in docs)[i]]
    assert seen[3] == seen[2] == seen[4]
    # The mix's order takes effect in the token stage: sources alternate in the order of the starts.
    source = {d[0]: d[3] for d in docs}
    order = [source[r.doc_id] for r in got.orderBy("start").collect()]
    stored = [r.source for r in spark.read.parquet(f"{path}/out3").selectExpr("source", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()]
    assert order == stored
    ends = np.cumsum([r.n_tokens for r in got.orderBy("start").collect()])
    assert [r.start for r in got.orderBy("start").collect()] == [0, *ends[:-1]]


def test_rows_of_one_id_are_judged_by_their_texts(spark, tmp_path):
    x, y = "the other text has nothing near it at all in this table", "a text that stands in two rows of this small table"
    docs = spark.createDataFrame([row(3, y)[:5], row(5, x)[:5], row(5, y)[:5], row(None, x + " tail of words that differ")[:5]], COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["near-duplicate removal"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, y), (5, x), (0, x + " tail of words that differ")])
    bench = spark.createDataFrame([(1, "nothing near it at all in this table")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(3, y), (5, y)]


def test_run_equals_its_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100

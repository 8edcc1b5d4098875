"""What plans hold: shuffles and interpreted parts that large tables can't afford."""

import random

import pytest

from adjudica import bind
from adjudica import queries as core
from adjudica.functions import text
from adjudica.operators import evidence, gate, history, linkage, relevance

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    """Plans as large tables have them: no broadcasts, nothing changed while they run."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in old.items():
        spark.conf.set(k, v)


def test_findings_are_shuffled_by_part_and_by_order_once(spark, plain):
    """Lines, parts, joined lines, orders; lines went by order, by part and by order again before."""
    plan = plain(bind.with_evidence(bind.findings(spark, DATA)))
    assert plan.count("Exchange hashpartitioning") == 4


def test_checks_of_the_gate_are_compiled(spark):
    names = "severity category title message failure_mechanism impact trigger introduced_by_patch critic_decision suggested_disposition".split()
    df = spark.createDataFrame([(*["x"] * len(names), 0.7, 1, 0, 1, True, 1, 0, True, 75, False)], ", ".join(f"{n} string" for n in names) + ", confidence double, start_line int, n_contradictions int, n_evidence long, v_valid boolean, v_n_valid long, v_n_invalid long, v_direct boolean, v_strength int, v_fabricated boolean")
    got = gate.gated(df)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    row = got.first()
    assert sorted([*row.passed_checks, *row.failed_checks]) == sorted(gate.CHECKS) and row.failed_checks


def test_what_a_path_tells_is_made_once_for_each_path(spark, plain):
    """The joins with changed files, files and hunks go by distinct paths, so items take part in one join by path."""
    items = spark.createDataFrame([(1, "./src//a.ts", 1, 2, None, None), (2, "dist/b.ts", 1, 1, None, None), (3, None, 1, 1, None, None), (4, "/etc/x", 1, 1, None, None), (5, "src/a.ts", 9, 9, None, None)], "item long, path string, start int, end int, causal_link string, explanation string")
    changed = spark.createDataFrame([("src/a.ts", "modified")], "path string, status string")
    hunks = spark.createDataFrame([("src/a.ts", "+", 1, 2)], "path string, side string, r_start int, r_end int")
    files = spark.createDataFrame([("src/a.ts", 5)], "path string, total_lines int")
    flagged = relevance.evidence_flags(items, files, changed, hunks)
    got = {r["item"]: r for r in evidence.validate_items(flagged).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: "ignored file", 3: "file does not exist", 4: "path not permitted", 5: "start exceeds total lines"}
    assert got[1].tier == "direct_changed" and got[1].hits_added and not got[5].hits_added
    bare = {r["item"]: r.reason for r in evidence.validate_items(flagged.drop("path_reason")).collect()}
    assert bare == {k: r.reason for k, r in got.items()}


def test_plain_paths_stay(spark):
    paths = ["a/b.ts", "./a", "././a/./b", "a//b", "/a", "a\\b", "", ".", "./", "a/.", "//./x", "a/../b", ".\\a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    want = ["a/b.ts", "a", "a/b", "a/b", "a", "a/b", "", ".", "", "a/.", "x", "a/../b", "a"]
    assert [r[0] for r in df.select(text.normalize_path(df.p)).collect()] == want


def test_rows_are_consolidated_after_one_shuffle_by_file(spark, monkeypatch):
    """All windows of a file share it, and what tasks have contracted needs no rounds; each window and round shuffled rows before."""
    stored, plain_store = [], linkage.store
    monkeypatch.setattr(linkage, "store", lambda df, what: stored.append((what, df._jdf.queryExecution().executedPlan().toString())) or plain_store(df, what))
    rows = [(i, i % 3, 10 * i, 10 * i + (12 if i % 4 == 0 else 2), "ab"[i % 2], f"q{i // 20}" if i % 5 else None, f"t{i % 17}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, file long, start_line int, end_line int, category string, symbol string, norm_title string")
    got = {r.id: r.cluster for r in linkage.consolidate(df, ["id"], ["id"]).collect()}
    plans = dict(stored)
    assert plans["consolidate"].count("Exchange hashpartitioning") == 1 and not any("edges" in what for what, _ in stored)
    links = lambda a, b: a[1] == b[1] and (a[2] <= b[3] and b[2] <= a[3] or a[5] is not None and a[4:6] == b[4:6] or a[6] == b[6])
    want = {r[0]: r[0] for r in rows}
    while any(want[a[0]] > want[b[0]] and want.update({a[0]: want[b[0]]}) is None for a in rows for b in rows if links(a, b)):
        pass
    assert got == want


def test_components_over_chunks(spark, monkeypatch):
    """Components that lie in many chunks are joined by the rounds on roots."""
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    rnd.shuffle(edges)
    label = {x: x for e in edges for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(7)
    assert {r.id: r.label for r in linkage.components(df).collect()} == label


def test_questions_of_a_history_read_its_end(spark, monkeypatch):
    """Against walks of the whole; commits behind the part that tells aren't indexed."""
    monkeypatch.setattr(history, "FIRST", 20)
    monkeypatch.setattr(history, "WIDER", 4)
    rnd = random.Random(8)
    parents = {i: [p for p in dict.fromkeys((i - 1 - rnd.randrange(4), i - 1 - rnd.randrange(6) if i % 4 == 0 else -1)) if p >= 0] for i in range(400)}
    parents[396], parents[397] = [395, 3], [394, 3]  # 3 is behind both and no later common commit's ancestor only if none has it
    rows = [(f"c{i}", f"c{p}" if p is not None else None, k + 1, i) for i, ps in parents.items() for k, p in enumerate(ps or [None])]
    commits = spark.createDataFrame(rows, "oid string, parent string, nth int, time long")

    def reached(i):
        seen, left = set(), [i]
        while left:
            if (x := left.pop()) not in seen:
                seen.add(x)
                left += parents[x]
        return seen

    sizes, index = [], history.CommitIndex
    monkeypatch.setattr(history, "CommitIndex", lambda part, order: sizes.append(part.select("oid").distinct().count()) or index(part, order))
    for a, b in ((399, 398), (397, 396)):
        common = reached(a) & reached(b)
        want = {f"c{x}" for x in common if not any(x in parents[y] for y in common)}
        pairs = spark.createDataFrame([(1, f"c{a}", f"c{b}")], "id int, a string, b string")
        assert {r.oid for r in history.merge_bases(commits, pairs).collect()} == want
    assert sizes[0] < 40
    assert [r.oid for r in history.log(commits, "c390", 12).collect()] == [f"c{x}" for x in sorted(reached(390), reverse=True)[:12]]
    assert sizes[-1] < 400


def test_relevance_stores_what_it_asks(spark, monkeypatch):
    stored, plain_store = {}, core.store
    monkeypatch.setattr(core, "store", lambda df, what: stored.setdefault(what, plain_store(df, what)))
    core.diff_relevance(spark, DATA)
    assert not {"message", "brand"} & set(stored["findings"].columns)


def test_tasks_stay_small_where_partitions_are_joined(spark, monkeypatch):
    """Adaptive execution joins many partitions of the session down to one for each core; parts are stated then too, and rows stay."""
    from adjudica import queries
    from adjudica.plans import shared

    d = "/root/testdata/sf0.001"
    names = ("review_plan", "fixture_metrics", "finding_validation")
    few = {n: sorted(map(tuple, getattr(queries, n)(spark, d).collect()), key=str) for n in names}
    own = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert shared.parts(spark, 36_000_000) == 200
        monkeypatch.setattr(shared, "TASK_ROWS", 200)
        for n in names:
            df = getattr(queries, n)(spark, d)
            assert sorted(map(tuple, df.collect()), key=str) == few[n]
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("RepartitionByExpression") >= {"review_plan": 5, "fixture_metrics": 7, "finding_validation": 8}[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_findings_are_merged_after_one_shuffle_by_file(spark, plain):
    """Lines, parts, joined lines, orders, findings by file; windows and clusters went by file three times before, with all texts."""
    plan = plain(core.merge_clusters(spark, DATA))
    assert plan.count("Exchange hashpartitioning") == 5
    assert "p_type" not in plan.split("hashpartitioning(l_orderkey")[0]


def stored_by(spark, monkeypatch, query):
    """What a query stores, by name, and its result."""
    stored, plain_store = {}, core.store
    monkeypatch.setattr(core, "store", lambda df, what: stored.setdefault(what, plain_store(df, what)))
    return stored, query(spark, DATA)


@pytest.mark.parametrize("query", [core.decision_gate, core.exit_code, core.gate_summary, core.patch_attribution])
def test_findings_go_through_the_gate_without_texts(spark, monkeypatch, plain, query):
    """Texts are judged where parts are met; findings and evidence are shuffled once by path and once by id. All texts went along
    before, and findings and evidence went by order again, by path, by line bucket and by id."""
    stored, df = stored_by(spark, monkeypatch, query)
    assert not {"title", "message", "brand"} & set(stored["findings"].columns) and "e_file" in stored["findings"].columns
    plan = plain(df)
    assert "explode" not in plan and "hashpartitioning(fixture" not in plan
    assert plan.count("hashpartitioning(id") == 3 - (query is core.patch_attribution)


def test_only_findings_that_pass_the_floor_so_far_ask_the_patch(spark, monkeypatch):
    asked, whole = [], relevance.in_diff
    monkeypatch.setattr(relevance, "in_diff", lambda df, *a, **k: asked.append(df.count()) or whole(df, *a, **k))
    stored, df = stored_by(spark, monkeypatch, core.hard_floor)
    assert not {"title", "message", "brand"} & set(stored["floor"].columns)
    n = stored["floor"].count()
    assert df.count() == n and 0 < asked[0] == stored["floor"].where("dropped_by is null").count() < n / 2

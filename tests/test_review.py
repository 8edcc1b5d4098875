"""Patch joins, repositories, reference graph, stages and the driver's runtime, on small fixtures."""

import logging
import random
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from adjudica import runtime
from adjudica.errors import AdjudicaError, ConfigurationError, ModelError, RepositoryError
from adjudica.operators import gate, graph, payloads, reference, relevance, snapshot, source
from adjudica.plans import prompts, stages
from adjudica.sinks import report
from adjudica.sources import readers, repository

FINDING = "id long, path string, start int, end int"
HUNK = "path string, side string, r_start int, r_end int"


def by_id(df, *names):
    return {r.id: tuple(r[n] for n in names) for r in df.collect()}


def test_in_diff_by_path_suffix_and_evidence(spark):
    hunks = spark.createDataFrame([("src/a.ts", "+", 10, 12), ("pkg/lib/b.ts", "+", 5, 5)], HUNK)
    found = spark.createDataFrame([(1, "src/a.ts", 14, 14), (2, "src/a.ts", 15, 15), (3, "./lib/b.ts", 4, 4), (4, "c.ts", 1, 1), (5, "src/a.ts", 90, 90), (6, "c.ts", 1, 1), (7, "else/b.ts", 3, 3)], FINDING)
    told = spark.createDataFrame([(5, "a.ts", 11, 11), (6, "b.ts", 6, 7), (2, "pkg/lib/b.ts", 5, 5)], FINDING)
    assert by_id(relevance.in_diff(found, told, hunks), "in_diff") == {1: (True,), 2: (False,), 3: (True,), 4: (False,), 5: (True,), 6: (True,), 7: (True,)}
    assert all(r.in_diff for r in relevance.in_diff(found, told, hunks.limit(0)).collect())


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "./a.ts", 3, 9), (2, "a.ts", 6, 7), (3, "../a.ts", 1, 1), (4, "/a.ts", 1, 1), (5, "new.ts", 1, 400)], FINDING)
    files = spark.createDataFrame([("a.ts", 5)], "path string, total_lines int")
    assert by_id(relevance.grounded(rows, files), "grounded", "end") == {1: (True, 5), 2: (False, 6), 3: (False, 1), 4: (False, 1), 5: (True, 400)}
    assert by_id(relevance.grounded(rows, files, files), "grounded")[5] == (False,)


def test_attribution_by_joins(spark):
    changed = spark.createDataFrame([("a.ts", "modified"), ("gone.ts", "deleted"), ("bare.ts", "modified")], "path string, status string")
    hunks = spark.createDataFrame([("a.ts", "+", 10, 12), ("a.ts", "-", 40, 41)], HUNK)
    rows = [(1, "a.ts", 13, 13, "t"), (2, "a.ts", 41, 50, "t"), (3, "a.ts", 70, 70, "t"), (4, "a.ts", 70, 70, "t"), (5, "gone.ts", 1, 1, "fixed"), (6, "gone.ts", 1, 1, "t"), (7, "x.ts", 1, 1, "t"), (8, "x.ts", 1, 1, "t"), (9, "a.ts", 90, 90, "t"), (10, "bare.ts", 1, 1, "t"), (11, "a.ts", 11, 41, "fixed")]
    found = spark.createDataFrame(rows, FINDING + ", title string").withColumn("message", F.col("title"))
    told = spark.createDataFrame([(4, "a.ts", 60, 60, "calls it", None), (8, "y.ts", 1, 1, None, "supporting_context"), (9, "./a.ts", 12, 12, None, None)], FINDING + ", causal_link string, tier string")
    got = by_id(gate.attributed(relevance.patch_flags(found, told, changed, hunks)), "attribution")
    assert got == {1: ("introduced_by_patch",), 2: ("fixed_by_patch",), 3: ("pre_existing",), 4: ("worsened_by_patch",), 5: ("fixed_by_patch",), 6: ("pre_existing",), 7: ("unrelated_to_patch",), 8: ("worsened_by_patch",), 9: ("introduced_by_patch",), 10: ("introduced_by_patch",), 11: ("fixed_by_patch",)}


def test_marked_sections_and_triggers(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n+x = 1  # noqa\ndiff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1 +1 @@\n+y = 2"
    diffs = spark.createDataFrame([(1, diff)], "diff_id long, diff string")
    found = spark.createDataFrame([(1, "A.py"), (2, "b.py")], "id long, path string")
    assert by_id(relevance.intent_in_section(found, diffs), "marked") == {1: (True,), 2: (False,)}
    changes, none = spark.createDataFrame([("a.py",)], "path string"), spark.createDataFrame([], "path string, kind string, name string, start_line int, end_line int")
    hunks = spark.createDataFrame([("a.py", "+", 3, 4)], HUNK)
    sym = spark.createDataFrame([("a.py", "function", "getUserToken", 1, 3)], none.schema)
    lines = spark.createDataFrame([("+", "y = lambda: 2"), ("-", "if x")], "side string, content string")
    semantic = lambda c, h, s, n: relevance.semantic_trigger(c, h, s, n).first().semantic
    assert semantic(changes, hunks, sym, lines.limit(0)) and semantic(changes, hunks.limit(0), none, lines)
    assert not semantic(changes, hunks.limit(0), none, lines.where("side = '-'")) and not semantic(changes.limit(0), hunks, sym, lines)
    security = lambda c, s: relevance.security_trigger(c, diffs, s).first().security
    assert not security(changes, none) and security(changes, sym) and security(spark.createDataFrame([("x/.env.local",)], "path string"), none)
    plan = {r.reviewer: r.runs for r in stages.scheduled(changes, diffs, hunks, none, lines).collect()}
    assert plan == {"structural": True, "semantic": True, "security": False}
    assert not any(r.runs for r in stages.scheduled(spark.createDataFrame([("README.md",), ("tests/a.py",)], "path string"), diffs, hunks, sym, lines).collect())


def test_diff_is_shortest_and_states_modes(spark):
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        ops = snapshot.line_operations(a, b)
        assert [x for o, x in ops if o != "+"] == a and [x for o, x in ops if o != "-"] == b
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert sum(o == " " for o, _ in ops) == row[-1]
    many = [str(i) for i in range(5000)]
    assert sum(o != " " for o, _ in snapshot.line_operations(many, many[1:2500] + ["x"] + many[2500:])) == 2
    assert snapshot.unified("f", None, "a", new_mode="100644").split("\n")[:3] == ["--- /dev/null", "+++ b/f", "new file mode 100644"]
    pairs = spark.createDataFrame([("f", "a", "b", "100644", "100755")], "path string, old string, new string, old_mode string, new_mode string")
    assert "old mode 100644\nnew mode 100755\n@@" in snapshot.with_diff(pairs).first().diff


def test_payload_brackets_and_repair_text(spark):
    assert payloads.parse_loosely('{"findings":[]} see [1]') == '{"findings":[]}' and payloads.parse_loosely("[1] or {2}") == "[1]"
    got = spark.range(1).select(payloads.repair_prompt(payloads.issues_of(F.lit('{"severity":"odd","category":"security","title":"t","file":"f","startLine":0,"confidence":0.5}'))).alias("x")).first().x
    assert "- Field 'severity': must be one of" in got and "- Field 'startLine': must be 1 or more" in got and "'title'" not in got
    import json

    assert json.loads(payloads.finding_schema())["properties"]["findings"]["items"]["properties"]["severity"]["enum"][0] == "critical"
    files = spark.createDataFrame([("a.py",), ("b.ts",), ("../c.py",)], "path string")
    assert [r.path for r in payloads.on_target(files, "ruff").collect()] == ["a.py"]


def test_only_nodes_on_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 1), (8, 8), (6, 9), (10, 11)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(r.node for r in graph.in_cycle(df).collect()) == [1, 2, 3, 5, 6, 8]
    got = {r.node: r.component for r in graph.strong_components(df).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 5: 6, 6: 6}
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(34)]
    reach = {n: {n} for n in range(26)}
    for _ in range(26):
        for a, b in edges:
            for k in reach:
                if a in reach[k]:
                    reach[k].add(b)
    want = {a for a, b in edges if a in reach[b]}
    assert {r.node for r in graph.in_cycle(spark.createDataFrame(edges, "src long, dst long")).collect()} == want


COMMITS = "oid string, parent string, nth int, message string, author string, generation long"


def test_references_and_log(spark):
    rows = [(f"{i:040x}", f"{i - 1:040x}" if i else None, 1, f"m{i}", "a", i) for i in range(12)] + [(f"{11:040x}", f"{5:040x}", 2, "m11", "a", 11)]
    commits = spark.createDataFrame(rows, COMMITS)
    refs = spark.createDataFrame([("HEAD", f"{11:040x}"), ("refs/heads/old", f"{4:040x}")], "name string, oid string")
    at = lambda spec: int(repository.resolve_ref(refs, commits, spec), 16)
    assert [at(x) for x in ("HEAD", "HEAD~3", "HEAD^^", "HEAD^2", "HEAD^2~1", "old", "HEAD~0", f"{7:040x}")] == [11, 8, 9, 5, 4, 4, 11, 7]
    for bad in ("none", "HEAD~99", "HEAD^3", "~1", "0000000"):
        with pytest.raises(RepositoryError):
            at(bad)
    assert [r.message for r in repository.commit_log(commits, f"{4:040x}", 3).collect()] == ["m4", "m3", "m2"]
    by = {r.name: r.exists for r in repository.ref_exists(refs, spark.createDataFrame([("HEAD",), ("x",)], "name string")).collect()}
    assert by == {"HEAD": True, "x": False}
    assert len(repository.parents(commits, spark.createDataFrame([(f"{11:040x}",)], "oid string")).collect()) == 2


def test_discovery_and_identity(spark, tmp_path):
    root = tmp_path / "r"
    (root / ".git").mkdir(parents=True)
    for p in ("packages/a", "packages/b", "packages/old", "x"):
        (root / p).mkdir(parents=True)
        (root / p / "package.json").write_text("{}")
    assert repository.git_root(str(root / "packages/a")) == str(root) and repository.git_root("/") is None
    assert [tuple(r) for r in repository.discover(spark, str(root)).collect()] == [(str(root), "single", ".")]
    (root / "package.json").write_text('{"workspaces": {"packages": ["x"]}}')
    assert [r.workspace for r in repository.discover(spark, str(root)).collect()] == ["x"]
    (root / "pnpm-workspace.yaml").write_text('packages:\n  - "packages/*"  # all\n  - \'!packages/old\'\nother: 1\n')
    got = repository.discover(spark, str(root / "x")).collect()
    assert [(r.kind, r.workspace) for r in got] == [("pnpm", "packages/a"), ("pnpm", "packages/b")]
    with_root = repository.absolute_workspaces(spark.createDataFrame([("packages/a",)], "path string"), "/r/", "pnpm").first()
    assert with_root.absolute == "/r/packages/a"
    config = '[core]\n\turl = no\n[remote "origin"]\n\turl = git@h:x.git\n[remote "b"]\n url = second\n'
    (root / ".git" / "config").write_text(config)
    assert repository.remote_url(config) == "git@h:x.git" and repository.remote_url("[core]") is None
    assert repository.remote_urls(spark.createDataFrame([(1, config), (2, "[core]\nurl=x")], "repository int, content string")).collect()[0].url == "git@h:x.git"
    here = repository.project_identity(str(root))
    assert len(here) == 16 and here == spark.range(1).select(repository.identity_of(F.lit(str(root)), F.lit("git@h:x.git")).alias("x")).first().x
    (root / "in").symlink_to(root / "x")
    (root / "out").symlink_to(tmp_path)
    assert repository.safe_link(str(root), "in") == str((root / "x").resolve()) and repository.safe_link(str(root), "out") is None and repository.is_link(str(root / "in"))
    links = spark.createDataFrame([("a/b", "../c"), ("a/b", "../../c"), ("f", None), ("l", "/etc"), ("l", "x/../../y")], "path string, target string")
    assert [r.contained for r in repository.contained_links(links).collect()] == [True, False, True, False, False]


def test_many_ignore_patterns(spark):
    texts = ["\n".join(f"dir{i}/" for i in range(260)), "*.log", "!keep.log"]
    files = spark.createDataFrame([("dir259/a",), ("a.log",), ("keep.log",), ("src/a.py",), ("node_modules/x",)], "path string")
    pats = readers.ignore_patterns(spark, texts)
    for bound in (10, 10_000):
        assert sorted(r.path for r in readers.not_ignored(files, pats, bound).collect()) == ["keep.log", "src/a.py"]


FILES = [
    ("src/base.ts", "export interface Store { get(): string }\nexport class Base {\n  run() {\n    return 1;\n  }\n}\n"),
    ("src/user.ts", "import { Base, Store } from './base';\n/** A user. */\nexport class User extends Base implements Store {\n  async get(): Promise<string> {\n    if (x) { return ''; }\n  }\n}\nconst hidden = (a) => {\n  return a;\n};\n// class Fake {}\nexport { hidden };\n"),
    ("src/user.test.ts", "import { User } from './user';\n"),
    ("lib/a.py", "class A:\n    def f(self):\n        pass\n"),
]


def test_symbols_and_reference_graph(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    nodes, edges, declared = reference.build(files)
    rows = {(r.path, r.name): (r.kind, r.start_line, r.end_line, r.parent, r.exported) for r in declared.collect()}
    assert rows["src/user.ts", "User"] == ("class", 3, 7, None, True) and rows["src/user.ts", "get"] == ("method", 4, 6, "User", False)
    assert rows["src/user.ts", "hidden"] == ("function", 8, 10, None, True) and ("src/user.ts", "Fake") not in rows and rows["lib/a.py", "f"][0] == "method"
    assert next(r.docstring for r in declared.collect() if r.name == "User") == "A user."
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    base = reference.lookup(reference.symbol_index(declared, source.heritage(files)), name="Base").first().id
    assert {r.dst for r in reference.implementations(edges, nodes, ids(base)).collect()} == {r.id for r in nodes.where("name = 'User'").collect()}
    assert {r.dst for r in reference.callers(edges, nodes, ids(base)).collect()} == {"src/user.ts"}
    assert [r.dst for r in reference.tests_of(edges, nodes, ids("src/user.ts")).collect()] == ["src/user.test.ts"] * 2
    assert {r.kind for r in reference.incoming(edges, ids("src/user.ts")).collect()} == {"imports", "tests", "imported_by", "called_by"}
    assert {(r.path, r.layer) for r in reference.layers(nodes).collect()} >= {("src/user.test.ts", "test"), ("src/user.ts", "domain")}
    index = reference.symbol_index(declared, source.heritage(files))
    assert [r.name for r in reference.lookup(index, implements="Store").collect()] == ["User"] and [r.name for r in reference.lookup(index, exported="hidden", path="src/user.ts").collect()] == ["hidden"]
    reference.save(nodes, edges, str(tmp_path / "g"), "c1", "k1")
    assert reference.load(spark, str(tmp_path / "g"), "c1", "k2") is None
    assert reference.load(spark, str(tmp_path / "g"), "c1", "k1")[1].count() == edges.count()


class Flaky(stages.RuleReviewer):
    calls = 0

    def review(self, request):
        type(self).calls += 1
        raise PermissionError("refused")


def test_stages(spark):
    lines = spark.createDataFrame([("a.py", "+", 3, "eval(x)"), ("a.py", "-", 3, "eval(y)")], "path string, side string, line int, content string")
    rules = stages.provider("rules", [(r"eval\(", "eval of input", "high", "security")])
    with pytest.raises(ConfigurationError):
        stages.provider("hosted")
    plan = spark.createDataFrame([("structural", True), ("semantic", True), ("security", False)], "reviewer string, runs boolean")
    found, warnings = stages.run_reviewers(plan, {"structural": rules}, {"lines": lines})
    assert [(r.title, r.start, r.reviewer) for r in found.collect()] == [("eval of input", 3, "structural")] and len(warnings) == 1
    with pytest.raises(ModelError):
        stages.run_reviewers(plan, {}, {"lines": lines})
    tries = []

    def call():
        tries.append(1)
        e = ConnectionError("x")
        e.status = 503 if len(tries) < 3 else 403
        raise e

    waits = []
    with pytest.raises(ModelError):
        stages.with_retries(call, waits.append)
    assert len(tries) == 3 and len(waits) == 2
    assert [stages.retry_delay(k, s, a, spread=lambda: 1.0) for k, s, a in ((0, None, None), (2, 500, None), (0, 429, 7.0), (3, 500, None), (0, 401, None), (0, 404, 2.0))] == [1.0, 4.0, 7.0, None, None, None]
    log = spark.createDataFrame([(1, 1, 503), (1, 2, 200), (2, 1, 401), (2, 2, 200), (3, 1, None), (3, 2, None), (3, 3, 429), (3, 4, 500), (3, 5, 200), (4, 1, 500)], "request int, seq int, status int")
    assert {r.request: (r.attempts, r.outcome) for r in stages.replay_retries(log).collect()} == {1: (2, "done"), 2: (1, "refused"), 3: (4, "exhausted"), 4: (1, "pending")}
    left = found.withColumns({"dropped_by": F.lit(None).cast("string"), "impact": F.lit(None).cast("string")})
    r = stages.critic(left, judge=lambda df: df.withColumn("critic_decision", F.lit("rejected"))).first()
    assert (r.critic_decision, r.claim, r.failure_mechanism, r.suggested_disposition) == ("rejected", "eval of input", "eval of input", "blocking")
    asked = []
    assert stages.critic(left.limit(0), judge=lambda df: asked.append(1) or df).count() == 0 and not asked

    def broken(df):
        raise ValueError("bad payload")

    assert stages.critic(left, judge=broken, repair=lambda df: df).count() == 1
    with pytest.raises(ModelError):
        stages.critic(left, judge=broken)
    one = spark.range(1).select(stages.role_of(F.lit("A Security review")).alias("a"), stages.role_of(F.lit(None).cast("string")).alias("b"), stages.finish_reason(F.lit("odd")).alias("c")).first()
    assert tuple(one) == ("reviewer.security.v1", "reviewer.structural.v1", "stop")


def test_templates(tmp_path):
    (tmp_path / "critic.v1.md").write_text("own")
    assert prompts.load("critic.v1", str(tmp_path)) == "own" and "{{diff}}" in prompts.load("critic.v1")
    with pytest.raises(KeyError):
        prompts.load("none")


def test_runtime(spark, caplog):
    peak, now, lock = [0], [0], threading.Lock()

    def work(x):
        with lock:
            now[0] += 1
            peak[0] = max(peak[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return x * x

    assert runtime.Pool(3).map(work, range(9)) == [x * x for x in range(9)] and peak[0] <= 3
    stop = runtime.Cancellation()
    stop.cancel("enough")
    with pytest.raises(runtime.Cancelled):
        runtime.Pool(2, stop).map(work, range(3))
    with pytest.raises(AdjudicaError):
        runtime.run_command([sys.executable, "-c", "import time; time.sleep(9)"], timeout=0.2, grace=1)
    got = runtime.run_command([sys.executable, "-c", "import sys; print(sys.stdin.read()); sys.exit(3)"], text="in")
    assert isinstance(got, subprocess.CompletedProcess) and (got.stdout.strip(), got.returncode) == ("in", 3)
    assert runtime.tool_version("no-such-tool-here") is None and runtime.tool_output(spark, {"x": ["no-such-tool-here"]}, ".").count() == 0
    log = runtime.logger("t.review")
    with caplog.at_level(logging.INFO, "t.review"):
        log.info("call %s", {"api_key": "abc123", "n": 1})
    assert "abc123" not in caplog.text and "[redacted]" in caplog.text
    box = []
    writer = runtime.SingleWriter()
    runtime.Pool(4).map(lambda x: writer.run(box.append, x), range(20))
    assert sorted(box) == list(range(20))
    assert tuple(runtime.overall(spark.createDataFrame([("a", "pass"), ("b", "warn")], "name string, status string")).first()) == ("warn", 0)
    assert tuple(runtime.overall(spark.createDataFrame([("a", "fail"), ("b", "warn")], "name string, status string")).first()) == ("fail", 2)
    assert "spark" in {r.name for r in runtime.doctor(spark, tools=()).collect()}


def test_screens_and_reports(spark):
    one = spark.range(1).select(
        report.snippet(F.lit("a\nb"), F.lit(9), F.lit(10)).alias("s"), report.colored_diff(F.lit("+a\n b")).alias("c"), report.patch_preview(F.lit("x"), F.lit("y")).alias("p")
    ).first()
    assert one.s == "      9 | a\n>    10 | b" and one.c == "\x1b[32m+a\x1b[0m\n b" and one.p == "- x\n+ y"
    text = report.evaluation_report(spark.createDataFrame([(0.5, 3)], "precision double, true_positives long")).first().value
    assert "| precision | 0.5 |" in text and "| true positives | 3 |" in text

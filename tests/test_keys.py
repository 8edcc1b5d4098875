"""Keys by what results are made from, and hunks of files."""

import hashlib
import random

from pyspark.sql import functions as F

from adjudica.operators import evaluate, gate, keys, linkage, snapshot


def sha(text, n=16):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def test_config_versions(spark):
    rows = [("a", "tsconfig.json", "{}"), ("a", "package.json", "p"), ("a", "src/package.json", "q"), ("b", "README", "r"), ("b", "ruff.toml", None)]
    got = {r.repository: r.version for r in keys.config_versions(spark.createDataFrame(rows, "repository string, path string, content string")).collect()}
    assert got == {"a": sha(f"package.json:{sha('p')}|tsconfig.json:{sha('{}')}"), "b": "no-config"}


def test_config_hash():
    assert keys.config_hash({}) == keys.config_hash({"version": "1.0.0", "review": {"maxFindings": 50}, "architecture": None}) == sha("{}", 8)
    assert keys.config_hash({"review": {"maxFindings": 7, "severity": "medium"}, "b": [1, {"x": 2}]}) == sha('{"b":[1,{"x":2}],"review":{"maxFindings":7}}', 8)


def test_paths(spark):
    rows = [("packages/a/x.ts", "packages/a/y/z.ts", True), ("packages/a/x", "packages/b/x", False), ("src/a", "src/a", False), ("packages", "packages", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(keys.same_package(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    rows = [("src/a.test.ts", True), ("x/tests/b.py", True), ("tests/b.py", True), ("lib/test_b.py", True), ("b_test.py", True), ("src/latest/b.py", False), ("contest/a.ts", False)]
    assert spark.createDataFrame(rows, "p string, want boolean").where(keys.is_test_path(F.col("p")) != F.col("want")).count() == 0
    rows = [("/r/x/a/b.ts", "a/b.ts"), ("a/./b\\c", "a/b/c"), ("../y/z", "../y/z"), ("/other/q", "../../other/q"), ("/r/xy", "../xy"), ("", "")]
    got = spark.createDataFrame(rows, "p string, want string").select(keys.ignore_path("/r/x", F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_hunks_and_windows(spark):
    diff = "diff --git a/src/a.ts b/src/a.ts\nindex 1..2\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1 +1 @@\n-x\n+y\n\\ No newline at end of file\ndiff --git a/lib/b.ts b/lib/b.ts\n+++ b/lib/b.ts\n@@ -2 +2 @@\n z\nmore"
    diffs = spark.createDataFrame([(1, diff), (2, "")], "diff_id int, diff string")
    wanted = spark.createDataFrame([(1, "a.ts"), (1, "./lib/b.ts"), (1, "none"), (1, "x/src/a.ts"), (2, "a.ts"), (1, "")], "diff_id int, path string")
    got = {(r.diff_id, r.path): r.hunks for r in snapshot.file_hunks(diffs, wanted).collect()}
    a = "--- a/src/a.ts\n@@ -1 +1 @@\n-x\n+y\n\\ No newline at end of file"
    assert got == {(1, "a.ts"): a, (1, "./lib/b.ts"): "@@ -2 +2 @@\n z", (1, "none"): "", (1, "x/src/a.ts"): a, (2, "a.ts"): "", (1, ""): ""}
    lines = spark.createDataFrame([("f", n) for n in (2, 8, 9, 30)], "file string, line int")
    assert sorted((r.start, r.end) for r in snapshot.context_windows(lines, ["file"], "line").collect()) == [(1, 12), (27, 33)]


def test_merges_and_routes(spark):
    schema = "id int, file string, start_line int, end_line int, severity_level int, confidence double, title string, message string, category string, reviewer string, evidence_key string, related_files array<string>, related_symbols array<string>"
    rows = [
        (1, "a", 1, 5, 2, 0.7, "one", "long message", "security", "r2", "k1", ["x", "y"], ["s"]),
        (2, "a", 5, 9, 4, 0.9, "two", "tie", "security", "r1", "k2", ["y", "z"], []),
        (3, "a", 9, 9, 1, 0.9, "three", "tie", "testing", "r1", "k1", None, ["t", "s"]),
        (4, "a", 20, 21, 1, 0.5, "four", "m", "testing", None, "k9", [], None),
        (5, "b", 1, 5, 3, 0.5, "five", "m", "testing", "r3", None, ["b"], ["b"]),
    ]
    got = {r.rep_id: r for r in linkage.before_critic(spark.createDataFrame(rows, schema), ["id"]).collect()}
    assert set(got) == {2, 4, 5}  # of equals the first
    two = got[2]
    assert (two.title, two.severity_level, two.confidence, two.start_line, two.end_line, two.members) == ("two", 4, 0.9, 1, 9, 3)
    assert (two.related_files, two.related_symbols, two.reviewers, two.evidence_keys) == (["x", "y", "z"], ["s", "t"], ["r1", "r2"], ["k1", "k2"])
    found = spark.createDataFrame([(i, d) for i, d in enumerate(["blocking", "rejected", "advisory", "informational", "advisory"])], "id int, final_disposition string")
    by, left = gate.routed(found)
    assert {d: sorted(r.id for r in df.collect()) for d, df in by.items()} == {"blocking": [0], "rejected": [1], "advisory": [2, 4], "informational": [3]}
    assert sorted(r.id for r in left.collect()) == [0, 2, 3, 4]


def test_exact_ranks(spark):
    rnd = random.Random(3)
    for values in ([5], [7, 7, 7], [rnd.randrange(10**6) for _ in range(3000)], [int(rnd.paretovariate(0.5)) for _ in range(2000)], [None, None, 3, 1], [-(10**12), 0, 10**12]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        ordered = sorted(values, key=lambda v: (v is not None, v))
        n = len(values)
        got = evaluate.nearest_ranks(df, "v", {"a": (0.0, False), "b": (0.5, False), "c": (0.95, True), "d": (1.0, True)}).first()
        assert (got.a, got.b, got.c, got.d) == tuple(ordered[min(n - 1, int(n * f))] for f in (0, 0.5, 0.95, 1)), values
    assert evaluate.nearest_ranks(df.where("v > 1e15"), "v", {"a": (0.5, True)}).collect()[0].a is None

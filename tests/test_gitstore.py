"""The git data source against git itself, on a packed repository with deltas, merges, tags and staged files."""

import os
import random
import shutil
import subprocess

import pytest

from adjudica.errors import RepositoryError
from adjudica.sources import gitstore, scopes

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git makes the repositories")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("git")
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "HOME": str(at)}
    for who in ("AUTHOR", "COMMITTER"):
        env |= {f"GIT_{who}_NAME": "An Öther", f"GIT_{who}_EMAIL": "a@example.org"}
    clock = [1_700_000_000]

    def git(*args, **kw):
        clock[0] += 60
        stamp = f"{clock[0]} +0200"
        return subprocess.run(["git", *args], cwd=at / "work", env=env | {"GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp}, check=True, capture_output=True, text=True, **kw).stdout

    rnd = random.Random(5)
    (at / "work" / "src" / "deep" / "er").mkdir(parents=True)
    git("init", "-q", "-b", "main")
    text = "".join(f"line {rnd.random()}\n" for _ in range(3000))
    for k in range(25):
        lines = text.splitlines(keepends=True)
        lines[rnd.randrange(len(lines))] = f"changed {k}\n"
        text = "".join(lines)
        (at / "work" / "src" / "big.txt").write_text(text)
        (at / "work" / "src" / "deep" / "er" / f"f{k % 7}.ts").write_text(f"export const x{k} = {k};\n" * 20)
        (at / "work" / "naïve name.md").write_text(f"é {k}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"step {k}\n\nwith a body")
        if k == 10:
            git("checkout", "-q", "-b", "side", "HEAD~4")
            (at / "work" / "side.bin").write_bytes(b"\0\1side")
            git("add", "-A")
            git("commit", "-q", "-m", "side")
            git("checkout", "-q", "main")
            git("merge", "-q", "--no-ff", "-m", "merge side", "side")
        if k == 12:
            git("tag", "-a", "v1", "-m", "one")
            git("tag", "light")
            git("tag", "-a", "v2", "-m", "of a tag", "v1")
    git("gc", "-q", "--aggressive")
    (at / "work" / "loose.txt").write_text("not packed\n")
    git("add", "-A")
    git("commit", "-q", "-m", "loose")
    return at / "work", git


def test_objects_equal_those_of_git(spark, repo):
    at, git = repo
    want = {tuple(x.split()) for x in git("cat-file", "--batch-all-objects", "--batch-check").splitlines()}
    found = gitstore.objects(spark, str(at), range_bytes=700).collect()
    assert len(found) == len(want) and {(r.oid, r.kind, str(r.size)) for r in found} == want
    again = gitstore.objects(spark, str(at)).select("oid", gitstore.F.sha1(gitstore.F.concat(gitstore.F.concat("kind", gitstore.F.lit(" "), gitstore.F.col("size").cast("string")).cast("binary"), gitstore.F.lit(b"\0"), "content")).alias("sum"))
    assert again.where("oid <> sum").count() == 0


def test_filters_reach_the_scan(spark, repo):
    at, git = repo
    head = git("rev-parse", "HEAD~3").strip()
    one = gitstore.objects(spark, str(at)).where(f"oid = '{head}'")
    assert [r.kind for r in one.collect()] == ["commit"]
    assert head not in one._jdf.queryExecution().executedPlan().toString()  # no filter is left to Spark
    reader = gitstore._Objects(str(at), {"range_bytes": "500"})
    assert list(reader.pushFilters([gitstore.EqualTo(("oid",), head), gitstore.EqualTo(("size",), 1)])) == [gitstore.EqualTo(("size",), 1)]
    parts = [p for p in reader.partitions() if p.pack]
    assert len(parts) == 1 and sum(b.num_rows for p in parts for b in reader.read(p)) == 1


def test_commits_references_and_parents(spark, repo):
    at, git = repo
    want = {tuple(x.split("|")) for x in git("log", "--all", "--format=%H|%T|%P|%an|%ae|%ct|%s").splitlines()}
    got = gitstore.commits(spark, str(at)).collect()
    assert {(r.oid, r.tree, " ".join(r.parents), r.author, r.email, str(r.time), r.message.split("\n")[0]) for r in got} == want
    refs = {r.name: r for r in gitstore.references(spark, str(at)).collect()}
    for name in ("HEAD", "refs/heads/main", "refs/heads/side", "refs/tags/v1", "refs/tags/v2", "refs/tags/light"):
        assert refs[name]["commit"] == git("rev-parse", f"{name}^{{commit}}").strip()
    assert refs["HEAD"].target == "refs/heads/main"
    edges = gitstore.commit_edges(gitstore.commits(spark, str(at)))
    assert {(r.oid, r.nth, r.parent) for r in edges.where("parent is not null").collect()} == {(o, k + 1, p) for o, _, ps, *_ in want for k, p in enumerate(ps.split())}


def test_snapshots_and_point_reads(spark, repo):
    at, git = repo
    revs = [git("rev-parse", r).strip() for r in ("HEAD", "HEAD~9", "side")]
    got = gitstore.snapshots(spark, str(at), spark.createDataFrame([(r,) for r in revs], "commit string"))
    want = set()
    for r in revs:
        for line in git("ls-tree", "-r", "-z", r).split("\0")[:-1]:
            left, _, path = line.partition("\t")
            want.add((r, path, left.split()[0], left.split()[2]))
    assert {(r.commit, r.path, r.mode, r.oid) for r in got.collect()} == want
    under = gitstore.snapshots(spark, str(at), spark.createDataFrame([(revs[0],)], "commit string"), ["src/deep", "side.bin"])
    assert {r.path for r in under.collect()} == {p for r, p, *_ in want if r == revs[0] and (p.startswith("src/deep/") or p == "side.bin")}
    read = {r.path: r.content for r in gitstore.read_at(spark, str(at), revs[0], ["src/big.txt", "./naïve name.md", "side.bin", "../x", "src", "none"]).collect()}
    assert read["src/big.txt"] == git("show", "HEAD:src/big.txt") and read["./naïve name.md"] == "é 24\n"
    assert [read[k] for k in ("side.bin", "../x", "src", "none")] == [None] * 4


@pytest.mark.parametrize("version", [2, 4])
def test_index_and_working_folder(spark, repo, version):
    at, git = repo
    git("update-index", "--index-version", str(version))
    want = {tuple(x.split("\t")[0].split()) + (x.split("\t")[1],) for x in git("ls-files", "--stage", "-z").split("\0")[:-1]}
    assert {(r.mode, r.oid, str(r.stage), r.path) for r in gitstore.index_entries(spark, str(at)).collect()} == want
    (at / "src" / "big.txt").write_text("short\n")
    (at / "new.txt").write_text("untracked\n")
    (at / "staged.txt").write_text("staged\n")
    os.remove(at / "side.bin")
    git("add", "staged.txt", "src/big.txt")
    (at / "src" / "big.txt").write_text("again\n")
    codes = {" ": "", "M": "modified", "A": "added", "D": "deleted"}
    plain = [(x[:2], x[3:]) for x in git("status", "--porcelain", "-z", "-uall").split("\0")[:-1]]
    assert {(r.path, r.status) for r in gitstore.staged(spark, str(at)).collect()} == {(p, codes[c[0]]) for c, p in plain if c[0] in "MAD"}
    assert {(r.path, r.status) for r in gitstore.unstaged(spark, str(at)).collect()} == {(p, "added" if c == "??" else codes[c[1]]) for c, p in plain if c == "??" or c[1] in "MD"}
    matrix = {r.path: (r["head"], r.workdir, r.stage) for r in gitstore.status(spark, str(at)).collect()}
    assert (matrix["src/big.txt"], matrix["new.txt"], matrix["staged.txt"], matrix["side.bin"], matrix["loose.txt"]) == ((1, 2, 3), (0, 2, 0), (0, 2, 2), (1, 0, 1), (1, 1, 1))
    git("reset", "-q", "--hard")
    os.remove(at / "new.txt")


def test_git_reads_what_is_written(spark, repo, tmp_path):
    _, git = repo
    files = spark.createDataFrame([(c, p, "100755" if p.endswith("sh") else "100644", bytearray(f"{p} of {c if p == 'a/b/c.txt' else ''}".encode())) for c in ("one", "two") for p in ("a/b/c.txt", "a/b.sh", "a.txt", "z")], "commit string, path string, mode string, content binary")
    history = spark.createDataFrame([("one", None, "x", 1000, "first"), ("two", "one", "x", 2000, "second")], "commit string, parent string, author string, time long, message string")
    made = {r["commit"]: r.oid for r in gitstore.write_repository(files, history, str(tmp_path / "bare")).collect()}
    bare = str(tmp_path / "bare")
    assert "error" not in git("--git-dir", bare, "fsck", "--full", "--strict")
    assert git("--git-dir", bare, "log", "--format=%H %s").split("\n")[:-1] == [f"{made['two']} second", f"{made['one']} first"]
    assert git("--git-dir", bare, "show", "main:a/b/c.txt") == "a/b/c.txt of two"
    got = gitstore.snapshots(spark, bare, spark.createDataFrame([(made["one"],)], "commit string"))
    assert {r.path for r in got.collect()} == {"a/b/c.txt", "a/b.sh", "a.txt", "z"}


def test_scopes_of_a_repository(spark, repo):
    at, git = repo
    found = scopes.Repository(spark, str(at))
    codes = {"M": "modified", "A": "added", "D": "deleted"}

    def named(*args):
        parts = git("diff", "--name-status", "--no-renames", "-z", *args).split("\0")[:-1]
        return {(p, codes[c]) for c, p in zip(parts[::2], parts[1::2], strict=True)}

    def got(kind, **names):
        return {(r.path, r.status) for r in found.changed(kind, **names).collect()}

    root = git("rev-list", "--max-parents=0", "HEAD").strip()
    assert got("commit", head="HEAD~2") == named("HEAD~3", "HEAD~2")
    assert got("commit", head=root) == named("4b825dc642cb6eb9a060e54bf8d69288fbee4904", root)
    assert got("range", spec="side..main") == named("side", "main") and got("range", spec="main...side") == named("main...side")
    assert got("branch", base="side") == named("side...HEAD")
    assert found.merge_base("side", "HEAD~5") == git("merge-base", "side", "HEAD~5").strip()
    assert [r.oid for r in found.log("HEAD", 8).collect()] == git("log", "-8", "--format=%H").split()
    merged = git("rev-list", "--merges", "HEAD").split()[0]
    assert found.resolve(f"{merged[:12]}^2~1") == git("rev-parse", f"{merged}^2~1").strip()
    assert found.resolve("HEAD~12") == git("rev-parse", "HEAD~12").strip()
    for bad in (("commit", {}), ("branch", {}), ("odd", {}), ("range", {"spec": "none..main"})):
        with pytest.raises((RepositoryError, ValueError)):
            found.sides(bad[0], **bad[1])
    (at / "loose.txt").write_text("not packed\nbut changed\n")
    (at / "bytes.bin").write_bytes(b"\0")
    diffs = {r.path: r.diff for r in found.diff("working-tree").collect()}
    assert set(diffs) == {"loose.txt"} and "+but changed" in diffs["loose.txt"] and "-not packed" not in diffs["loose.txt"]
    assert got("working-tree") == {("loose.txt", "modified"), ("bytes.bin", "added")} and got("staged") == set()
    os.remove(at / "bytes.bin")
    git("reset", "-q", "--hard")
    big = {r.path: r.diff for r in found.diff("commit", head="HEAD~2").collect()}["src/big.txt"]
    ours = [x for x in big.split("\n") if x[:1] in ("+", "-") and x[:3] not in ("+++", "---")]
    theirs = [x for x in git("diff", "HEAD~3", "HEAD~2", "--", "src/big.txt").split("\n") if x[:1] in ("+", "-") and x[:3] not in ("+++", "---")]
    assert sorted(ours) == sorted(theirs)

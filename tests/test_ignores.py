"""Nested ignore files against git."""

import os
import random
import shutil
import subprocess

import pytest

from adjudica.sources import ignores

TOP = "# comment\n\n*.log\n!keep.log\nbuild/\n/only-top\nsrc/gen\n**/deep\n*.tar.gz\ndoc/*.txt\n!doc/read.txt\na?c\n[xy]z\n\\#hash\ntrail  \nlib/**\n!lib/ok\nx/**/y\n*~\nnode_modules\n"
NESTED = {".gitignore": TOP, "src/.gitignore": "!*.log\nlocal\n/gen2\n*.o\n", "src/sub/.gitignore": "*.log\n!local\n", "doc/.gitignore": "!*.txt\nbad/\n"}


@pytest.mark.skipif(shutil.which("git") is None, reason="git is the measure")
def test_as_git(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in NESTED.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    rnd = random.Random(2)
    names = "a.log keep.log build only-top gen gen2 deep b.tar.gz c.txt read.txt abc xz yz #hash trail ok y x lib doc src sub local m.o q~ node_modules bad z".split()
    paths = {"/".join(rnd.choice(names) for _ in range(rnd.randrange(1, 5))) for _ in range(1500)}
    paths |= {f"{p}/{n}" for p in ("src", "src/sub", "doc", "lib", "x", "build") for n in names}
    told = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin"], input="\n".join(sorted(paths)), capture_output=True, text=True).stdout
    want = set(told.splitlines())
    rules = ignores.rules(spark.createDataFrame(list(NESTED.items()), "path string, content string"))
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in ignores.ignored(df, rules).where("ignored").collect()}
    # git asks the disk whether a path is a folder; what isn't there is a file, as here.
    assert got ^ want == set()
    assert 200 < len(want) < len(paths) - 200


def test_many_rules_are_joined_by_key(spark):
    text = "\n".join(f"dir{i}/\n*.ext{i}\nsrc/path{i}" for i in range(4000)) + "\n!src/path7\n"
    rules = ignores.rules(spark.createDataFrame([(".gitignore", text)], "path string, content string"))
    df = spark.createDataFrame([("dir3999/a",), ("a.ext5",), ("src/path7",), ("src/path8",), ("dir1",), ("src/a.py",)], "path string")
    out = ignores.ignored(df, rules)
    assert {r.path for r in out.where("ignored").collect()} == {"dir3999/a", "a.ext5", "src/path8"}
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()

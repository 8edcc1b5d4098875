import json

from pyspark.sql import functions as F

from adjudica.operators import source
from adjudica.plans import prompts

TS = "import React, { useState as s, type X } from 'react';\nimport * as ns from './util.js';\nimport './side';\nexport { y } from '@org/core/y';\nclass A<T> extends B implements C, D<E> {\n"
PY = "from . import util\nfrom ..pkg.mod import a as b, c\nimport os, json as j\n\nclass K(Base):\n    'Doc.'\n    def m(self):\n        pass\n\ndef _f(x): return x\n"


def files(spark):
    return spark.createDataFrame([("src/a.ts", TS), ("src/util.ts", ""), ("lib/x/m.py", PY), ("lib/x/util.py", ""), ("lib/pkg/mod.py", "def a(): pass\n"), ("packages/core/y.ts", ""), ("bad.py", "def (")], "path string, content string")


def test_imports(spark):
    got = {(r.path, r.specifier, r.name, r.alias, r.is_default, r.is_namespace) for r in source.imports(files(spark)).collect()}
    assert got == {
        ("src/a.ts", "react", "default", "React", True, False), ("src/a.ts", "react", "useState", "s", False, False), ("src/a.ts", "react", "X", "X", False, False), ("src/a.ts", "./util.js", "*", "ns", False, True),
        ("src/a.ts", "./side", None, None, None, None), ("src/a.ts", "@org/core/y", "y", "y", False, False), ("lib/x/m.py", ".", "util", "util", False, False), ("lib/x/m.py", "..pkg.mod", "a", "b", False, False),
        ("lib/x/m.py", "..pkg.mod", "c", "c", False, False), ("lib/x/m.py", "os", "*", "os", False, True), ("lib/x/m.py", "json", "*", "j", False, True),
    }


def test_heritage_and_symbols(spark):
    got = {(r.name, r.relation, r.base) for r in source.heritage(files(spark)).collect()}
    assert got == {("A", "extends", "B"), ("A", "implements", "C"), ("A", "implements", "D"), ("K", "extends", "Base")}
    sym = {(r.name, r.kind, r.start_line, r.end_line, r.parent, r.exported) for r in source.python_symbols(files(spark)).where("path = 'lib/x/m.py'").collect()}
    assert sym == {("K", "class", 5, 8, None, True), ("m", "method", 7, 8, "K", False), ("_f", "function", 10, 10, None, False)}


def test_resolution(spark):
    f = files(spark)
    found = source.imports(f)
    own = spark.createDataFrame([("@org/core", "packages/core")], "name string, path string")
    got = {(r.path, r.specifier): (r.resolved, r.is_external, r.is_workspace) for r in source.resolve_imports(found, f, {"~/": "src/"}, own).collect()}
    assert got["src/a.ts", "./util.js"] == ("src/util.ts", False, False)
    assert got["src/a.ts", "@org/core/y"] == ("packages/core/y.ts", False, True)
    assert got["lib/x/m.py", "..pkg.mod"] == ("lib/pkg/mod.py", False, False)
    assert got["src/a.ts", "react"] == (None, True, False) and got["lib/x/m.py", "os"][1]
    edges = source.call_edges(found, source.resolve_imports(found, f), source.python_symbols(f)).collect()
    assert [e.src for e in edges] == ["lib/x/m.py"]


def test_prompts_and_mentions(spark):
    assert prompts.render("a {{x}} {{#l}}[{{.}}]{{/l}} {{l}} {{no}}", {"x": 1, "l": ["p", "{{x}}"]}) == "a 1 [p][{{x}}] p\n{{x}} "
    row = spark.createDataFrame([("a.py", "x\n`` ```end")], "p string, c string").select(prompts.fence(F.col("p"), F.col("c")).alias("f"), source.mentions(F.lit("ab\na.b c"), F.lit("a.b"), F.lit(2), F.lit(2)).alias("m"), source.mentions(F.lit("ab\naxb"), F.lit("a.b"), F.lit(1), F.lit(2)).alias("k")).first()
    assert row.f == "```python\nx\n`` '''end\n```" and row.m and not row.k
    d = spark.range(1).select(prompts.diagnostics_section(F.array(F.struct(F.lit("high").alias("severity"), F.lit("f").alias("file"), F.lit(3).alias("line"), F.lit("tsc").alias("source"), F.lit("m").alias("message")))).alias("x")).first().x
    assert d == "- [HIGH] f:3 (tsc): m" and json.dumps(d)

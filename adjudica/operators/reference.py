"""Symbols of source files and the reference graph: nodes, edges, and lookups one step away.

Nodes are (id, kind, name, path, layer), edges (src, dst, kind); both are plain tables, so that every lookup is a filter or
an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.shared import store
from . import graph, source, tokens

def symbols(files: DataFrame, docs: bool = True) -> DataFrame:
    """source.SYMBOLS of Python, TypeScript and JavaScript files (path, content); other files have none. docs: whether the
    docstrings of scripts are asked for."""
    return source.python_symbols(files).unionByName(tokens.symbols(files, docs))


def heritage_edges(declared: DataFrame, clauses: DataFrame) -> DataFrame:
    """(src, dst, kind): symbols (path, name, kind) to all classes or interfaces, of any file, that their clauses
    (path, name, relation, base) name; both relations count as implementing."""
    ident = text.symbol_id(F.col("path"), F.col("name"), F.col("kind"))
    own = declared.where(F.col("kind").isin("class", "interface")).select("path", "name", ident.alias("src"))
    bases = declared.where(F.col("kind").isin("class", "interface")).select(F.col("name").alias("base"), ident.alias("dst"))
    return clauses.join(own, ["path", "name"]).join(bases, "base").where("src <> dst").select("src", "dst", F.lit("implements").alias("kind")).distinct()


def test_edges(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst, kind): test files to the files that their names or their imports (path, resolved) point to; a file that both
    point to is there twice."""
    tests = files.where(text.is_test_file(F.col("path"))).select("path").distinct()
    known = files.select(F.col("path").alias("dst")).distinct()
    named = tests.select(F.col("path").alias("src"), F.explode(text.production_candidates(F.col("path"))).alias("dst")).where("src <> dst").join(known, "dst", "left_semi")
    imported = resolved.where("resolved is not null").join(tests, "path", "left_semi").select(F.col("path").alias("src"), F.col("resolved").alias("dst")).distinct().join(known, "dst", "left_semi")
    plain = imported.where(~text.is_test_file(F.col("dst")))
    return named.select("src", "dst").unionAll(plain.select("src", "dst")).withColumn("kind", F.lit("tests"))


def build(files: DataFrame, aliases: dict[str, str] | None = None, packages: DataFrame | None = None, docs: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, symbols) of files (path, content). Every edge has its mirror. docs as in symbols()."""
    declared = store(symbols(files, docs), "symbols")
    at = text.layer(F.col("path")).alias("layer")
    nodes = files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), text.basename(F.col("path")).alias("name"), "path", at)
    ident = text.symbol_id(F.col("path"), F.col("name"), F.col("kind"))
    nodes = nodes.unionByName(declared.select(ident.alias("id"), F.lit("symbol").alias("kind"), "name", "path", at)).dropDuplicates(["id"])
    found = store(source.imports(files), "imports")
    resolved = store(source.resolve_imports(found, files, aliases, packages), "resolved")
    links = resolved.where("resolved is not null").select(F.col("path").alias("src"), F.col("resolved").alias("dst"), F.lit("imports").alias("kind"))
    calls = source.call_edges(found, resolved, declared)
    edges = links.unionByName(calls).unionByName(heritage_edges(declared, source.heritage(files))).unionByName(test_edges(files, resolved))
    return nodes, graph.reciprocal(edges), declared


# Lookups.


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(id, kind and columns of the node at the other end) of the edges of a kind that start at ids (id)."""
    return edges.where(F.col("kind") == kind).join(ids.select(F.col("id").alias("src")).distinct(), "src").select(F.col("src").alias("id"), F.col("dst"), F.col("kind").alias("edge")).join(nodes.withColumnRenamed("id", "dst"), "dst")


def callers(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, ids, "called_by")


def callees(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, ids, "calls")


def implementations(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, ids, "implemented_by")


def tests_of(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, ids, "tested_by")


def incoming(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, src, kind) of all edges that end at ids (id)."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst").select(F.col("dst").alias("id"), "src", "kind")


def layers(nodes: DataFrame) -> DataFrame:
    """(path, layer) of all files."""
    return nodes.where("kind = 'file'").select("path", "layer").distinct()


def symbol_index(declared: DataFrame, clauses: DataFrame) -> DataFrame:
    """Symbols with id, and the names that they extend and implement."""
    ident = text.symbol_id(F.col("path"), F.col("name"), F.col("kind")).alias("id")
    side = lambda rel: F.array_sort(F.collect_set(F.when(F.col("relation") == rel, F.col("base"))))
    stated = clauses.groupBy("path", "name").agg(side("extends").alias("extends"), side("implements").alias("implements"))
    none = F.array().cast("array<string>")
    rows = declared.select(ident, *declared.columns).join(stated, ["path", "name"], "left")
    return rows.withColumns({c: F.when(F.col("kind").isin("class", "interface"), F.coalesce(c, none)).otherwise(none) for c in ("extends", "implements")})


def lookup(index: DataFrame, ident: str | None = None, path: str | None = None, exported: str | None = None, name: str | None = None, extends: str | None = None, implements: str | None = None) -> DataFrame:
    """The index's symbols by id, file, name of an export, name, or what they extend or implement; all that are given hold."""
    tests: list[Column] = []
    for column, value in (("id", ident), ("path", path), ("name", name)):
        if value is not None:
            tests.append(F.col(column) == value)
    if exported is not None:
        tests.append(F.col("exported") & (F.col("name") == exported))
    tests += [F.array_contains(c, v) for c, v in (("extends", extends), ("implements", implements)) if v is not None]
    for test in tests:
        index = index.where(test)
    return index


def save(nodes: DataFrame, edges: DataFrame, path: str, commit: str, config: str) -> None:
    """The graph under its key, as two tables."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/commit={commit}/config={config}/{name}")


def load(spark, path: str, commit: str, config: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) saved under exactly this key, or None."""
    at = f"{path}/commit={commit}/config={config}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{at}/edges")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")

"""Readers that give DataFrames, and the small driver-side parsers of a run's parameters."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decode_text(content: Column) -> Column:
    """Text of a binary column; null for content with a NUL or that isn't UTF-8."""
    text = content.cast("string")
    return F.when(F.instr(text, "\x00") == 0, F.try_validate_utf8(text))


def file_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, oid, mode, content) of the files below a folder, read in parallel; the object id is a content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha2(F.col("content"), 256).alias("oid"), F.lit("100644").alias("mode"), decode_text(F.col("content")).alias("content"))


#: Always ignored, whatever the files say.
CRITICAL_IGNORES = (".git/", "node_modules/")


def ignore_patterns(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(ordinal, regex, negated) of ignore files, later ones overriding earlier; blank lines and comments are skipped."""
    rows = []
    for line in [*"\n".join(texts).splitlines(), *CRITICAL_IGNORES]:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[negated:]
        folder = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        body = glob_regex(p.lstrip("/"))[1:-1]
        rows.append((len(rows), ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), negated))
    return spark.createDataFrame(rows, "ordinal int, regex string, negated boolean")


def not_ignored(files: DataFrame, patterns: DataFrame, bound: int = 200) -> DataFrame:
    """files (path) whose last matching pattern, if any, is a negation. Patterns are a run's parameter: up to ``bound`` of
    them become nested conditions, more one fold over an array."""
    rows = patterns.orderBy("ordinal").select("regex", "negated").collect()
    if len(rows) <= bound:
        verdict = F.lit(True)
        for r in rows:
            verdict = F.when(F.col("path").rlike(r["regex"]), F.lit(r["negated"])).otherwise(verdict)
    else:
        each = F.array(*[F.struct(F.lit(r["regex"]).alias("regex"), F.lit(r["negated"]).alias("negated")) for r in rows])
        verdict = F.aggregate(each, F.lit(True), lambda ok, p: F.when(F.rlike("path", p["regex"]), p["negated"]).otherwise(ok))
    return files.where(verdict)


def parse_range(spec: str) -> tuple[str, str, bool]:
    """(base, head, symmetric) of a..b or a...b."""
    m = re.fullmatch(r"(.+?)(\.{2,3})(.+)", spec.strip())
    if not m:
        raise ValueError(f"not a range: {spec}")
    return m[1], m[3], m[2] == "..."


def resolve_scope(kind: str, base: str | None = None, head: str | None = None, spec: str | None = None) -> tuple[str, str]:
    """The pair of snapshots that a scope compares: working-tree, staged, commit, range or branch."""
    if kind == "working-tree":
        return "INDEX", "WORKDIR"
    if kind == "staged":
        return "HEAD", "INDEX"
    if kind == "commit":
        return f"{head}^", str(head)
    if kind == "range":
        a, b, _ = parse_range(spec or "")
        return a, b
    if kind == "branch":
        return f"merge-base({base},{head or 'HEAD'})", head or "HEAD"
    raise ValueError(f"unknown scope {kind}")


def merge_config(*layers: Mapping) -> dict:
    """Later layers over earlier: objects deeply, everything else (lists too) replaced; None keeps what is there."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
                out[k] = merge_config(out[k], v)
            elif v is not None:
                out[k] = merge_config(v) if isinstance(v, Mapping) else v
    return out


def env_config(prefix: str, env: Mapping[str, str] | None = None) -> dict:
    """PREFIX_SECTION_SOME_KEY=value as {section: {someKey: value}}; JSON, else a comma list, else text."""
    out: dict = {}
    for name, raw in (os.environ if env is None else env).items():
        if not name.startswith(prefix + "_"):
            continue
        section, _, key = name[len(prefix) + 1 :].lower().partition("_")
        head, *tail = key.split("_") if key else [section]
        camel = head + "".join(x.title() for x in tail)
        try:
            value = json.loads(raw)
        except ValueError:
            value = [x.strip() for x in raw.split(",")] if "," in raw else raw
        if key:
            out.setdefault(section, {})[camel] = value
        else:
            out[section] = value
    return out


EXPECTED = "id string, category string, expectedSeverity string, targetFile string, lineRange struct<start: int, end: int>, minConfidence double, titleContains string, defectKeywords array<string>, negativeVariantFile string, expectedNegativeFindings int, hasDefect boolean"


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Expected findings of a tree of fixture folders, with an explicit schema."""
    df = spark.read.schema(EXPECTED).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "expected.json").json(path)
    return df.withColumn("hasDefect", F.coalesce("hasDefect", F.lit(True)))

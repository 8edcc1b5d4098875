"""Ignore files of all folders at once: rules as a table, met by equi-joins, with the precedence of nested files.

A path is ignored if it or a folder above it is; of the rules that meet a path, the one of the deepest ignore file counts, and in
a file the last. Names, whole paths and extensions are looked up by key; only rules with other wildcards are tried as
patterns, and only on paths below their folder that begin as they do.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str:
    """A pattern of an ignore file, without slashes at its ends, as a regular expression over a path below the file's folder."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "/**":
            out, i = out + "/.+", len(pattern)
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while pattern[i : i + 1] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", pattern[i:])):
            inner = re.sub(r"([\[&~|])", r"\\\1", m[2])
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", i + len(m[0])
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def rules(files: DataFrame) -> DataFrame:
    """(folder, ordinal, kind, key, first, regex, negated, folders_only) of ignore files (path, content); folder ends in a slash, or
    is empty at the top. kind: name, path, extension or pattern."""

    @F.pandas_udf("string")
    def as_regex(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else pattern_regex(b))

    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    lines = files.select(folder.alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("ordinal", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")).where("line <> '' and not startswith(line, '#')")
    body = F.when(F.col("negated"), F.substring("line", 2, 1 << 20)).otherwise(F.col("line"))
    rows = lines.withColumn("negated", F.col("line").startswith("!")).withColumn("b", body)
    rows = rows.withColumn("folders_only", F.col("b").endswith("/")).withColumn("b", F.regexp_replace("b", "/$", ""))
    rows = rows.withColumn("anchored", F.contains("b", F.lit("/"))).withColumn("b", F.regexp_replace("b", "^/", ""))
    deep = F.col("b").rlike(r"^\*\*/[^/]+$")
    rows = rows.withColumn("anchored", F.col("anchored") & ~deep).withColumn("b", F.when(deep, F.substring("b", 4, 1 << 20)).otherwise(F.col("b"))).where("b <> ''")
    plain = ~F.col("b").rlike(r"[*?\[\\]")
    kind = F.when(plain & F.col("anchored"), "path").when(plain, "name").when(~F.col("anchored") & F.col("b").rlike(r"^\*\.[^*?\[\\/]+$"), "extension").otherwise("pattern")
    rows = rows.withColumn("kind", kind)
    key = F.when(F.col("kind") == "path", F.concat("folder", "b")).when(F.col("kind") == "name", F.col("b")).when(F.col("kind") == "extension", F.substring("b", 2, 1 << 20))
    first = F.when((F.col("kind") == "pattern") & F.col("anchored"), F.regexp_extract("b", r"^([^*?\[\\/]+)/", 1))
    whole = F.when(F.col("anchored"), F.col("b")).otherwise(F.concat(F.lit("**/"), "b"))
    return rows.select("folder", "ordinal", "kind", key.alias("key"), F.nullif(first, F.lit("")).alias("first"), as_regex(F.when(F.col("kind") == "pattern", whole)).alias("regex"), "negated", "folders_only")


def ignored(paths: DataFrame, found: DataFrame) -> DataFrame:
    """paths (path, of files) with ``ignored`` by rules()."""
    files = paths.select("path").distinct().withColumn("s", F.split("path", "/"))
    upto = lambda k: F.array_join(F.slice("s", F.lit(1), k), "/")
    steps = files.select("path", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k"))
    steps = steps.select("path", upto(F.col("k")).alias("prefix"), (F.col("k") < F.size("s")).alias("is_folder"))
    each = steps.select("prefix", "is_folder").distinct().withColumn("s", F.split("prefix", "/")).withColumn("name", F.element_at("s", -1))
    # The folders above, as far as they have rules.
    above = each.select("prefix", "is_folder", "name", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("k"))
    above = above.select("prefix", "is_folder", "name", F.when(F.col("k") == 0, "").otherwise(F.concat(upto(F.col("k")), F.lit("/"))).alias("folder"), F.get("s", F.col("k")).alias("first"))
    above = above.join(found.select("folder").distinct(), "folder", "left_semi")
    of = lambda kind: found.where(F.col("kind") == kind)
    mark = ("prefix", "is_folder", "folder", "ordinal", "negated", "folders_only")
    dots = F.filter(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), i, F.length("name"))), lambda x: x.startswith("."))
    hits: list[DataFrame] = [
        above.join(of("name").withColumnRenamed("key", "name").drop("first"), ["folder", "name"]).select(*mark),
        each.join(of("path").select(F.col("key").alias("prefix"), *mark[2:]), "prefix").select(*mark),
        above.where(F.contains("name", F.lit("."))).withColumn("key", F.explode(dots)).join(of("extension").drop("first"), ["folder", "key"]).select(*mark),
    ]
    globs = of("pattern").select("folder", F.col("first").alias("_first"), "regex", *mark[3:])
    rest: Column = F.expr("substring(prefix, length(folder) + 1)")
    for begins in (True, False):
        some = globs.where(F.col("_first").isNotNull()) if begins else globs.where(F.col("_first").isNull())
        pairs = above.join(some.withColumnRenamed("_first", "first"), ["folder", "first"]) if begins else above.join(some.drop("_first"), "folder")
        hits.append(pairs.where(F.rlike(rest, F.col("regex"))).select(*mark))
    all_ = hits[0]
    for h in hits[1:]:
        all_ = all_.unionByName(h)
    last = F.max_by(~F.col("negated"), F.struct(F.length("folder"), "ordinal"))
    verdict = all_.where("is_folder or not folders_only").groupBy("prefix", "is_folder").agg(last.alias("_out"))
    out = steps.join(verdict.where("_out"), ["prefix", "is_folder"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(out, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))

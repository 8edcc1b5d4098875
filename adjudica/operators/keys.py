"""Keys that name a result by what it was made from: configuration files, sources and tools."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Files whose content is the configuration of tools, and defaults of settings by section, which name nothing. Fixed values.
CONFIG_FILES = ("tsconfig.json", "biome.json", "biome.jsonc", ".biome.json", "ruff.toml", "pyproject.toml", "pyrightconfig.json", ".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs", "package.json")
DEFAULTS: dict[str, dict] = {
    "": {"version": "1.0.0", "rules": [], "ignore": []},
    "project": {"name": "unnamed-project"},
    "review": {"severity": "medium", "failOnSeverity": "critical", "maxFindings": 50, "minConfidence": 0.6},
    "architecture": {"boundaries": [], "forbiddenDependencies": []},
}


def _short(joined: Column) -> Column:
    return F.substring(F.sha2(joined, 256), 1, 16)


def config_versions(files: DataFrame) -> DataFrame:
    """(repository, version) of files (repository, path, content): a hash of the configuration files at the top of each
    repository, by name; ``no-config`` where there is none."""
    known = F.when(F.col("path").isin(*CONFIG_FILES) & F.col("content").isNotNull(), F.concat("path", F.lit(":"), text.content_hash(F.col("content"))))
    found = files.groupBy("repository").agg(F.array_sort(F.collect_list(known)).alias("h"))  # a few for each repository
    return found.select("repository", F.when(F.size("h") == 0, "no-config").otherwise(_short(F.array_join("h", "|"))).alias("version"))


def files_hashes(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, files_hash, file_count) of files (by, path, content): the hash of their contents' hashes in the order of paths; a
    file without content counts as missing."""
    own = F.struct("path", F.coalesce(text.content_hash(F.col("content")), F.lit("missing")).alias("hash"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["hash"]), "|")
    return files.groupBy(*by).agg(text.content_hash(listed).alias("files_hash"), F.count("*").cast("string").alias("file_count"))


def diagnostics_keys(files: DataFrame, by: list[str], tools: list[str], version: str) -> DataFrame:
    """(by, key) of a collection of diagnostics: its files, tools, and the configuration's version."""
    parts = F.create_map(F.lit("filesHash"), "files_hash", F.lit("fileCount"), "file_count", F.lit("tools"), F.lit(",".join(sorted(tools))), F.lit("configVersion"), F.lit(version))
    return files_hashes(files, by).select(*by, text.cache_key(parts).alias("key"))


def tool_keys(files: DataFrame, by: list[str], tool: str, tool_version: str, version: str) -> DataFrame:
    """(by, key) of one tool's result."""
    parts = F.create_map(F.lit("tool"), F.lit(tool), F.lit("toolVersion"), F.lit(tool_version), F.lit("filesHash"), "files_hash", F.lit("fileCount"), "file_count", F.lit("configVersion"), F.lit(version))
    return files_hashes(files, by).select(*by, text.cache_key(parts).alias("key"))


def config_hash(config: Mapping) -> str:
    """8 hex digits of a run's settings, without defaults and empty sections, keys in order."""
    same = lambda a, b: json.dumps(a) == json.dumps(b)

    def stated(value: Mapping, section: str) -> dict:
        out = {}
        for key in sorted(value):
            entry, usual = value[key], DEFAULTS.get(section, {})
            if (section == "" and key == "architecture" and entry is None) or (key in usual and same(entry, usual[key])):
                continue
            if isinstance(entry, Mapping):
                entry = stated(entry, key)
                if not entry:
                    continue
            out[key] = entry
        return out

    return hashlib.sha256(json.dumps(stated(config, ""), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:8]


def same_package(a: Column, b: Column) -> Column:
    """Whether both paths lie in one folder of packages/."""
    name = lambda p: F.nullif(F.regexp_extract(p, r"^packages/([^/]+)", 1), F.lit(""))
    return F.coalesce(name(a) == name(b), F.lit(False))


def is_test_path(path: Column) -> Column:
    """The reference graph's sign of a test, wider than text.is_test_file: by folders and marks anywhere in the path."""
    p = F.lower(path)
    marks = [F.contains(p, F.lit(x)) for x in (".test.", ".spec.", "__tests__", "/test/", "/tests/")]
    ends = [p.startswith("test/"), p.startswith("tests/"), p.endswith("_test.py"), F.substring_index(p, "/", -1).startswith("test_")]
    out = F.lit(False)
    for x in (*marks, *ends):
        out = out | x
    return out


def ignore_path(root: str, path: Column) -> Column:
    """A path as ignore patterns see it: from the root, with forward slashes; one outside begins with '..'."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    step = lambda at, x: F.when(x.isin("", "."), at).when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    base = [x for x in root.split("/") if x]
    shared = F.lit(0)
    for k in range(len(base), 0, -1):
        shared = F.when(shared > 0, shared).when(F.array_join(F.slice(parts, 1, k), "/") == "/".join(base[:k]), k).otherwise(0)
    rest = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.lit(len(base)) - shared), F.slice(parts, shared + 1, F.greatest(F.size(parts), F.lit(1)))), "/")
    return F.regexp_replace(rest, r"\\", "/")

"""Repositories: roots and workspaces, references and commits, snapshots, identity, symbolic links.

What a run asks about its own working folder is answered on the driver (a few small files); commits, references, snapshots
and manifests are tables, so that many repositories are read alike.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RepositoryError
from ..functions import text
from ..operators.history import CommitIndex


def git_root(start: str) -> str | None:
    """The folder at or above start that has a .git folder, or a .git file that points to a worktree."""
    for at in (here := Path(start).resolve(), *here.parents):
        mark = at / ".git"
        if mark.is_dir() or (mark.is_file() and mark.read_text(errors="replace").startswith("gitdir:")):
            return str(at)
    return None


def _manifest(root: Path, name: str) -> dict:
    try:
        found = json.loads((root / name).read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def _listed(value) -> list[str]:
    if isinstance(value, dict):
        value = value.get("packages")
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def yaml_list(source: str, key: str) -> list[str]:
    """The items of a top-level list of plain or quoted scalars in YAML."""
    out, inside = [], False
    for line in source.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if m := re.match(rf"{re.escape(key)}\s*:\s*(\[.*\])?$", body):
            inside = True
            out += [x.strip().strip("'\"") for x in (m[1] or "[]")[1:-1].split(",") if x.strip()]
        elif inside and (m := re.match(r"\s*-\s+(.+)$", body)):
            out.append(m[1].strip().strip("'\""))
        elif body and not body.startswith((" ", "-")):
            inside = False
    return out


def workspace_patterns(root: str) -> tuple[str, list[str]] | None:
    """(kind, patterns) of a repository of several packages, by the first that states them: pnpm, npm or yarn, turbo, nx."""
    at = Path(root)
    pnpm = at / "pnpm-workspace.yaml"
    if pnpm.is_file() and (found := yaml_list(pnpm.read_text(errors="replace"), "packages")):
        return "pnpm", found
    package = _listed(_manifest(at, "package.json").get("workspaces"))
    if package:
        return ("yarn" if (at / "yarn.lock").exists() else "npm"), package
    if (at / "turbo.json").is_file():
        return "turbo", ["apps/*", "packages/*"]
    if nx := _manifest(at, "nx.json"):
        layout = nx.get("workspaceLayout") or {}
        return "nx", [f"{layout.get('appsDir', 'apps')}/*", f"{layout.get('libsDir', 'libs')}/*"]
    return None


def workspaces(manifests: DataFrame, patterns: list[str]) -> DataFrame:
    """(path) of the folders whose package.json is in manifests (path): those that a pattern names and no negated one does."""
    wanted = [text.glob_regex(p.strip("/")) for p in patterns if not p.startswith("!")]
    barred = [text.glob_regex(p[1:].strip("/")) for p in patterns if p.startswith("!")]
    folders = manifests.where(F.col("path").endswith("/package.json")).select(F.regexp_replace(text.normalize_path(F.col("path")), "/package\\.json$", "").alias("path")).distinct()
    at = F.col("path")
    hit = lambda some: at.rlike("|".join(some)) if some else F.lit(False)
    return folders.where(hit(wanted) & ~hit(barred))


def absolute_workspaces(found: DataFrame, root: str, kind: str) -> DataFrame:
    """(path, absolute, kind) of workspaces (path) of a repository."""
    return found.select("path", F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("absolute"), F.lit(kind).alias("kind"))


def snapshot_workspaces(snapshot: DataFrame, patterns: list[str]) -> DataFrame:
    """workspaces() of a snapshot's files (path, …), sorted within each partition of the output by path."""
    return workspaces(snapshot.select("path"), patterns).sort("path")


def discover(spark: SparkSession, start: str) -> DataFrame:
    """(root, kind, workspace): a repository's packages, or one row for the root itself if it has but one."""
    root = git_root(start)
    if root is None:
        raise RepositoryError(f"no repository at or above {start}")
    stated = workspace_patterns(root)
    names: list[str] = []
    if stated:
        found = [os.path.relpath(d, root) for d, sub, files in os.walk(root) if "package.json" in files and not {".git", "node_modules"} & set(Path(d).parts)]
        rows = spark.createDataFrame([(f"{n}/package.json",) for n in found], "path string")
        names = [r["path"] for r in snapshot_workspaces(rows, stated[1]).collect()]  # one repository's packages
    rows = [(root, stated[0] if stated else "single", n) for n in names] or [(root, "single", ".")]
    return spark.createDataFrame(rows, "root string, kind string, workspace string")


# Commits are (oid, parent, nth, message, author, generation), a row for each parent, nth from 1; references (name, oid).

_RELATIVE = re.compile(r"([~^])(\d*)")


def parse_revision(spec: str) -> tuple[str, list[tuple[str, int]]]:
    """(name, steps) of a revision: ~n steps along first parents, ^n the n-th parent."""
    spec = spec.strip()
    m = re.fullmatch(r"([^~^]+)((?:[~^]\d*)*)", spec)
    if not m:
        raise RepositoryError(f"not a revision: {spec!r}")
    return m[1], [(op, int(n) if n else 1) for op, n in _RELATIVE.findall(m[2])]


def ref_exists(refs: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) with ``exists``."""
    there = refs.select("name", F.lit(True).alias("exists")).distinct()
    return names.join(there, "name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


#: Steps along first parents that are looked up one by one; more go by the index.
FEW_STEPS = 8


def resolve_ref(refs: DataFrame, commits: DataFrame, spec: str, index: CommitIndex | None = None) -> str:
    """The oid of a revision: a branch or tag, a full or abbreviated oid, then its steps: by the history's index, if one is
    given or there are many steps, else by a lookup for each."""
    name, steps = parse_revision(spec)
    tried = (name, f"refs/heads/{name}", f"refs/tags/{name}", f"refs/remotes/{name}")
    found = {r["name"]: r["oid"] for r in refs.where(F.col("name").isin(*tried)).limit(len(tried)).collect()}
    oid = next((found[t] for t in tried if t in found), None)
    if oid is None and re.fullmatch("[0-9a-fA-F]{4,40}", name):
        short = [r["oid"] for r in commits.where(F.col("oid").startswith(name.lower())).select("oid").distinct().limit(2).collect()]
        if len(short) > 1:
            raise RepositoryError(f"{name} is ambiguous")
        oid = short[0] if short else None
    if oid is None:
        raise RepositoryError(f"unknown revision {spec!r}")
    index = index or (CommitIndex(commits, "oid") if sum(n for op, n in steps if op == "~") > FEW_STEPS else None)
    for op, n in steps:
        if index is not None:
            start = commits.sparkSession.createDataFrame([("at", oid, n)], "ref string, oid string, n int")
            got = (index.back(start) if op == "~" else index.parent(start)).limit(1).collect()
            found_at = got[0]["oid"] if got else None
        else:
            found_at = oid
            for _ in range(n if op == "~" else min(n, 1)):
                nth = 1 if op == "~" else n
                got = commits.where((F.col("oid") == found_at) & (F.col("nth") == nth) & F.col("parent").isNotNull()).select("parent").limit(1).collect()
                found_at = got[0]["parent"] if got else None
                if found_at is None:
                    break
        if found_at is None:
            raise RepositoryError(f"{oid} has no {op}{n}, asked by {spec!r}")
        oid = found_at
    return oid


def commit_log(commits: DataFrame, oid: str, depth: int = 100, order: str = "generation", index: CommitIndex | None = None) -> DataFrame:
    """(oid, message, author) of the latest ``depth`` commits reachable from oid, by ``order`` (a commits column that rises
    from parents to children); an index of the history, if there is one, spares making it."""
    last = (index or CommitIndex(commits, order)).log(oid, depth)
    each = commits.groupBy("oid").agg(F.first("message").alias("message"), F.first("author").alias("author"))
    return last.join(each, "oid").orderBy(F.desc("at"), "oid").select("oid", "message", "author")


def parents(commits: DataFrame, oids: DataFrame) -> DataFrame:
    """(oid, nth, parent) of the commits asked for."""
    return commits.where("parent is not null").join(oids.select("oid").distinct(), "oid", "left_semi").select("oid", "nth", "parent")


def read_files(snapshot: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with the text of the snapshot's files (path, content): null if absent, binary, or outside the tree."""
    outside = wanted["path"].startswith("/") | F.exists(F.split(wanted["path"], "/"), lambda x: x == "..")
    rows = wanted.select("path", F.when(~outside, text.normalize_path(F.col("path"))).alias("_p"))
    there = snapshot.select(text.normalize_path(F.col("path")).alias("_p"), F.when(F.instr("content", "\x00") == 0, F.col("content")).alias("content"))
    return rows.join(there, "_p", "left").select("path", "content")


def safe_link(root: str, path: str) -> str | None:
    """Where a path really leads, or None if that is outside the root or the link is broken or circular."""
    try:
        real, base = os.path.realpath(os.path.join(root, path), strict=True), os.path.realpath(root)
    except OSError:
        return None
    return real if real == base or real.startswith(base.rstrip("/") + "/") else None


def is_link(path: str) -> bool:
    return os.path.islink(path)


def contained_links(links: DataFrame) -> DataFrame:
    """links (path, target; target null for a plain file) with ``contained``: a link stays inside the tree."""
    folder = F.when(F.instr("path", "/") > 0, text.dirname(F.col("path"))).otherwise("")
    whole = F.concat_ws("/", folder, "target")
    step = lambda at, x: F.when(x == "..", F.when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))).when(x.isin("", ".") | (F.element_at(F.concat(at, F.array(F.lit(""))), 1) == ".."), at).otherwise(F.concat(at, F.array(x)))
    walked = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    ok = ~F.col("target").startswith("/") & (F.coalesce(F.get(walked, F.lit(0)), F.lit("")) != "..")
    return links.withColumn("contained", F.col("target").isNull() | ok)


_REMOTE = re.compile(r'\s*\[\s*remote\s+"')


def remote_url(config: str) -> str | None:
    """The first url of a remote section in the text of a git configuration."""
    inside = False
    for line in config.splitlines():
        if line.strip().startswith("["):
            inside = bool(_REMOTE.match(line))
        elif inside and (m := re.match(r"\s*url\s*=\s*(\S.*?)\s*$", line)):
            return m[1]
    return None


def remote_urls(configs: DataFrame) -> DataFrame:
    """(repository, url) of configurations (repository, content): the first url of a remote section of each."""
    section = F.regexp_extract("content", r'(?ms)^\s*\[\s*remote\s+"[^"]*"\s*\](?:(?!^\s*\[).)*?^\s*url\s*=\s*(\S[^\n]*?)\s*$', 1)
    return configs.select("repository", F.nullif(section, F.lit("")).alias("url"))


def project_identity(root: str) -> str:
    """16 hex digits of the root and its remote's url, or else of its device and inode."""
    at = os.path.abspath(root)
    config = Path(at, ".git")
    if config.is_file():  # a worktree: its folder names the common one
        home = Path(at, config.read_text().partition("gitdir:")[2].strip())
        common = home / "commondir"
        config = (home / common.read_text().strip()) if common.is_file() else home
    try:
        url = remote_url((config / "config").read_text(errors="replace"))
    except OSError:
        url = None
    if url is None:
        try:
            stat = os.stat(at)
            url = f"{stat.st_dev}:{stat.st_ino}"
        except OSError:
            url = ""
    return hashlib.sha256(f"{at}|{url}".encode()).hexdigest()[:16]


def identity_of(root: Column, url: Column) -> Column:
    """project_identity() of columns."""
    return F.substring(F.sha2(F.concat_ws("|", root, url), 256), 1, 16)


def folder_bytes(files: DataFrame, root: str) -> DataFrame:
    """One row, ``bytes``: the sizes of all files (path, length) below a folder."""
    return files.where(F.col("path").startswith(root.rstrip("/") + "/")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))

"""Git repositories as tables: a data source over object stores, references and index files, and what Spark makes of it.

``spark.read.format("git_store").option("path", …).option("table", "objects" | "refs" | "index")``. Objects are read in
parallel by byte ranges of the packs; filters on ``oid`` and ``kind`` are pushed down: an oid is looked up in the pack
index by its first byte's fan-out, and what isn't wanted isn't inflated. Deltas are applied to bases that lie anywhere in
the pack. Paths are those that executors see, so on a cluster the repository stands in a mounted shared folder.

Commits, tree entries and snapshots are DataFrame expressions over the objects: commits and trees are split by regular
expressions, and snapshots go down the trees with one join for each level, of all commits and folders asked for at once.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..errors import RepositoryError
from ..functions import text
from ..operators import snapshot
from ..plans.shared import folder, store
from .readers import decode_text

SCHEMAS = {
    "objects": "oid string, kind string, size long, content binary",
    "refs": "name string, oid string, target string",
    "index": "path string, oid string, mode string, stage int, size long, mtime long",
}
#: Numbers of object types in packs, fixed by the format; 6 and 7 are deltas against an offset and an oid.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
RANGE_BYTES, CACHE_BYTES, BATCH_BYTES = 64_000_000, 64_000_000, 8_000_000


def git_dirs(path: str) -> tuple[Path, Path]:
    """The repository's own folder and the common one (they differ in a linked worktree), for a working or a bare folder."""
    at = Path(path)
    own = at / ".git" if (at / ".git").exists() else at
    if own.is_file():
        own = (at / own.read_text().partition("gitdir:")[2].strip()).resolve()
    if not (own / "HEAD").is_file():
        raise RepositoryError(f"no repository in {path}")
    link = own / "commondir"
    return own, (own / link.read_text().strip()).resolve() if link.is_file() else own


def object_folders(common: Path) -> list[Path]:
    """The store's object folder and its alternates."""
    out, left = [], [common / "objects"]
    while left:
        at = left.pop(0)
        if at.is_dir() and at not in out:
            out.append(at)
            more = at / "info" / "alternates"
            if more.is_file():
                left += [(at / line).resolve() for line in more.read_text().splitlines() if line and not line.startswith("#")]
    return out


def _varint(data, at: int) -> tuple[int, int]:
    """A little-endian number of seven bits a byte."""
    value = shift = 0
    while True:
        c = data[at]
        at += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, at


def _offset(data, at: int) -> tuple[int, int]:
    """A big-endian number of seven bits a byte, in which no value has two forms."""
    value = data[at] & 127
    while data[at] > 127:
        at += 1
        value = (value + 1) << 7 | data[at] & 127
    return value, at + 1


def patched(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copies of ranges, and literal bytes."""
    had, at = _varint(delta, 0)
    size, at = _varint(delta, at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op < 128:
            out += delta[at : at + op]
            at += op
            continue
        parts = [0] * 7
        for k in range(7):
            if op >> k & 1:
                parts[k] = delta[at]
                at += 1
        start = int.from_bytes(bytes(parts[:4]), "little")
        out += base[start : start + (int.from_bytes(bytes(parts[4:]), "little") or 0x10000)]
    if had != len(base) or size != len(out):
        raise RepositoryError("a delta doesn't fit its base")
    return bytes(out)


class Pack:
    """A pack and its index, mapped. Objects are known by their offsets; recent ones are remembered up to CACHE_BYTES."""

    def __init__(self, path: str):
        self.path = path
        with open(path[:-5] + ".idx", "rb") as f:
            self._idx = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._idx[:8] != b"\xfftOc\0\0\0\2":
            raise RepositoryError(f"{path}: only pack indexes of version 2 are read")
        self.fan = np.frombuffer(self._idx, ">u4", 256, 8)
        n = self.n = int(self.fan[-1])
        self.oids = np.frombuffer(self._idx, np.uint8, n * 20, 1032).reshape(n, 20)
        short = np.frombuffer(self._idx, ">u4", n, 1032 + n * 24).astype(np.int64)
        large = short >> 31 == 1
        if large.any():
            wide = np.frombuffer(self._idx, ">u8", int(large.sum()), 1032 + n * 28).astype(np.int64)
            short[large] = wide[short[large] & 0x7FFFFFFF]
        self.offsets = short
        with open(path, "rb") as f:
            self._data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self._recent: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self._held = 0

    def find(self, oid: bytes) -> int | None:
        """The offset of an object, by binary search among those of its first byte."""
        a, b = int(self.fan[oid[0] - 1]) if oid[0] else 0, int(self.fan[oid[0]])
        while a < b:
            mid = (a + b) // 2
            here = self.oids[mid].tobytes()
            if here == oid:
                return int(self.offsets[mid])
            a, b = (mid + 1, b) if here < oid else (a, mid)
        return None

    def _header(self, at: int) -> tuple[int, int | None, int]:
        """(type, base's offset of a delta, where the compressed bytes begin)."""
        start, kind = at, self._data[at] >> 4 & 7
        while self._data[at] > 127:
            at += 1
        at += 1
        if kind == 6:
            back, at = _offset(self._data, at)
            return kind, start - back, at
        if kind == 7:
            base = self.find(self._data[at : at + 20])
            if base is None:
                raise RepositoryError(f"{self.path}: a delta's base isn't in the pack")
            return kind, base, at + 20
        return kind, None, at

    def kind(self, at: int) -> str:
        """An object's type, from headers alone."""
        while True:
            kind, base, _ = self._header(at)
            if base is None:
                return KINDS[kind]
            at = base

    def _inflate(self, at: int) -> bytes:
        engine, out = zlib.decompressobj(), []
        while not engine.eof:
            out.append(engine.decompress(self._data[at : at + 65536]))
            at += 65536
        return b"".join(out)

    def read(self, offset: int) -> tuple[str, bytes]:
        deltas, at = [], offset
        while at not in self._recent:
            kind, base, data = self._header(at)
            if base is None:
                self._keep(at, (KINDS[kind], self._inflate(data)))
                break
            deltas.append((at, data))
            at = base
        kind, content = self._recent[at]
        self._recent.move_to_end(at)
        for at, data in reversed(deltas):
            content = patched(content, self._inflate(data))
            self._keep(at, (kind, content))
        return kind, content

    def _keep(self, at: int, found: tuple[str, bytes]) -> None:
        self._recent[at] = found
        self._held += len(found[1])
        while self._held > CACHE_BYTES and len(self._recent) > 1:
            self._held -= len(self._recent.popitem(last=False)[1][1])


class _Range(InputPartition):
    """Objects of a pack from an offset up to another, or those of loose folders; ``before``: packs that come first."""

    def __init__(self, pack: str | None = None, start: int = 0, end: int = 0, before: tuple[str, ...] = (), folders: tuple[str, ...] = ()):
        super().__init__(None)
        self.pack, self.start, self.end, self.before, self.folders = pack, start, end, before, folders


class _Objects(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.range_bytes = path, int(options.get("range_bytes", RANGE_BYTES))
        self.oids: set[str] | None = None
        self.kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            named = f.attribute if isinstance(f, (EqualTo, In)) else None
            if named not in (("oid",), ("kind",)):
                yield f
                continue
            values = set(f.value if isinstance(f, In) else [f.value])
            name = f"{named[0]}s"
            setattr(self, name, values if getattr(self, name) is None else getattr(self, name) & values)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        wanted = None if self.oids is None else [bytes.fromhex(x) for x in self.oids if len(x) == 40]
        packs: list[str] = []
        folders: list[str] = []
        for at in object_folders(git_dirs(self.path)[1]):
            packs += sorted(str(p) for p in (at / "pack").glob("*.pack") if p.with_suffix(".idx").exists())
            folders += sorted(str(p) for p in at.iterdir() if len(p.name) == 2 and p.is_dir() and (wanted is None or any(x.hex()[:2] == p.name for x in wanted)))
        for k, path in enumerate(packs):
            size = os.path.getsize(path)
            if wanted is not None:
                pack = Pack(path)
                starts = sorted({(o // self.range_bytes) * self.range_bytes for x in wanted if (o := pack.find(x)) is not None})
            else:
                starts = range(0, size, self.range_bytes)
            out += [_Range(path, a, a + self.range_bytes, tuple(packs[:k])) for a in starts]
        out += [_Range(folders=tuple(folders[k : k + 16]), before=tuple(packs)) for k in range(0, len(folders), 16)]
        return out or [_Range()]

    def _packed(self, part: _Range) -> Iterator[tuple]:
        pack, before = Pack(part.pack), [Pack(p) for p in part.before]
        inside = np.flatnonzero((pack.offsets >= part.start) & (pack.offsets < part.end))
        for k in inside[np.argsort(pack.offsets[inside])].tolist():
            oid, at = pack.oids[k].tobytes(), int(pack.offsets[k])
            if self.oids is not None and oid.hex() not in self.oids or self.kinds is not None and pack.kind(at) not in self.kinds:
                continue
            if not any(p.find(oid) is not None for p in before):  # several packs may hold an object
                yield oid.hex(), *pack.read(at)

    def _loose(self, part: _Range) -> Iterator[tuple]:
        before = [Pack(p) for p in part.before]
        for folder in part.folders:
            for name in sorted(os.listdir(folder)):
                oid = os.path.basename(folder) + name
                if len(oid) != 40 or self.oids is not None and oid not in self.oids or any(p.find(bytes.fromhex(oid)) is not None for p in before):
                    continue
                head, _, content = zlib.decompress(Path(folder, name).read_bytes()).partition(b"\0")
                kind = head.split()[0].decode()
                if self.kinds is None or kind in self.kinds:
                    yield oid, kind, content

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            columns = [pa.array([r[k] for r in held], t) for k, t in ((0, pa.string()), (1, pa.string()))]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([len(r[2]) for r in held], pa.int64()), pa.array([r[2] for r in held], pa.binary())], names=["oid", "kind", "size", "content"])
            held.clear()
            return batch

        for row in self._packed(part) if part.pack else self._loose(part):
            held.append(row)
            size += len(row[2]) + 64
            if size > BATCH_BYTES:
                yield out()
                size = 0
        if held:
            yield out()


class _Refs(DataSourceReader):
    """HEAD, loose and packed references of a repository: a file each, or a line."""

    def __init__(self, path: str, options: dict):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        own, common = git_dirs(self.path)
        found: dict[str, tuple[str | None, str | None]] = {}
        packed = common / "packed-refs"
        for line in packed.read_text().splitlines() if packed.is_file() else ():
            if line[:1] not in "#^":
                oid, _, name = line.partition(" ")
                found[name] = (oid, None)
        files = [(p, str(p.relative_to(common))) for p in (common / "refs").rglob("*") if p.is_file() and not p.name.endswith(".lock")]
        for file, name in [*files, (own / "HEAD", "HEAD")]:
            said = file.read_text().strip()
            found[name] = (None, said[4:].strip()) if said.startswith("ref:") else (said, None)
        for name, (oid, target) in found.items():
            seen = {name}
            at = target
            while at and at not in seen and at in found:
                seen.add(at)
                oid, at = found[at]
            yield name, oid, target


class _Index(DataSourceReader):
    """The staged files of an index file, versions 2 to 4. Its entries hang on each other, so one task reads it."""

    def __init__(self, path: str, options: dict):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        file = git_dirs(self.path)[0] / "index"
        if not file.is_file():
            return
        data = file.read_bytes()
        magic, version, n = struct.unpack(">4sII", data[:12])
        if magic != b"DIRC" or version not in (2, 3, 4):
            raise RepositoryError(f"{file}: not an index of version 2 to 4")
        at, name = 12, b""
        for _ in range(n):
            begin = at
            mtime, mode, size = struct.unpack(">8xI12xI8xI", data[at : at + 40])
            oid, flags = data[at + 40 : at + 60].hex(), int.from_bytes(data[at + 60 : at + 62], "big")
            at += 64 if flags & 0x4000 else 62
            if version == 4:
                cut, at = _offset(data, at)
                end = data.index(b"\0", at)
                name = name[: len(name) - cut] + data[at:end]
                at = end + 1
            else:
                end = data.index(b"\0", at)
                name = data[at:end]
                at = begin + (end - begin + 8) // 8 * 8
            yield name.decode(errors="replace"), oid, f"{mode:o}", flags >> 12 & 3, size, mtime
        if data[at : at + 4] == b"link":
            raise RepositoryError(f"{file}: a split index isn't read")


class GitStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_store"

    def _table(self) -> str:
        table = self.options.get("table", "objects")
        if table not in SCHEMAS:
            raise RepositoryError(f"unknown table {table!r}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        return {"objects": _Objects, "refs": _Refs, "index": _Index}[self._table()](self.options["path"], self.options)


def _read(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    spark.dataSource.register(GitStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("git_store").options(path=path, table=table, **options).load()


def objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(oid, kind, size, content) of all objects, packed and loose, each once."""
    return _read(spark, path, "objects", range_bytes=range_bytes)


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, oid, mode, stage, size, mtime) of the staged files."""
    return _read(spark, path, "index")


def references(spark: SparkSession, path: str) -> DataFrame:
    """(name, oid, target, commit): all references; target of symbolic ones; the commit that a tag object stands for."""
    refs = _read(spark, path, "refs")
    tags = objects(spark, path).where("kind = 'tag'").select("oid", F.regexp_extract(F.col("content").cast("string"), r"^object ([0-9a-f]{40})", 1).alias("_to"))
    once = refs.join(tags, "oid", "left")
    twice = once.join(tags.select(F.col("oid").alias("_to"), F.col("_to").alias("_then")), "_to", "left")  # a tag of a tag
    return twice.select("name", "oid", "target", F.coalesce("_then", "_to", "oid").alias("commit"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(oid, tree, parents, author, email, time, message), time in seconds as the committer states it."""
    whole = F.col("content").cast("string")
    head = F.substring_index(whole, "\n\n", 1)
    person = lambda who, k: F.regexp_extract("head", rf"(?m)^{who} (.*?) ?<([^>]*)> (-?\d+)", k)
    rows = objects(spark, path).where("kind = 'commit'").select("oid", head.alias("head"), F.expr("substring(cast(content as string), length(substring_index(cast(content as string), '\n\n', 1)) + 3)").alias("message"))
    listed = F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1))
    return rows.select("oid", F.regexp_extract("head", r"^tree ([0-9a-f]{40})", 1).alias("tree"), listed.alias("parents"), person("author", 1).alias("author"), person("author", 2).alias("email"), person("committer", 3).cast("long").alias("time"), "message")


def commit_edges(found: DataFrame) -> DataFrame:
    """(oid, parent, nth, message, author, time): commits with a row for each parent, nth from 1; a root has a row without."""
    return found.select("oid", F.posexplode_outer("parents").alias("_k", "parent"), "message", "author", "time").select("oid", "parent", (F.coalesce("_k", F.lit(0)) + 1).alias("nth"), "message", "author", "time")


def tree_entries(spark: SparkSession, path: str) -> DataFrame:
    """(tree, name, mode, oid) of all tree objects. The bytes are mode, space, name, NUL, 20 bytes of oid, again and again."""
    entry = r"((?:3[0-7]){5,6})20((?:[0-9A-F]{2})+?)00([0-9A-F]{40})"
    found = objects(spark, path).where("kind = 'tree'").select(F.col("oid").alias("tree"), F.explode(F.regexp_extract_all(F.hex("content"), F.lit(entry), F.lit(0))).alias("x"))
    part = lambda k: F.regexp_extract("x", f"^{entry}$", k)
    return found.select("tree", F.unhex(part(2)).cast("string").alias("name"), F.lpad(F.unhex(part(1)).cast("string"), 6, "0").alias("mode"), F.lower(part(3)).alias("oid"))


def snapshots(spark: SparkSession, path: str, heads: DataFrame, under: list[str] | None = None) -> DataFrame:
    """(commit, path, mode, oid) of the files of the commits heads (commit), one join a level. With ``under``, only what
    lies at or below these paths, a run's parameter; other folders aren't entered."""
    entries = store(tree_entries(spark, path), "trees")
    trees = commits(spark, path).select(F.col("oid").alias("commit"), F.col("tree"))
    level = trees.join(heads.select("commit").distinct(), "commit", "left_semi").withColumn("prefix", F.lit(""))
    found: DataFrame | None = None
    while True:
        inside = level.join(entries, "tree").select("commit", F.concat("prefix", "name").alias("path"), "mode", "oid")
        if under is not None:
            wanted = [u.strip("/") for u in under]
            near = [(F.col("path") == u) | F.startswith("path", F.lit(f"{u}/")) | (F.col("mode") == "040000") & F.startswith(F.lit(f"{u}/"), F.concat("path", F.lit("/"))) for u in wanted]
            inside = inside.where(near[0] if len(near) == 1 else F.array_contains(F.array(*near), True)) if near else inside.where("false")
        inside = store(inside, "level")
        files = inside.where("mode <> '040000'")
        found = files if found is None else found.unionAll(files)
        level = inside.where("mode = '040000'").select("commit", F.concat("path", F.lit("/")).alias("prefix"), F.col("oid").alias("tree"))
        if not level.limit(1).count():
            return found


#: So many oids are named in a filter of the scan; beyond, all objects are read and joined.
NAMED_OIDS = 2000


def read_blobs(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """files (oid, …) with ``content`` as text: null for a binary one, or one that isn't there."""
    few = [r["oid"] for r in files.select("oid").distinct().limit(NAMED_OIDS + 1).collect()]
    blobs = objects(spark, path).where("kind = 'blob'")
    if len(few) <= NAMED_OIDS:
        blobs = blobs.where(F.col("oid").isin(few))
    return files.join(blobs.select("oid", decode_text(F.col("content")).alias("content")), "oid", "left")


def read_at(spark: SparkSession, path: str, commit: str, wanted: list[str]) -> DataFrame:
    """wanted paths of one commit with their text: null if absent, binary, or outside the tree."""
    asked = spark.createDataFrame([(w,) for w in wanted], "path string").distinct()
    plain = [n for w in wanted if (n := os.path.normpath(w)) and not n.startswith(("..", "/"))]
    heads = spark.createDataFrame([(commit,)], "commit string")
    files = snapshots(spark, path, heads, plain).select("path", "oid")
    got = read_blobs(spark, path, files).select(F.col("path").alias("_p"), "content")
    norm = F.when(~(F.startswith("path", F.lit("/")) | F.exists(F.split("path", "/"), lambda x: x == "..")), text.normalize_path(F.col("path")))
    return asked.withColumn("_p", norm).join(got, "_p", "left").select("path", "content")


def blob_oid(content) -> F.Column:
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\0"), content))


def _working(spark: SparkSession, root: str) -> DataFrame:
    top = os.path.realpath(root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    at = F.substring(F.regexp_replace("path", "^[a-z]+:/+", "/"), len(top) + 2, 1 << 30)
    return files.select(at.alias("path"), "content").where("path not rlike '(^|/)[.]git(/|$)'")


def working_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, oid) of the files in a working folder, without those of the repository itself; oid as of a blob."""
    return _working(spark, root).select("path", blob_oid(F.col("content")).alias("oid"))


def working_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): their text, null for binary ones."""
    return _working(spark, root).select("path", decode_text(F.col("content")).alias("content"))


def head_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mode, oid) of the commit that HEAD stands for; none before the first commit."""
    heads = references(spark, root).where("name = 'HEAD' and commit is not null").select("commit")
    return snapshots(spark, root, heads).select("path", "mode", "oid")


def staged(spark: SparkSession, root: str) -> DataFrame:
    """(path, status, base_oid, head_oid) of what the index changes against HEAD."""
    return snapshot.tree_diff(head_files(spark, root), index_entries(spark, root).where("stage = 0"))


def unstaged(spark: SparkSession, root: str, ignored: DataFrame | None = None) -> DataFrame:
    """As staged, of the working folder against the index; with paths in neither HEAD nor index as added, but those of
    ``ignored`` (path)."""
    work = working_files(spark, root)
    if ignored is not None:
        known = index_entries(spark, root).select("path")
        work = work.join(ignored.select("path").join(known, "path", "left_anti"), "path", "left_anti")
    plain = lambda df: df.select("path", "oid", F.lit(None).cast("string").alias("mode"))  # noqa: E731  a file's mode isn't read
    return snapshot.tree_diff(plain(index_entries(spark, root).where("stage = 0")), plain(work))


def status(spark: SparkSession, root: str) -> DataFrame:
    """(path, head, workdir, stage) codes of a working folder, as snapshot.status_matrix."""
    return snapshot.status_matrix(head_files(spark, root), working_files(spark, root), index_entries(spark, root).where("stage = 0"))


# Writing


def _entry(name, mode, oid):
    """A tree entry in hex."""
    return F.concat(F.hex(F.concat(F.regexp_replace(mode, "^0", ""), F.lit(" "), name)), F.lit("00"), F.upper(oid))


def hashed(kind: str, content) -> F.Column:
    return F.sha1(F.concat(F.concat(F.lit(f"{kind} "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\0"), content))


def tree_objects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files (commit, path, mode, oid): the tree objects (oid, kind, content), and the roots (commit, tree). Folders are
    made from the deepest level up, each from its entries."""
    cut = lambda p: F.substring_index(p, "/", -1)
    up = lambda p: F.when(F.instr(p, "/") > 0, F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    entries = files.select("commit", up(F.col("path")).alias("dir"), cut(F.col("path")).alias("name"), "mode", "oid").withColumn("depth", depth)
    entries = store(entries, "entries")
    made: DataFrame | None = None
    for d in range(entries.agg(F.max("depth")).first()[0] or 0, -1, -1):
        key = F.when(F.col("mode") == "040000", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
        of = entries.where(F.col("depth") == d).groupBy("commit", "dir").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), _entry(F.col("name"), F.col("mode"), F.col("oid")).alias("x")))).alias("e"))
        content = F.unhex(F.array_join(F.transform("e", lambda x: x["x"]), ""))
        trees = store(of.select("commit", F.col("dir").alias("path"), content.alias("content")).withColumn("oid", hashed("tree", F.col("content"))), "folders")
        made = trees if made is None else made.unionAll(trees)
        if d:
            entries = entries.unionAll(trees.select("commit", up(F.col("path")).alias("dir"), cut(F.col("path")).alias("name"), F.lit("040000").alias("mode"), "oid").withColumn("depth", depth))
    roots = made.where("path = ''").select("commit", F.col("oid").alias("tree"))
    return made.select("oid", F.lit("tree").alias("kind"), "content").dropDuplicates(["oid"]), roots


def write_packs(found: DataFrame, path: str) -> None:
    """Writes objects (oid, kind, content) as packs of an object store, one for each task, without deltas. A task that runs
    twice writes the same file. path is one that executors see."""
    folder = os.path.join(path, "objects", "pack")
    os.makedirs(folder, exist_ok=True)

    def run(rows):
        import hashlib

        at = os.path.join(folder, f"tmp-{os.urandom(8).hex()}")
        places: list[tuple[bytes, int, int]] = []
        codes = {k: n for n, k in KINDS.items()}
        with open(at, "wb") as f:
            f.write(b"PACK" + struct.pack(">II", 2, 0))
            for batch in rows:
                for oid, kind, content in zip(*(batch.column(c).to_pylist() for c in ("oid", "kind", "content")), strict=True):
                    n, head = len(content), bytearray()
                    head.append(codes[kind] << 4 | n & 15)
                    n >>= 4
                    while n:
                        head[-1] |= 128
                        head.append(n & 127)
                        n >>= 7
                    whole = bytes(head) + zlib.compress(content)
                    places.append((bytes.fromhex(oid), zlib.crc32(whole), f.tell()))
                    f.write(whole)
            f.seek(8)
            f.write(struct.pack(">I", len(places)))
        places.sort()
        digest = hashlib.sha1()
        with open(at, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        if places:
            with open(at, "ab") as f:
                f.write(digest.digest())
            counts = np.bincount([p[0][0] for p in places], minlength=256).cumsum()
            wide = [p[2] for p in places if p[2] >> 31]
            number = {o: k for k, o in enumerate(wide)}
            idx = b"\xfftOc" + struct.pack(">I", 2) + counts.astype(">u4").tobytes() + b"".join(p[0] for p in places)
            idx += b"".join(struct.pack(">I", p[1]) for p in places) + b"".join(struct.pack(">I", 1 << 31 | number[p[2]] if p[2] >> 31 else p[2]) for p in places) + b"".join(struct.pack(">Q", o) for o in wide) + digest.digest()
            name = os.path.join(folder, f"pack-{digest.hexdigest()}")
            with open(f"{at}.idx", "wb") as f:
                f.write(idx + hashlib.sha1(idx).digest())
            os.replace(at, f"{name}.pack")
            os.replace(f"{at}.idx", f"{name}.idx")
        else:
            os.remove(at)
        yield pa.RecordBatch.from_arrays([pa.array([len(places)], pa.int64())], names=["n"])

    found.select("oid", "kind", "content").sortWithinPartitions("kind", "oid").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def shared_path(spark: SparkSession) -> str:
    """A new folder for a repository in the folder that driver and executors share, if that is a mounted one."""
    at = folder(spark)
    scheme, _, rest = at.partition(":/")
    if rest and scheme != "file":
        raise RepositoryError(f"packs are written to mounted folders only, not to {at}")
    return os.path.join("/" + rest.lstrip("/") if rest else at, "repositories", uuid.uuid4().hex[:12])


def write_repository(files: DataFrame, history: DataFrame, path: str, branch: str = "main") -> DataFrame:
    """A bare repository at path of files (commit, path, mode, content), commit being a name, and history (commit, parent,
    author, time, message), each commit with its parents' names. HEAD is the latest. Returns (commit, oid). Commits are few
    against files: their objects are made on the driver, from parents on."""
    os.makedirs(os.path.join(path, "refs", "heads"), exist_ok=True)
    blobs = store(files.withColumn("oid", hashed("blob", F.col("content"))), "blobs")
    trees, roots = tree_objects(blobs.select("commit", "path", "mode", "oid"))
    root = {r["commit"]: r["tree"] for r in roots.collect()}
    import hashlib

    made: dict[str, str] = {}
    rows = []
    left = {r["commit"]: r for r in history.groupBy("commit", "author", "time", "message").agg(F.array_sort(F.collect_list("parent")).alias("parents")).orderBy("time", "commit").collect()}
    while left:
        ready = [r for r in left.values() if all(p in made for p in r["parents"])]
        if not ready:
            raise RepositoryError("commits whose parents aren't there")
        for r in ready:
            who = f"{r['author']} <{r['author']}@example.org> {r['time']} +0000"
            body = "".join([f"tree {root.get(r['commit'], '4b825dc642cb6eb9a060e54bf8d69288fbee4904')}\n", *(f"parent {made[p]}\n" for p in r["parents"]), f"author {who}\ncommitter {who}\n\n{r['message']}\n"]).encode()
            made[r["commit"]] = hashlib.sha1(b"commit %d\0" % len(body) + body).hexdigest()
            rows.append((made[r["commit"]], "commit", body, r["commit"]))
            del left[r["commit"]]
    own = files.sparkSession.createDataFrame(rows, "oid string, kind string, content binary, commit string")
    write_packs(blobs.select("oid", F.lit("blob").alias("kind"), "content").dropDuplicates(["oid"]).unionAll(trees).unionAll(own.select("oid", "kind", "content")), path)
    Path(path, "HEAD").write_text(f"ref: refs/heads/{branch}\n")
    Path(path, "refs", "heads", branch).write_text(rows[-1][0] + "\n")
    Path(path, "config").write_text("[core]\n\trepositoryformatversion = 0\n\tbare = true\n")
    return own.select("commit", "oid")

"""What a review of a real repository compares: staged files, the working folder, a commit, a range or a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RepositoryError
from ..operators import snapshot
from ..operators.history import CommitIndex
from . import gitstore, readers, repository


class Repository:
    """A repository's references and commits, stored once, with the index of its history made when it is first asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.refs = gitstore.store(gitstore.references(spark, root).select("name", F.col("commit").alias("oid")).where("oid is not null"), "refs")
        self.commits = gitstore.store(gitstore.commit_edges(gitstore.commits(spark, root)), "commit-edges")
        self._index: CommitIndex | None = None

    @property
    def index(self) -> CommitIndex:
        if self._index is None:
            self._index = CommitIndex(self.commits)
        return self._index

    def resolve(self, spec: str) -> str:
        return repository.resolve_ref(self.refs, self.commits, spec, self._index)

    def log(self, spec: str = "HEAD", depth: int = 100) -> DataFrame:
        """(oid, message, author) of the latest commits from a revision."""
        return repository.commit_log(self.commits, self.resolve(spec), depth, index=self.index)

    def merge_base(self, a: str, b: str) -> str:
        """The best common ancestor of two revisions; of several the latest."""
        pair = self.spark.createDataFrame([(1, self.resolve(a), self.resolve(b))], "id int, a string, b string")
        best = self.index.merge_bases(pair).join(self.index.nodes.select("oid", "at"), "oid").orderBy(F.desc("at"), "oid").limit(1).collect()
        if not best:
            raise RepositoryError(f"{a} and {b} have no common commit")
        return best[0]["oid"]

    def sides(self, kind: str, base: str | None = None, head: str | None = None, spec: str | None = None) -> tuple[str | None, str]:
        """The two snapshots of a scope: INDEX, WORKDIR, or commits; None is the empty tree before a first commit."""
        if kind in ("working-tree", "staged"):
            return readers.resolve_scope(kind)
        if kind == "commit":
            if not head:
                raise RepositoryError("a commit scope names a commit")
            oid = self.resolve(head)
            first = self.commits.where((F.col("oid") == oid) & (F.col("nth") == 1) & F.col("parent").isNotNull()).select("parent").limit(1).collect()
            return (first[0]["parent"] if first else None), oid
        if kind == "range":
            a, b, symmetric = readers.parse_range(spec or "")
            return (self.merge_base(a, b) if symmetric else self.resolve(a)), self.resolve(b)
        if kind == "branch":
            if not base:
                raise RepositoryError("a branch scope names the branch that it is compared with")
            return self.merge_base(base, head or "HEAD"), self.resolve(head or "HEAD")
        raise RepositoryError(f"unknown scope {kind}")

    def files(self, side: str | None) -> DataFrame:
        """(path, oid, mode) of a snapshot; the working folder's modes aren't read."""
        if side is None:
            return self.spark.createDataFrame([], "path string, oid string, mode string")
        if side == "WORKDIR":
            return gitstore.working_files(self.spark, self.root).withColumn("mode", F.lit(None).cast("string"))
        if side == "INDEX":
            return gitstore.index_entries(self.spark, self.root).where("stage = 0").select("path", "oid", "mode")
        if side == "HEAD":
            return gitstore.head_files(self.spark, self.root).select("path", "oid", "mode")
        heads = self.spark.createDataFrame([(side,)], "commit string")
        return gitstore.snapshots(self.spark, self.root, heads).select("path", "oid", "mode")

    def changed(self, kind: str, **names: str) -> DataFrame:
        """(path, status, base_oid, head_oid) of a scope's changed files. Untracked files are the working folder's added ones."""
        base, head = self.sides(kind, **names)
        a, b = self.files(base), self.files(head)
        if head == "WORKDIR":
            a = a.withColumn("mode", F.lit(None).cast("string"))
        return snapshot.tree_diff(a, b)

    def contents(self, changed: DataFrame, kind: str) -> DataFrame:
        """changed with ``old`` and ``new`` text: null for binary files and absent sides. New objects of a working folder
        are its files."""
        old = gitstore.read_blobs(self.spark, self.root, changed.where("base_oid is not null").select(F.col("base_oid").alias("oid")).distinct()).select(F.col("oid").alias("base_oid"), F.col("content").alias("old"))
        if kind == "working-tree":
            new = gitstore.working_texts(self.spark, self.root).select("path", F.col("content").alias("new"))
            return changed.join(old, "base_oid", "left").join(new, "path", "left")
        new = gitstore.read_blobs(self.spark, self.root, changed.where("head_oid is not null").select(F.col("head_oid").alias("oid")).distinct()).select(F.col("oid").alias("head_oid"), F.col("content").alias("new"))
        return changed.join(old, "base_oid", "left").join(new, "head_oid", "left")

    def diff(self, kind: str, **names: str) -> DataFrame:
        """(path, status, diff) of a scope's text files, each with its unified diff."""
        found = self.contents(gitstore.store(self.changed(kind, **names), "changed"), kind)
        text = found.where("(old is not null or base_oid is null) and (new is not null or head_oid is null)")
        return snapshot.with_diff(text).select("path", "status", "diff")

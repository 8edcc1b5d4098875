"""Keyed results that outlive a run: puts, deletes and gets by key, of any number of writers.

A write is a generation, a folder of its own that is complete before it gets its name: it is written aside and then renamed to
the next free number, which only one writer can get. Inside, rows lie in folders by the key's hash, so that a get reads
its keys' folders only. A key's last generation counts; a delete is a row without a value. ``compact`` puts generations
together; a reader sees either the old ones or the new.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 64


class MemoStore:
    """Rows (key, value, expires); value and key are strings, expires a timestamp or null."""

    SCHEMA = "key string, value string, expires timestamp, dead boolean"

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def generations(self) -> list[tuple[int, int]]:
        """(first, last) of the generations that readers see, in order: a compacted one stands for those that it covers."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        found = sorted(tuple(int(x) for x in n[2:].split("-")) for n in names if n.startswith("g-"))
        return [g for g in found if not any(o != g and o[0] <= g[0] and g[1] <= o[1] for o in found)]

    def _name(self, first: int, last: int) -> str:
        return f"{self.path}/g-{first:012d}-{last:012d}"

    def _commit(self, rows: DataFrame, span: tuple[int, int] | None = None) -> int:
        aside = f"{self.path}/.new-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.folders)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(aside)
        while True:
            first, last = span or ((n := max((b for _, b in self.generations()), default=0) + 1), n)
            # A lock by number: making a folder that is there fails, so a number goes to one writer.
            if self._fs.mkdirs(self._at(f"{self.path}/.taken")) and self._fs.createNewFile(self._at(f"{self.path}/.taken/{first}-{last}")):
                if not self._fs.rename(self._at(aside), self._at(self._name(first, last))):
                    raise OSError(f"{self.path}: generation {first}-{last} couldn't be named")
                return last
            if span:
                self._fs.delete(self._at(aside), True)
                return 0
            if not self._fs.exists(self._at(self._name(first, last))):
                self._wait(first)

    def _wait(self, number: int, seconds: float = 30) -> None:
        """For the writer that has the number but hasn't named its generation yet; one that died is left behind."""
        import time

        until = time.monotonic() + seconds
        while time.monotonic() < until and not self._fs.exists(self._at(self._name(number, number))):
            time.sleep(0.05)
        if not self._fs.exists(self._at(self._name(number, number))):
            self.spark.createDataFrame([], self.SCHEMA).write.mode("ignore").parquet(self._name(number, number))

    def put(self, rows: DataFrame) -> int:
        """Writes rows (key, value, and maybe expires) as one generation; of repeated keys the largest value stays."""
        expires = F.col("expires") if "expires" in rows.columns else F.lit(None).cast("timestamp")
        made = rows.select("key", "value", expires.alias("expires")).where("key is not null")
        last = F.max(F.struct("value", "expires")).alias("v")
        return self._commit(made.groupBy("key").agg(last).select("key", "v.value", "v.expires", F.lit(False).alias("dead")))

    def delete(self, keys: DataFrame) -> int:
        """Keys (key) that are gone from this generation on."""
        gone = keys.select("key").where("key is not null").distinct()
        return self._commit(gone.select("key", F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp").alias("expires"), F.lit(True).alias("dead")))

    def _rows(self, spans: Iterable[tuple[int, int]]) -> DataFrame:
        parts = [self.spark.read.schema(f"{self.SCHEMA}, bucket int").parquet(self._name(*s)).withColumn("generation", F.lit(s[1])) for s in spans]
        out = self.spark.createDataFrame([], f"{self.SCHEMA}, bucket int, generation int") if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by(F.struct("value", "expires", "dead"), "generation").alias("r")).select("key", "r.*")

    def all(self) -> DataFrame:
        """(key, value) of all keys that are there."""
        return self._last(self._rows(self.generations())).where("not dead and (expires is null or expires > current_timestamp())").select("key", "value")

    def get(self, keys: list[str]) -> DataFrame:
        """(key, value) of the keys that are there, a run's few; only the folders of their hashes are read."""
        named = self.spark.createDataFrame([(k,) for k in keys], "key string")
        wanted = [r["b"] for r in named.select(F.pmod(F.xxhash64("key"), F.lit(self.folders)).cast("int").alias("b")).distinct().collect()]
        rows = self._rows(self.generations()).where(F.col("bucket").isin(wanted) & F.col("key").isin(list(keys)))
        return self._last(rows).where("not dead and (expires is null or expires > current_timestamp())").select("key", "value")

    def join(self, keys: DataFrame) -> DataFrame:
        """keys (key, …) with ``value``, null where there is none: for as many keys as there may be."""
        return keys.join(self.all(), "key", "left")

    def compact(self) -> int:
        """One generation in place of all that are there now, without what is dead or has expired. Generations written
        meanwhile stay as they are. The old folders go by ``clean``."""
        spans = self.generations()
        if len(spans) < 2:
            return spans[-1][1] if spans else 0
        live = self._last(self._rows(spans)).where("not dead and (expires is null or expires > current_timestamp())")
        return self._commit(live.select("key", "value", "expires", "dead"), (spans[0][0], spans[-1][1]))

    def clean(self) -> int:
        """Deletes generations that a compacted one covers, once no reader uses them; their number."""
        seen, names = set(self.generations()), [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        old = [n for n in names if n.startswith("g-") and tuple(int(x) for x in n[2:].split("-")) not in seen]
        for n in old:
            self._fs.delete(self._at(f"{self.path}/{n}"), True)
        return len(old)

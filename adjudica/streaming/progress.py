"""Progress events as a stream: latest state of each stage, and windowed counts with late data cut by a watermark.

Windows are an extension for operating the engine; the operators themselves are batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STAGES = ("git:read", "index:update", "symbols:resolve", "diagnostics:collect", "context:build", "review:dag", "review:critic", "review:rank")


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, event_type, n, total) of events (ts, event_type, value)."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant, not a wall-clock time
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


class Suppressions(StatefulProcessor):
    """Of each review, which findings are suppressed. The last action by seq counts, whatever order they come in, so any batches
    and restarts give one result. State is an entry for each finding, the last reset, and the number suppressed."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "finding long", "seq long, suppressed boolean", self.ttl_ms)
        self.seen = handle.getValueState("seen", "reset long, last long, n long", self.ttl_ms)

    def _known(self) -> tuple[int, int, int]:
        return tuple(map(int, self.seen.get())) if self.seen.exists() else (-1, -1, 0)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: object) -> None:  # noqa: N802
        reset, last, n = self._known()
        for finding in {int(x) for x in initial["finding"]}:
            self.held.updateValue((finding,), (-1, True))
            n += 1
        self.seen.update((-2, last, n))

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        reset, last, n = self._known()
        for frame in frames:
            for seq, action, finding in zip(frame["seq"], frame["action"], frame["finding"], strict=True):
                seq = int(seq)
                last = max(last, seq)
                if action == "reset":
                    if seq > reset:
                        reset = seq
                        for (held,), (at, on) in list(self.held.iterator()):
                            if at <= reset:
                                self.held.removeKey((held,))
                                n -= on
                elif seq > reset and action in ("suppress", "restore"):
                    old = self.held.getValue((int(finding),)) if self.held.containsKey((int(finding),)) else (-3, False)
                    if seq > old[0]:
                        on = action == "suppress"
                        self.held.updateValue((int(finding),), (seq, on))
                        n += on - bool(old[1])
        self.seen.update((reset, last, n))
        yield pd.DataFrame({"review": [key[0]], "seq": [last], "suppressed": [n]})

    def close(self) -> None:
        pass


def suppressions(actions: DataFrame, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Running state of each review's interface: a stream of actions (review, seq, action, finding) of suppress, restore and
    reset to (review, seq, suppressed), the last seq and the number of suppressed findings. ``initial`` (review, finding):
    what is suppressed at the start. With ``ttl_ms`` entries go that long after their last change."""
    spark = actions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = None if initial is None else initial.select("review", "finding").groupBy("review")
    return actions.groupBy("review").transformWithStateInPandas(Suppressions(ttl_ms), "review long, seq long, suppressed long", "Update", "None" if ttl_ms is None else "ProcessingTime", first)


def suppressed_now(actions: DataFrame) -> DataFrame:
    """What suppressions() comes to, of a batch of actions: (review, seq, suppressed)."""
    order = Window.partitionBy("review", "finding").orderBy(F.desc("seq"))
    resets = actions.groupBy("review").agg(F.max("seq").alias("last"), F.coalesce(F.max(F.when(F.col("action") == "reset", F.col("seq"))), F.lit(-1)).alias("reset"))
    after = actions.where("action in ('suppress', 'restore')").join(resets.select("review", "reset"), "review").where("seq > reset")
    held = after.withColumn("k", F.row_number().over(order)).where("k = 1 and action = 'suppress'").groupBy("review").agg(F.count("*").alias("n"))
    return resets.join(held, "review", "left").select("review", F.col("last").alias("seq"), F.coalesce("n", F.lit(0)).alias("suppressed"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, into a folder of changes: one part for each batch, which a repeated batch overwrites."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The last row of each key in a folder of changes (with batch)."""
    last = F.max(F.struct("batch", *[c for c in changes.columns if c not in (key, "batch")])).alias("_r")
    return changes.groupBy(key).agg(last).select(key, *[F.col(f"_r.{c}").alias(c) for c in changes.columns if c not in (key, "batch")])


def active_blocking(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Number of blocking findings that aren't suppressed."""
    return findings.where("final_disposition = 'blocking'").join(suppressed.select("id"), "id", "left_anti").agg(F.count("*").alias("n"))

"""Keyed tables kept by streams: each batch is merged into the last version, and a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Versions of a table in a folder, one a batch. Version n is what `merge` makes of the rows of the last version before n and of
    batch n; writing it again from the same two gives the same rows, so a replayed or repeated batch is harmless. A version counts
    once its files are complete. `keep` versions stay, older ones are deleted."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], keep: int = 2):
        self.spark, self.path, self.schema, self.merge, self.keep = spark, path, schema, merge, keep

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = (n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))
        return sorted(int(n[2:]) for n in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The last version (before a number); empty without one."""
        have = [n for n in self._versions() if before is None or n < before]
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={have[-1]}")

    def put(self, batch: DataFrame, n: int) -> None:
        """Merge batch n, whose rows have the table's columns."""
        self.merge(self.read(before=n).unionByName(batch)).write.mode("overwrite").parquet(f"{self.path}/v={n}")
        jvm = self.spark.sparkContext._jvm
        for old in [v for v in self._versions() if v < n][: -self.keep or None]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge all that the stream has now."""
        stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_order(ts: str = "ts", event: str = "event_id") -> Column:
    """A number by which events are earlier and later: time in microseconds, then the event's id."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000 + F.col(event) % 1000


FIRST_SCHEMA = "run_no long, owner long, claimed long"


def first_claims(spark: SparkSession, path: str) -> KeyedTable:
    """Who claimed a resource first, by the time of the event and not of its arrival."""
    return KeyedTable(spark, path, FIRST_SCHEMA, lambda rows: rows.groupBy("run_no").agg(F.min_by("owner", "claimed").alias("owner"), F.min("claimed").alias("claimed")))


def claims(events: DataFrame) -> DataFrame:
    """Events (run_no, user_id, ts, event_id) as rows of first_claims."""
    return events.select("run_no", F.col("user_id").alias("owner"), event_order().alias("claimed"))


LATEST_SCHEMA = "user_id long, run_no long, status string, status_at long, stage string, stage_at long, observed_at timestamp"


def latest_states(spark: SparkSession, path: str) -> KeyedTable:
    """Each run's last status and stage that were not null, each with its own time, and the time last seen."""

    def merge(rows: DataFrame) -> DataFrame:
        last = lambda c: (F.max_by(c, f"{c}_at").alias(c), F.max(f"{c}_at").alias(f"{c}_at"))
        return rows.groupBy("user_id", "run_no").agg(*last("status"), *last("stage"), F.max("observed_at").alias("observed_at"))

    return KeyedTable(spark, path, LATEST_SCHEMA, merge)


def states(events: DataFrame) -> DataFrame:
    """Events (user_id, run_no, status, stage, ts, event_id) as rows of latest_states."""
    at = lambda c: F.when(F.col(c).isNotNull(), event_order()).alias(f"{c}_at")
    return events.select("user_id", "run_no", "status", at("status"), "stage", at("stage"), F.col("ts").cast("timestamp").alias("observed_at"))

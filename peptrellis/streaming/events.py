"""Run events as streams: times, windowed counts, and runs to the end of what a stream has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_stream_time(events: DataFrame) -> DataFrame:
    """ts as a timestamp with the session's zone: watermarks refuse one without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str, key: str = "user_id", delay: str = "1 hour") -> DataFrame:
    """Events in each tumbling window of each key. Works on streams and tables; a stream drops a window's state once the watermark
    passes its end. Counts combine before the shuffle, so a hot key costs one row a task and window."""
    timed = as_stream_time(events).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", settings: dict[str, str] | None = None):
    """Write all that a stream has now to Parquet. settings hold while the query starts and are put back."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        conf.set(k, v)
    try:
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return query

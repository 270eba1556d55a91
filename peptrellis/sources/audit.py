"""An audit log of a run's stages: rows appended as stages end, counts observed in the pass that writes a stage's survivors."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import stage as staged

SCHEMA = "run_id string, no int, ts timestamp, kind string, stage string, n_in long, n_out long, n_removed long, duration_s double, warnings array<string>"


class Audit:
    """The log of one run in a folder of runs. Starting a run cuts what the folder has of it; other runs' rows stay."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id, self.no = spark, path, run_id, 0

    def _append(self, kind: str, stage: str, n_in: int | None, n_out: int | None, seconds: float, warnings: list[str], mode: str = "append") -> None:
        removed = None if n_in is None or n_out is None else n_in - n_out
        row = (self.run_id, self.no, datetime.now(timezone.utc), kind, stage, n_in, n_out, removed, seconds, warnings)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path)
        self.no += 1

    def start(self, *warnings: str) -> Audit:
        """The run's first row, in place of all that it had."""
        self.no = 0
        self._append("setup", "run", None, None, 0.0, list(warnings), "overwrite")
        return self

    def stage(self, name: str, rows: DataFrame, keep: Callable[[DataFrame], DataFrame], warn: dict[str, Column] | None = None) -> DataFrame:
        """What `keep` leaves of rows, written and read back; rows in and out are counted in that one pass. warn: conditions on rows that
        come in; each that holds anywhere is a warning with its count. A stage that fails is logged and fails the run."""
        into, out, began = Observation(), Observation(), time.monotonic()
        flags = {f"w{k}": F.count_if(c) for k, c in enumerate((warn or {}).values())}
        try:
            seen = rows.observe(into, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in flags.items()))
            kept = staged(keep(seen).observe(out, F.count(F.lit(1)).alias("n")), f"stage-{name}")
        except Exception as e:
            self._append("failure", name, None, None, time.monotonic() - began, [type(e).__name__])
            raise
        counts = into.get
        warnings = [f"{text}: {counts[k]}" for k, text in zip(flags, warn or {}) if counts[k]]
        self._append("stage", name, int(counts["n"]), int(out.get["n"]), time.monotonic() - began, warnings)
        return kept

    def read(self) -> DataFrame:
        """The run's rows, in the order of `no`."""
        return self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("run_id") == self.run_id)

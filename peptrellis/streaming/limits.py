"""Rate limits on a stream of events: who is over the limit of a window, and how long until the window ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import as_stream_time

#: Keyed state with timers needs this state store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Windows of a user that lie in one such stretch of days are one key's: state is read and written once a key and batch, and each call
#: for it goes from Python to the store and back.
DAYS = 32
#: Events of a task that are packed together.
PACKED = 1_000_000


class Limiter(StatefulProcessor):
    """Counts the events of one user's windows as they arrive (those of one batch by time, then id). An event that was counted before
    is answered no second time. What is kept of a window goes with the first events of its key that come after its end, or by the
    timer at the end of the key's last window."""

    def __init__(self, most: int, micros: int):
        self.most, self.micros = most, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "start array<long>, n array<long>")
        self.seen = handle.getValueState("seen", "start array<long>, event_id array<long>")

    def _open(self, now: int) -> tuple[dict, dict]:
        """How many events the windows that are not over have, and which."""
        kept = self.count.get()
        n = {start: n for start, n in zip(*kept, strict=True) if start + self.micros > now} if kept else {}
        seen = {start: set() for start in n}
        for start, event in zip(*self.seen.get(), strict=True) if n else ():
            if start in n:
                seen[start].add(event)
        return n, seen

    def _keep(self, n: dict, seen: dict) -> None:
        if n:
            self.count.update((list(n), list(n.values())))
            self.seen.update(([start for start in n for _ in seen[start]], [event for start in n for event in seen[start]]))
        else:
            self.count.clear()
            self.seen.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        n, seen = self._open(now)
        last = max(n, default=None)
        # A window that is over has no state and gets none.
        come = ((at - at % self.micros, at, event) for r in rows for at, event in zip(r.at, r.event_id, strict=True))
        for start, at, event in sorted({x for x in come if x[0] + self.micros > now}):
            if event in seen.setdefault(start, set()):
                continue
            seen[start].add(event)
            n[start] = n.get(start, 0) + 1
            if n[start] > self.most:
                yield Row(event_id=event, user_id=key[0], k=n[start], retry_minutes=-((at - start - self.micros) // 60_000_000))
        if n:
            if last is None or max(n) > last:
                self.handle.registerTimer((max(n) + self.micros) // 1000)
            self._keep(n, seen)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(*self._open(timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    def close(self) -> None:
        pass


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a key as one row, their times and ids as lists: rows reach the limiter one by one, which costs more than an event in
    a list. A key with more than PACKED events has several rows."""
    held = []

    def rows():
        found = pa.Table.from_batches(held).group_by(["user_id", "stretch"], use_threads=False).aggregate([("at", "list"), ("event_id", "list")])
        yield from found.select(["user_id", "stretch", "at_list", "event_id_list"]).rename_columns(["user_id", "stretch", "at", "event_id"]).to_batches(max_chunksize=10_000)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield from rows()
            held = []
    if held:
        yield from rows()


def over_limit(events: DataFrame, most: int, minutes: int = 60, delay: str = "1 hour") -> DataFrame:
    """(event_id, user_id, k, retry_minutes) of the events beyond the first `most` of each user and tumbling window, on a stream. State
    is kept by user and stretch of DAYS, so a busy user's stretches lie in different tasks. Events are answered unless the watermark has
    passed the end of their window. Events without a user are one key's. Start the query with STORE set."""
    micros = minutes * 60_000_000
    timed = as_stream_time(events).where("ts is not null").select("event_id", "user_id", "ts").withWatermark("ts", delay)
    # A window lies whole in the stretch in which it begins.
    at = F.unix_micros("ts")
    keyed = timed.select("user_id", F.floor((at - F.pmod(at, F.lit(micros))) / F.lit(DAYS * 86_400_000_000)).alias("stretch"), at.alias("at"), "event_id")
    together = keyed.repartition("user_id", "stretch").mapInArrow(packed, "user_id long, stretch long, at array<long>, event_id array<long>")
    return together.groupBy("user_id", "stretch").transformWithState(Limiter(most, micros), "event_id long, user_id long, k long, retry_minutes long", "Append", "EventTime")

"""Streams with keyed state and keyed tables: order of arrival, late, repeated and replayed events, and what state is left."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peptrellis.streaming import events as E
from peptrellis.streaming.keyed import LATEST_SCHEMA, claims, first_claims, latest_states, states
from peptrellis.streaming.limits import STORE, over_limit

EVENTS = "event_id long, user_id long, ts timestamp"


def at(minute, second=0):
    return f"2024-03-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"


def arrive(spark, folder, rows):
    """One file, so one batch of a stream that is run after each."""
    df = spark.createDataFrame([(e, u, t) for e, u, t in rows], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)


def refused(spark, folder, work, most=2):
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    E.run_once(over_limit(stream, most), f"{work}/out", f"{work}/checkpoint", settings=STORE)
    return sorted(map(tuple, spark.read.schema("event_id long, user_id long, k long, retry_minutes long").parquet(f"{work}/out").collect()), key=repr)


def expected(rows, most=2):
    windows, out = defaultdict(list), []
    for e, u, t in rows:
        hour, minute, second = (int(x) for x in t[11:].split(":"))
        windows[u, hour].append((minute * 60 + second, e))
    for (u, _), seen in windows.items():
        out += [(e, u, k, -(-(3600 - s) // 60)) for k, (s, e) in enumerate(sorted(seen), 1) if k > most]
    return sorted(out, key=repr)


def test_refusals_over_many_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((k, rng.choice([1, 1, 2, None]), at(rng.randrange(300), rng.randrange(60))) for k in range(80)), key=lambda r: (r[2], r[0]))
    folder, work = str(tmp_path / "in"), str(tmp_path)
    for k in range(0, 80, 20):
        arrive(spark, folder, rows[k : k + 20])
        found = refused(spark, folder, work)
    assert set(found) == set(expected(rows)) and len(found) == len(expected(rows))


def test_repeated_and_late_events_are_not_answered_again(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path)
    arrive(spark, folder, [(1, 7, at(1)), (2, 7, at(2)), (3, 7, at(3))])
    assert refused(spark, folder, work) == [(3, 7, 3, 57)]
    # Event 3 again, and 4 that comes late but within the watermark: counted as the next to arrive.
    arrive(spark, folder, [(3, 7, at(3)), (4, 7, at(0, 30))])
    assert refused(spark, folder, work) == [(3, 7, 3, 57), (4, 7, 4, 60)]
    # The watermark passes the first hour; what comes for it then is too late, and starts no new count.
    arrive(spark, folder, [(5, 7, at(600))])
    refused(spark, folder, work)
    arrive(spark, folder, [(6, 7, at(10)), (7, 7, at(11)), (8, 7, at(12))])
    assert refused(spark, folder, work) == [(3, 7, 3, 57), (4, 7, 4, 60)]


def test_no_state_is_left_after_the_last_timer(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path)
    arrive(spark, folder, [(k, k % 3, at(k)) for k in range(150)])
    refused(spark, folder, work)
    arrive(spark, folder, [(999, 5, at(1200))])
    refused(spark, folder, work)
    name, store = next(iter(STORE.items()))
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        left = spark.read.format("statestore").option("stateVarName", "count").load(f"{work}/checkpoint").collect()
        seen = spark.read.format("statestore").option("stateVarName", "seen").load(f"{work}/checkpoint").collect()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    # Only the window of the last event is open.
    assert [r.key.user_id for r in left] == [5] and len(seen) == 1


RUNS = "event_id long, user_id long, run_no long, ts timestamp, status string, stage string"


def run_rows(spark, n=120):
    rng = random.Random(8)
    rows = [(k, rng.randrange(9), rng.randrange(4), at(rng.randrange(600), rng.randrange(60)), rng.choice([None, "a", "b"]), rng.choice([None, "1", "2"])) for k in range(n)]
    return spark.createDataFrame(rows, RUNS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))


@pytest.mark.parametrize("kind", ["first", "latest"])
def test_keyed_tables_in_any_order_and_with_replays(spark, tmp_path, kind):
    rows = run_rows(spark).cache()
    table, of = (first_claims(spark, str(tmp_path / "t")), claims) if kind == "first" else (latest_states(spark, str(tmp_path / "t")), states)
    assert table.read().collect() == []
    whole = sorted(map(tuple, table.merge(of(rows)).collect()), key=repr)
    batches = [rows.where(F.pmod(F.hash("event_id"), F.lit(4)) == b) for b in (2, 0, 3, 1)]
    for n, b in enumerate(batches):
        table.put(of(b), n)
    assert sorted(map(tuple, table.read().collect()), key=repr) == whole
    # The last batch comes again (a restart before its commit), then one that was merged long ago as a new batch.
    table.put(of(batches[3]), 3)
    table.put(of(batches[0]), 4)
    assert sorted(map(tuple, table.read().collect()), key=repr) == whole
    assert len(table._versions()) <= 3


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    table = latest_states(spark, str(tmp_path / "t"))
    table.put(states(run_rows(spark, 20)), 0)
    good = sorted(map(tuple, table.read().collect()), key=repr)
    (tmp_path / "t" / "v=1").mkdir()
    spark.createDataFrame([], LATEST_SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "t" / "v=1"))
    (tmp_path / "t" / "v=1" / "_SUCCESS").unlink()
    assert sorted(map(tuple, table.read().collect()), key=repr) == good


def test_a_followed_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = run_rows(spark)
    table, folder = first_claims(spark, str(tmp_path / "t")), str(tmp_path / "in")
    for b in (1, 0):
        rows.where(F.col("event_id") % 2 == b).coalesce(1).write.mode("append").parquet(folder)
        table.follow(claims(spark.readStream.schema(RUNS).parquet(folder)), str(tmp_path / "c"))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, table.merge(claims(rows)).collect()))

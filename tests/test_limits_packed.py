"""A user's windows are one key's, whose events come as lists: few calls for state, the same refusals."""

import random

import pyarrow as pa
import pytest
from test_streams import arrive, at, expected, refused

from peptrellis.streaming import limits


def test_windows_of_a_user_share_their_state(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path)
    arrive(spark, folder, [(k, k % 2, at(30 * k)) for k in range(40)])
    refused(spark, folder, work)
    name, store = next(iter(limits.STORE.items()))
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        left = spark.read.format("statestore").option("stateVarName", "count").load(f"{work}/checkpoint").collect()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    # Two users with three open windows each: two keys.
    assert sorted(r.key.user_id for r in left) == [0, 1]


def test_events_packed_in_pieces(monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(2), k, rng.choice([None, k])) for k in range(100)]
    batch = pa.RecordBatch.from_pydict(dict(zip(("user_id", "stretch", "at", "event_id"), map(list, zip(*rows, strict=True)), strict=True)))
    for most in (limits.PACKED, 20):
        monkeypatch.setattr(limits, "PACKED", most)
        got = [r for b in limits.packed(batch.slice(k, 7) for k in range(0, 100, 7)) for r in b.to_pylist()]
        assert len(got) == 6 if most > 100 else len(got) > 6
        flat = [(r["user_id"], r["stretch"], a, e) for r in got for a, e in zip(r["at"], r["event_id"], strict=True)]
        assert sorted(flat, key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("days", [32, 0.0625])
def test_refusals_whatever_the_stretch(spark, tmp_path, monkeypatch, days):
    monkeypatch.setattr(limits, "DAYS", days)
    rng = random.Random(5)
    rows = sorted(((k, rng.choice([1, 2, None]), at(rng.randrange(400), rng.randrange(60))) for k in range(90)), key=lambda r: (r[2], r[0]))
    folder, work = str(tmp_path / "in"), str(tmp_path)
    for part in (rows[:50], rows[40:]):
        arrive(spark, folder, part)
        found = refused(spark, folder, work)
    assert sorted(found, key=repr) == expected(rows)

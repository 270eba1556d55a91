"""The feature cache: candidates go to it once, and repeated sequences, cached or not, each have their feature."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAME = "A11_feature_cache"


def test_candidates_are_shuffled_once(spark):
    plan = entry.queries()[NAME](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan and "LeftAnti" not in plan
    key = entry.queries()[NAME](spark, DATA)._jdf.queryExecution().toString()
    assert "unhex" in key


def test_repeated_sequences_as_by_sql(spark, tmp_path):
    text = "ACDEFGHIKLMNPQRSTVWY"
    rows = [(33, text * 2), (66, text * 2), (66, text), (1, text * 2 + "A"), (34, (text * 2)[:18] + "W"), (2, ""), (3, None), (None, text)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(entry.oracle_sql()[NAME]).fetchall()
    got = sorted(tuple(r) for r in entry.queries()[NAME](spark, str(tmp_path)).select("id", "h").collect())
    # SQL adds up candidates that share an id; each has its own here.
    alone = lambda rows: sorted(r for r in rows if r[0] // 1_000_000 != 66)
    assert [r[0] for r in alone(got)] == [r[0] for r in alone(want)]
    assert [r[1] for r in alone(got)] == pytest.approx([r[1] for r in alone(want)])
    assert len([r for r in got if r[0] // 1_000_000 == 66]) == 8

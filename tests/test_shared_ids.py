"""What meets by id only where documents share one: no shuffle otherwise, and results as by SQL either way."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
HERE = ["C4_site_exposure_join", "H22_conjoint_triads", "H16_dpc"]
TEXTS = [(4, "ACDEFGHIKLMNPQRSTVWY" * 3), (5, "mkv LLA aaaa 77 acdAAAAA"), (5, "MKVLLAGGRRST"), (5, "a"), (7, "AC"), (8, ""), (9, None), (-3, "ACDACDACDACDACDACDACDACDACDACDACDACD"), (11, "é, W"), (None, "ACDEF"), (None, "ACD")]


@pytest.mark.parametrize("name", HERE)
def test_candidates_with_ids_of_their_own_are_not_shuffled(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    for slow in ("Aggregate [id", "Sort", "Window", "LeftOuter", "Inner, (", "transform("):
        assert slow not in plan, slow


@pytest.mark.parametrize("sent", [100_000, 0])
@pytest.mark.parametrize("name", HERE)
def test_shared_ids_as_by_sql(spark, tmp_path, monkeypatch, name, sent):
    from peptrellis.sources import views

    monkeypatch.setattr(views, "SENT_IDS", sent)
    for data, folder in ((TEXTS, "shared"), ([t for t in TEXTS if t[0] != 5], "own")):
        spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        with duckdb.connect() as c:
            c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{folder}/documents.parquet/*.parquet'")
            want = c.sql(entry.oracle_sql()[name])
            got = entry.queries()[name](spark, f"{tmp_path}/{folder}")
            assert sorted(got.columns) == sorted(want.columns)
            assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())

"""Work on whole batches: no loops over residues in a row's expressions, no shuffles by candidate, results as by hand."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
IN_ROW = ["D15_bagged_logistic", "D35_crude_purity_product", "H36_kmer_multi_hot", "H24_apaac", "H25_qso_soc", "H26_autocorrelation", "E10_property_run_profile", "E11_repeat_residue_index", "H23_paac", "H20_ctd_distribution", "H19_ctd_transition", "H31_multi_scale_global_moment", "B5_constraint_filter", "H21_cetd"]


@pytest.mark.parametrize("name", IN_ROW)
def test_candidates_stay_in_their_batch(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    for slow in ("zip_with(", "transform(", "aggregate(", "Aggregate [id", "Sort", "Window", "Join"):
        assert slow not in plan, slow


def test_windows_meet_again_only_where_texts_share_a_key(spark):
    from peptrellis.operators.library import window_runs

    texts = spark.createDataFrame([(1, "acdefghiklmnp"), (2, "Acdefghiklmn, x"), (2, "ACDEFGHIKLMN"), (3, "short"), (4, None), (None, "ACDEFGHIKLMN"), (None, "CDEFGHIKLMNP")], "doc_id long, text string")
    found = {(r.doc_id, r.sequence): (r.first_at, r.n) for r in window_runs(texts, "doc_id").collect()}
    a, b = "ACDEFGHIKLMN", "CDEFGHIKLMNP"
    assert found == {(1, a): (0, 1), (1, b): (1, 1), (2, a): (0, 2), (None, a): (0, 1), (None, b): (0, 1)}
    counts = {r.doc_id: (r.windows, r.distinct_windows) for r in window_runs(texts, "doc_id", counts=True).collect()}
    assert counts == {1: (2, 2), 2: (2, 1), None: (2, 2)}


def test_deductions_divide_by_the_decimal_width(spark):
    from peptrellis.operators.ranking import deductions

    rows = spark.range(1009).select((F.col("id").cast("double") / 1008).alias("aggregation")).withColumn("cut", deductions(["aggregation"])["stability"])
    # As SQL computes it, to the last bit: equal scores stay equal and neither dominates.
    assert all(r.cut == min(0.4, max(0.0, (r.aggregation - 0.6) / 0.2)) for r in rows.collect())


def test_drivers_of_odd_sequences(spark):
    from peptrellis.operators.synthesis import found

    rows = spark.createDataFrame([(1, "VITVDGRM"), (2, "V"), (3, ""), (4, None), (5, "AVV"), (6, "VTI")], "id long, sequence string")
    got = {r.id: r.x for r in rows.select("id", found().alias("x")).collect()}
    assert [tuple(d)[:2] for d in got[1].drivers] == [(0, "VITV"), (4, "DG"), (6, "R"), (7, "M")] and got[1].n_isomers == 1
    assert got[1].crude_purity == pytest.approx((0.99 - 0.16) * 0.99**3 * 0.94 * 0.99 * 0.96)
    assert got[2].crude_purity == 1.0 and got[3].crude_purity == 1.0 and got[5].n_drivers == 0
    # A run ends with its sequence, even if the next one begins in V, I or T.
    assert [tuple(d)[:2] for d in got[6].drivers] == [(0, "VTI")]


def test_peptides_of_odd_texts(spark):
    from peptrellis.sources.views import Views

    texts = spark.createDataFrame([(1, "Ab cdé fß" + "k" * 20), (2, None), (3, "0 !"), (None, "acd")], "doc_id long, text string")
    got = [tuple(r) for r in Views(spark, DATA).tiled(texts, "doc_id").orderBy("id").collect()]
    assert got == [(1_000_000, "ACDFKKKKK"), (1_000_001, "K" * 9), (1_000_002, "KKKKKK")]


@pytest.mark.parametrize("name", ["D3_rank_counts", "X7_results_view"])
def test_counts_of_the_ranked_need_no_order(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    for slow in ("Sort", "Window", "Join"):
        assert slow not in plan, slow


def test_a_batch_deducts_as_columns_do(spark):
    import numpy as np

    from peptrellis.operators.ranking import deducted, deductions

    number = lambda m, low, high: (F.when(F.col("id") % m == 0, None).otherwise(low + F.col("id") * m % 1009 / 1008 * (high - low)))
    flags = {"net_charge": number(7, -12, 16), "hydrophobic_moment": number(11, 0, 1.2), "aggregation": number(13, 0, 1), "solubility": number(17, 0, 1), "isoelectric_point": number(19, 6, 9)}
    rows = spark.range(2000).select(*(c.alias(n) for n, c in flags.items()), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("id") % 3 + 1).cast("int")).alias("oxidation_risk"))
    rows = rows.select("*", *(c.alias(f"lost_{m}") for m, c in deductions(rows.columns).items())).toPandas()
    got = deducted({n: rows[n].to_numpy() for n in (*flags, "oxidation_risk")})
    assert sorted(got) == ["safety", "stability"]
    for m, x in got.items():
        assert np.array_equal(x, rows[f"lost_{m}"].to_numpy()), m


@pytest.mark.parametrize("most", [20_000, 50])
def test_layers_where_runs_lie(spark, monkeypatch, most):
    """Runs that lie together are not shuffled; runs in several pieces, or too large for a task, are layered whole all the same."""
    import random

    from peptrellis.operators import pareto
    from peptrellis.sources.shared import stage

    monkeypatch.setattr(pareto, "RUN_VECTORS", most)
    rng = random.Random(3)
    rows = [(i, run, rng.randrange(9) / 8, rng.randrange(9) / 8, rng.choice([None, 0.0, 0.5])) for i, run in enumerate([1] * 40 + [None] * 20 + [2] * 90 + [1] * 30 + [3] * 60)]
    df = spark.createDataFrame(rows, "id long, run long, a double, b double, c double")
    want = {r.id: r.layer for r in pareto.pareto_layers(df, ["a", "b", "c"], stage, by="run").collect()}
    for n in (1, 4):
        some = df.repartitionByRange(n, "id").sortWithinPartitions("id")
        got = pareto.layers_in_place(some, ["a", "b", "c"], stage, by="run")
        assert {r.id: r.layer for r in got.collect()} == want and got.columns == [*df.columns, "layer"]
    if most == 20_000:
        together = df.where("run >= 2").repartitionByRange(1, "id").sortWithinPartitions("id")
        assert "Exchange" not in pareto.layers_in_place(together, ["a", "b", "c"], stage, by="run")._jdf.queryExecution().executedPlan().toString()


def test_percentiles_with_many_values_and_few(spark, monkeypatch):
    from peptrellis.operators import ranking
    from peptrellis.sources.shared import stage

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7 / 7) for i in range(60)], "id long, x double")
    few = ranking.avg_rank_percentile(df, "x", stage)
    assert "Join LeftOuter" in (plan := few._jdf.queryExecution().optimizedPlan().toString()) and "broadcast" in plan
    monkeypatch.setattr(ranking, "SENT_VALUES", 3)
    many = ranking.avg_rank_percentile(df, "x", stage)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


def test_resamples_are_weighed_without_multiplying_rows(spark, monkeypatch):
    from peptrellis.operators import run_queries as Q

    rows = spark.createDataFrame([(i % 7 / 7, float(i % 3 == 0), i * 9_999_991 - 40_000_000) for i in range(300)], "amp double, y double, id long")
    each = rows.select("amp", "y", "id", F.explode(F.sequence(F.lit(1), F.lit(Q._RESAMPLES))).alias("b")).withColumn("u", F.expr(Q._UNIFORM)).withColumn("w", F.expr(Q._POISSON))
    want = {(r.amp, r.y, r.b - 1): r.w for r in each.groupBy("amp", "y", "b").agg(F.sum("w").alias("w")).collect()}
    for held in (Q._HELD, 5):
        monkeypatch.setattr(Q, "_HELD", held)
        part = [b for k in range(3) for b in Q._weighed(rows.where(f"id % 3 = {k} or id % 3 = -{k}").toArrow().to_batches(max_chunksize=40))]
        got = {}
        for b in Q._added(part):
            for amp, y, w in zip(*(c.to_pylist() for c in b.columns)):
                for k, x in enumerate(w):
                    got[amp, y, k] = got.get((amp, y, k), 0) + x
        assert got == want

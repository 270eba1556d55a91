"""Goldens, invariants and value checks of the screening engine."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from peptrellis import queries as registry
from peptrellis.functions import descriptors as D
from peptrellis.functions import scales as S
from peptrellis.operators import gates as G
from peptrellis.operators import library as L
from peptrellis.operators import pareto
from peptrellis.operators import ranking as R
from peptrellis.sources.files import read_fasta
from peptrellis.sources.shared import stage
from peptrellis.streaming import events as E

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registries_agree():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry_ranks_all_candidates(spark):
    out = entry.entry(spark)
    assert out.columns == ["id", "status", "final_score", "evidence_coverage", "rank", "pareto_rank"]
    ranks = sorted(r["rank"] for r in out.where("rank is not null").select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("name", ["B8_physchem_verdict_wound", "B15_function_gate_wound", "C4_site_exposure_join", "D24_weight_renormalise", "E3_avg_rank_percentile", "F2_page_desc", "H7_instability_index", "L3_truncation_scan", "S6_latest_non_null_state", "X3_rank_run_cosmetic"])
def test_values_equal_duckdb(spark, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(registry.ORACLE[name].strip())
        columns = sorted(want.columns)
        rows = lambda rs: sorted(map(repr, rs))
        plain = lambda x: None if x is None else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
        got = registry.QUERIES[name](spark, DATA)
        assert sorted(got.columns) == columns
        mine = rows([plain(r[k]) for k in columns] for r in got.collect())
        at = [want.columns.index(k) for k in columns]
        assert mine == rows([plain(r[k]) for k in at] for r in want.fetchall())


def layers_by_hand(vectors):
    left, out, k = dict(enumerate(vectors)), {}, 0
    while left:
        k += 1
        front = [i for i, v in left.items() if not any(all(a >= b for a, b in zip(w, v, strict=True)) and w != v for w in left.values())]
        for i in front:
            out[i] = k
            del left[i]
    return [out[i] for i in range(len(vectors))]


def test_pareto_layers(spark, monkeypatch):
    golden = [(1.0, 0.0), (0.0, 1.0), (0.4, 0.4), (0.0, 0.0)]
    rng = random.Random(1)
    many = [(rng.randrange(9) / 8, rng.randrange(9) / 8) for _ in range(300)]
    assert layers_by_hand(golden) == [1, 1, 1, 2]
    rows = [(i, 7, *v) for i, v in enumerate(golden)] + [(100 + i, 8, *v) for i, v in enumerate(many)]
    df = spark.createDataFrame(rows, "id int, run long, a double, b double").repartition(5)
    want = dict(zip([r[0] for r in rows], layers_by_hand(golden) + layers_by_hand(many), strict=True))
    # Once in one pass for each run, once in blocks.
    for most in (pareto.RUN_VECTORS, 20):
        monkeypatch.setattr(pareto, "RUN_VECTORS", most)
        assert {r.id: r.layer for r in pareto.pareto_layers(df, ["a", "b"], stage, by="run").collect()} == want
    whole = {r.id: r.layer for r in pareto.pareto_layers(df.where("run = 8"), ["a", "b"], stage).collect()}
    assert whole == {i: k for i, k in want.items() if i >= 100}
    assert pareto.pareto_layers(df.limit(0), ["a", "b"], stage).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_layers_by_every_way(width, monkeypatch):
    rng = random.Random(width)
    for levels in (3, 50):
        rows = [tuple(rng.randrange(levels) / 7 for _ in range(width)) for _ in range(160)]
        want = layers_by_hand(rows)
        for dense in (pareto.DENSE, 2):
            monkeypatch.setattr(pareto, "DENSE", dense)
            assert pareto.layers_of(np.array(rows)).tolist() == want
        distinct = np.array(sorted(set(rows)))
        first, rest = distinct[distinct[:, 0] >= 2 / 7], distinct[distinct[:, 0] < 2 / 7]
        above = pareto.layers_of(first)
        got = pareto.chained(rest, pareto.deepest_over(rest, first, above))
        assert dict(zip(map(tuple, [*first.tolist(), *rest.tolist()]), [*above.tolist(), *got.tolist()])) == dict(zip(rows, want))


def test_jobs_of_a_large_run_do_not_follow_its_layers(spark, monkeypatch):
    monkeypatch.setattr(pareto, "RUN_VECTORS", 2500)
    rng = np.random.default_rng(4)
    x = rng.random(10_000)
    y = x + rng.random(10_000) / 50
    df = spark.createDataFrame(pd.DataFrame({"id": range(10_000), "a": x, "b": y}))
    spark.sparkContext.setJobGroup("layers", "layers")
    got = {r.id: r.layer for r in pareto.pareto_layers(df, ["a", "b"], stage).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("layers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = pareto.layers_of(np.column_stack([x, y]))
    assert got == dict(enumerate(want.tolist()))
    assert max(got.values()) > 500 and jobs < 120


def test_dominators_in_small_ranges_and_with_ties(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, 0.5 if i % 3 else rng.randrange(5) / 5, rng.randrange(40) / 40 if i % 2 else 0.25) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    want = {i: sum(x >= a and y >= b and (x, y) != (a, b) for _, x, y in rows) for i, a, b in rows}
    for most in (7, 64):
        monkeypatch.setattr(pareto, "RANGE", most)
        assert {r.id: r.dominated_by for r in pareto.dominators(df, "a", "b", stage).collect()} == want
    assert pareto.dominators(df.limit(0), "a", "b", stage).count() == 0


def test_dominators_are_counted(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(30) / 30, rng.random() if i % 2 else 0.5) for i in range(400)]
    got = {r.id: r.dominated_by for r in pareto.dominators(spark.createDataFrame(rows, "id int, a double, b double"), "a", "b", stage).collect()}
    assert got == {i: sum(x >= a and y >= b and (x, y) != (a, b) for _, x, y in rows) for i, a, b in rows}


def test_missing_scores_count_as_zero_in_layers(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, 0.1, 0.5)], "id int, a double, b double")
    assert {r.id: r.layer for r in pareto.pareto_layers(df, ["a", "b"], stage).collect()} == {1: 2, 2: 1}


def survivors_by_hand(pool):
    """pool: (family, sequence, fitness, generation) of one population."""
    best, families, classed = sorted(pool, key=lambda m: (-m[2], m[1])), {}, []
    for rank, m in enumerate(best):
        families[m[0]] = families.get(m[0], 0) + 1
        classed.append((0 if rank < L.ELITES else 1 if families[m[0]] <= L.FAMILY_CAP else 2, *m))
    return sorted(classed, key=lambda m: (m[0], -m[3], m[2]))[: L.SIZE]


def generated_by_hand(seeds, rounds):
    """The rounds of library.generations in plain Python."""
    positive = lambda s: sum(c in "KR" for c in s) > sum(c in "DE" for c in s)
    fit = lambda s: round(fitness[s], 9) if positive(s) else L.FLOOR
    pops, out = {}, []
    for f, ss in sorted(seeds.items()):
        for s in ss:
            pops.setdefault(f % L.POPULATIONS, {}).setdefault(s, f)
    pops = {p: [m[1:] for m in survivors_by_hand([(f, s, fit(s), 0) for s, f in ss.items()])] for p, ss in pops.items()}
    for g in range(1, rounds + 1):
        for p, pool in pops.items():
            members, made = sorted(pool, key=lambda m: (-m[2], m[1])), {}
            for slot in range(L.CHILDREN):
                draw = lambda side: members[min((p * 7919 + slot * 104729 + (side * L.DRAWS + d) * 1299709 + g * 15485863) % len(members) for d in range(L.DRAWS))]  # noqa: B023, E731
                (family, a, *_), (_, b, *_) = draw(0), draw(1)
                at = lambda s, k: (p * 31 + slot * 17 + k + g) % max(len(s) - 1, 1) + 1  # noqa: B023, E731
                child, tries = a[: at(a, 5)] + b[at(b, 3) :], []
                for k in range(L.ATTEMPTS):
                    q, x = (p + slot * 3 + k * 7 + g) % len(child), ALPHABET[(p * 3 + slot + k + g) % 20]
                    cut = max(len(child) - 1, 1)
                    s = [child[:q] + x + child[q + 1 :], child[:cut], child[len(child) - cut :]][k % 3]
                    tries.append(s[: L.LONGEST].ljust(L.SHORTEST, x))
                s = next((s for s in tries if positive(s)), tries[-1])
                made[s] = min(made.get(s, family), family)
            have = {m[1] for m in pool}
            kept = survivors_by_hand([*pool, *((f, s, fit(s), g) for s, f in made.items() if s not in have)])
            pops[p] = [m[1:] for m in kept]
            out += [(g, p, f, born, s, x, c) for c, f, s, x, born in kept]
    return sorted(out)


class Fitness(dict):
    """Fitness by the engine's own columns, which other tests compare with SQL, for all sequences at once."""

    def __missing__(self, s):
        kd = sum(S.EISENBERG[c] for c in s) / len(s)
        charge = sum(s.count(a) / (1 + 10 ** (7.4 - pk)) for a, pk in S.PK_POSITIVE.items()) - sum(s.count(a) / (1 + 10 ** (pk - 7.4)) for a, pk in S.PK_NEGATIVE.items())
        charge += 1 / (1 + 10 ** (7.4 - S.PK_N_TERM_OF.get(s[0], S.PK_N_TERM))) - 1 / (1 + 10 ** (S.PK_C_TERM_OF.get(s[-1], S.PK_C_TERM) - 7.4))
        return kd - abs(charge - 3) / 10


fitness = Fitness()


def test_generations_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(L, "POPULATIONS", 3)
    monkeypatch.setattr(L, "SIZE", 9)
    rng = random.Random(14)
    seeds = {f: sorted({"".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6, 36))) for _ in range(rng.choice([1, 3, 9]))}) for f in range(8)}
    seeds[7].append(seeds[4][0])
    start = spark.createDataFrame([(f, s) for f, ss in seeds.items() for s in ss], "family long, sequence string")
    got = sorted((r.round, r.pop, r.family, r.generation, r.sequence, round(r.fitness, 9), r["class"]) for r in L.generations(start, 3, stage).collect())
    want = generated_by_hand(seeds, 3)
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want] and all(abs(g[5] - w[5]) < 1e-8 for g, w in zip(got, want, strict=True))
    assert {g[3] for g in got} == {0, 1, 2, 3} and {g[6] for g in got} == {0, 1, 2}


def test_decoys_match_lengths(spark):
    winners = spark.createDataFrame([(i, "A" * (5 + i % 3)) for i in range(9)], "id long, sequence string")
    pool = spark.createDataFrame([(100 + i, "C" * (5 + i % 2) ) for i in range(40)] + [(900, "C" * 7)], "id long, sequence string")
    got = L.decoys(winners, pool).collect()
    assert sorted((r.id, len(r.sequence)) for r in got) == [(i, 5 + i % 3) for i in range(9)]


def test_percentile_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0), (5, None)], "id int, x double")
    got = {r.id: r.percentile for r in R.avg_rank_percentile(df, "x", stage).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: None}
    assert R.avg_rank_percentile(df.where("id = 1"), "x", stage).first().percentile == 0.5


def test_rank_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, round(rng.random(), 2)) for i in range(500)], "id int, s double")
    want = [r.id for r in df.orderBy(F.desc("s"), "id").collect()]
    for n in (1, 13):
        got = R.global_rank(df.repartition(n), "s", [F.col("id")], stage).orderBy("rank").collect()
        assert [r.id for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))


def test_weights_sum_to_one_and_empty_briefs_count_all(spark):
    briefs = spark.createDataFrame([(1, ["antimicrobial"], ["chronic"], ["x"]), (2, [], [], [])], "brief_id long, functions array<string>, contexts array<string>, pathogens array<string>")
    modules = spark.createDataFrame([(1, "antimicrobial", "objective"), (2, "wound_closure", "objective"), (3, "safety", "always_on")], "k int, module string, grp string")
    counts = R.objective_counts(briefs, modules)
    assert {r.n_k for r in counts.where("brief_id = 2").collect()} == {1.0}
    for r in R.module_weights(counts, modules).groupBy("brief_id").agg(F.sum("nominal_weight").alias("w")).collect():
        assert r.w == pytest.approx(1)


def test_a_check_that_did_not_run_never_passes(spark):
    df = spark.createDataFrame([(1, None), (2, 0.9), (3, 0.1)], "id int, x double")
    got = {r.id: (r.overall, list(r.not_screened)) for r in G.verdicts(df, [G.Check("x_check", "x > 0.5", "reject")]).collect()}
    assert got == {1: ("flag", ["x_check"]), 2: ("reject", []), 3: ("pass", [])}


def test_descriptors_of_known_peptides(spark):
    df = spark.createDataFrame([("GIGKFLHSAKKFGKAFVGEIMNS",), ("G",), ("NGNS",)], "sequence string")
    got = {r.sequence: r for r in D.physchem(df).withColumn("pi", D.isoelectric_point()).collect()}
    assert got["GIGKFLHSAKKFGKAFVGEIMNS"].molecular_weight == pytest.approx(2466.9, abs=0.2)
    # Four lysines, a histidine, a glutamate and both ends at pH 7.4.
    by_hand = 4 / (1 + 10 ** (7.4 - 10)) + 1 / (1 + 10 ** (7.4 - 5.98)) + 1 / (1 + 10 ** (7.4 - 7.5)) - 1 / (1 + 10 ** (4.45 - 7.4)) - 1 / (1 + 10 ** (3.55 - 7.4))
    assert got["GIGKFLHSAKKFGKAFVGEIMNS"].net_charge == pytest.approx(by_hand, abs=1e-6)
    assert got["G"].instability_index == 0 and got["NGNS"].n_deamidation == 2
    assert 9 < got["GIGKFLHSAKKFGKAFVGEIMNS"].pi < 11


def test_fasta_joins_wrapped_lines(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">a\nACD\nEFG\n\n>b\nKL\n")
    assert sorted((r.id, r.sequence) for r in read_fasta(spark, str(path)).collect()) == [("a", "ACDEFG"), ("b", "KL")]


def test_streamed_windows_equal_the_closed_ones(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{DATA}/events.parquet*")
    out = str(tmp_path / "out")
    E.run_once(E.window_counts(stream, "15 minutes"), out, str(tmp_path / "state"))
    got = {(r.start, r.user_id): r.n for r in spark.read.parquet(out).collect()}
    every = {(r.start, r.user_id): r.n for r in E.window_counts(table, "15 minutes").collect()}
    last = table.agg(F.max(F.col("ts").cast("timestamp")).alias("t")).first().t
    closed = {k: n for k, n in every.items() if (last - k[0]).total_seconds() >= 3600 + 900}
    assert got == closed

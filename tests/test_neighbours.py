"""Nearest neighbours by edits, against all pairs."""

import random

from pyspark.sql import functions as F

from peptrellis.operators import neighbours
from peptrellis.sources.shared import stage

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, s, n):
    for _ in range(n):
        k = rng.randrange(max(len(s), 1))
        s = s or "A"
        s = s[:k] + rng.choice(["", rng.choice(LETTERS), rng.choice(LETTERS) + s[k]]) + s[k + 1 :]
    return s or "A"


def test_distances_equal_all_pairs(spark):
    rng = random.Random(3)
    some = ["".join(rng.choices(LETTERS, k=rng.randrange(1, 41))) for _ in range(60)]
    some += [changed(rng, s, n) for s in some[:40] for n in (1, 3, 6)] + ["A" * n for n in (1, 2, 8, 9, 30)] + ["AC" * 12, "CA" * 12]
    df = spark.createDataFrame([(s,) for s in some + some[:5]], "sequence string")
    found = {r.sequence: r.distance for r in neighbours.nearest(df, stage).collect()}
    every = sorted(set(some))
    want = {a: min(edits(a, b) / max(len(a), len(b)) for b in every if b != a) for a in every}
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-12 for s in want)


def test_few_pairs_are_compared_where_neighbours_are_near(spark):
    rng = random.Random(4)
    some = ["".join(rng.choices(LETTERS, k=rng.randrange(20, 41))) for _ in range(1000)]
    some += [changed(rng, s, rng.choice([1, 2])) for s in some]
    df = spark.createDataFrame([(s,) for s in set(some)], "sequence string").withColumn("n", F.length("sequence"))
    n = df.count()
    for k in (1, 2):
        pairs = neighbours.candidates(df.where(F.col("n") - k >= 3 * (k + 1)), df, k)
        assert pairs.count() < n * n / 1000
    near = neighbours.candidates(df, df, 2).where(F.levenshtein("sequence", "other") <= 2).select("sequence").distinct().count()
    # Some changes change nothing: those have no neighbour.
    assert near == n - (2000 - n)


def test_no_neighbour_at_all(spark):
    assert neighbours.nearest(spark.createDataFrame([("ACD",)], "sequence string"), stage).collect() == []

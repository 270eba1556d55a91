"""Ancestry in graphs and exact quantiles, against plain Python."""

import random
from collections import defaultdict

import numpy as np

from peptrellis.operators.lineage import ancestry, edges_of
from peptrellis.operators.quantiles import quantiles
from peptrellis.sources.shared import stage


def ancestors(spark, rows):
    history = spark.createDataFrame(rows, "variant string, parents string")
    return {(r.child, r.ancestor): r.depth for r in ancestry(edges_of(history, "variant", "parents"), stage).collect()}


def by_search(rows):
    up, out = defaultdict(set), {}
    for child, parents in rows:
        up[child] |= {p.strip() for p in (parents or "").split(",") if p.strip() and p.strip() != child}
    for child in list(up):
        depth, level, seen = 0, {child}, {child}
        while level:
            depth, level = depth + 1, {p for x in level for p in up.get(x, ())} - seen
            seen |= level
            out |= {(child, p): depth for p in level}
    return out


def test_a_diamond_keeps_the_least_depth(spark):
    rows = [("d", "b, c"), ("b", "a"), ("c", "a"), ("e", "d,a"), ("a", None), ("f", " , ")]
    found = ancestors(spark, rows)
    assert found == by_search(rows)
    assert found[("d", "a")] == 2 and found[("e", "a")] == 1


def test_cycles_end_and_nobody_is_its_own_ancestor(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a,d"), ("x", "x,a")]
    found = ancestors(spark, rows)
    assert found == by_search(rows)
    assert all(child != ancestor for child, ancestor in found)


def test_long_lines_and_random_crossings(spark):
    rng = random.Random(2)
    rows = [(f"v{k}", f"v{k - 1}") for k in range(1, 70)]
    rows += [(f"w{k}", ",".join(f"w{rng.randrange(k)}" for _ in range(2))) for k in range(1, 60)]
    assert ancestors(spark, rows) == by_search(rows)
    assert ancestors(spark, []) == {}


def test_quantiles_equal_those_of_numpy(spark):
    rng = random.Random(7)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([rng.random(), 0.25, 1.5])) for g in ["a", "b", None] for _ in range(rng.randrange(50, 300))]
    rows += [("one", 3.0), ("none", None), ("tied", 2.0), ("tied", 2.0), ("two", 1.0), ("two", 5.0)]
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    found = {r.g: (r.n, r.q) for r in quantiles(df, "x", probabilities, ["g"], stage).collect()}
    groups = defaultdict(list)
    for g, x in rows:
        if x is not None:
            groups[g].append(x)
    assert found.keys() == groups.keys()
    for g, xs in groups.items():
        assert found[g][0] == len(xs)
        assert np.allclose(found[g][1], np.quantile(xs, probabilities), atol=1e-12)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.createDataFrame([(float(k % 5),) for k in range(11)], "x double")
    assert [(r.n, r.q) for r in quantiles(df, "x", [0.5], [], stage).collect()] == [(11, [2.0])]
    assert quantiles(df.limit(0), "x", [0.5], [], stage).collect() == []

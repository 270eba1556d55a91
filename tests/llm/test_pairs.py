"""Near copies and decontamination against brute force, and on awkward tables."""

import collections
import random

import numpy as np
import pytest

pytest.importorskip("peptrellis.llm")
from peptrellis.llm import decontaminate, nearcopy  # noqa: E402

EXTRA = "doc_id long, text string, part string, key string, same string"


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = rng.randrange(len(ws))
        ws[k : k + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [ws[k], f"y{rng.randrange(10**6)}"]])
    return ws


def brute(texts):
    """Classes by labelled five-word shingles of similarity of 0.8 or more, all pairs."""
    sh = {}
    for i, t in texts.items():
        ws, seen, out = (t or "").lower().split(), collections.Counter(), set()
        for k in range(max(1, len(ws) - 4) if ws else 0):
            g = tuple(ws[k : k + 5])
            out.add((g, seen[g]))
            seen[g] += 1
        sh[i] = out
    parent = {i: i for i in sh}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sh)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sh[a] & sh[b])
            if both and both / (len(sh[a]) + len(sh[b]) - both) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    texts, k = {}, 0
    for group in range(12):
        base = words(rng, rng.choice([8, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 70 if group == 3 else 3])):
            texts[k] = " ".join(edited(rng, base, rng.choice([0, 0, 1, 2])))
            k += 1
    for _ in range(60):
        texts[k] = " ".join(words(rng, rng.randrange(1, 200)))
        k += 1
    texts |= {k: "a b", k + 1: "A  b\n", k + 2: "", k + 3: None, k + 4: " \n", k + 5: "a b c"}
    df = spark.createDataFrame([(i, t, "p", "k", "s") for i, t in texts.items()], EXTRA).repartition(5)
    got = {r.doc_id: r for r in nearcopy.near_duplicates(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute(texts)
    sizes = collections.Counter(r.class_id for r in got.values())
    assert all(r.n_class == sizes[r.class_id] for r in got.values())


def test_drifting_versions_in_large_buckets_equal_brute_force(spark, monkeypatch):
    """Eight lines of versions, each near its neighbours only; with all ways for large buckets and busy nodes."""
    monkeypatch.setattr(nearcopy, "BLOCK_TEXTS", 5)
    monkeypatch.setattr(nearcopy, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(nearcopy, "HOT", 9)
    rng = random.Random(3)
    base, out = words(rng, 150), []
    for _ in range(8):
        ws = list(base)
        for _ in range(25):
            for at in rng.sample(range(2, 148, 5), 3):
                ws[at] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(ws))
    texts = dict(enumerate(out))
    df = spark.createDataFrame([(i, t, "p", "k", "s") for i, t in texts.items()], EXTRA).repartition(5)
    assert {r.doc_id: r.class_id for r in nearcopy.near_duplicates(df).collect()} == brute(texts)


def test_alignment_is_sensitive_to_order():
    a = np.arange(1000, dtype=np.uint64)
    swapped = np.concatenate([a[500:], a[:500]])
    assert nearcopy.similarity(a, a) == 1.0
    assert nearcopy.similarity(a, swapped) < 0.8
    assert nearcopy.similarity(a, np.delete(a, np.s_[10:60])) == pytest.approx(0.95)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], EXTRA)
    assert nearcopy.near_duplicates(empty).collect() == []
    row = (7, "one two three four five six", "p", "k", "s")
    twice = nearcopy.near_duplicates(spark.createDataFrame([row, row], EXTRA)).collect()
    assert [(r.doc_id, r.class_id, r.n_copies) for r in twice] == [(7, 7, 2)] * 2


def test_rows_without_id_and_ids_with_two_texts(spark):
    """The pipeline's stage against brute force over the rows."""
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    near = lambda ws: " ".join([*ws[:-1], "other"])
    rows = [
        (None, " ".join(a)), (None, near(a)), (None, " ".join(b)), (4, near(b)), (5, " ".join(c)), (5, " ".join(d)), (6, near(d)), (7, " ".join(e)), (7, " ".join(e)),
        (None, ""), (None, ""), (None, None), (8, ""), (8, ""),
    ]
    df = spark.createDataFrame([(i, t, "p", "k", "s") for i, t in rows], EXTRA).repartition(3)
    classes = brute(dict(enumerate(t for _, t in rows)))
    got = collections.Counter((r.doc_id, r.class_id, r.n_class) for r in nearcopy.near_duplicates(df).collect())
    want = collections.Counter()
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in classes if classes[m] == classes[k]]
        want[i, min((x for x in ids if x is not None), default=None), len(ids)] += 1
    assert got == want
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(t for i, t in left if i is None and t) in ([" ".join(a)], [near(a)])
    assert collections.Counter(x for x in left if x[0] is not None or not x[1]) == collections.Counter([(4, near(b)), (5, " ".join(c)), (5, " ".join(d)), (7, " ".join(e)), (8, ""), (None, ""), (None, ""), (None, None)])


def smith_waterman(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignment_scores_equal_the_plain_recurrence():
    rng = np.random.default_rng(3)
    windows = [rng.integers(2, 9, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    items = [rng.integers(2, 9, rng.integers(1, 15)).astype(np.uint64) for _ in range(60)]
    assert decontaminate.align(windows, items).tolist() == [smith_waterman(w, t) for w, t in zip(windows, items, strict=True)]


def test_leaks_exact_edited_partial_and_clean(spark):
    rng = random.Random(9)
    item = words(rng, 30)
    other = words(rng, 25)
    around = lambda ws: " ".join([*words(rng, 80), *ws, *words(rng, 90)])
    docs = [
        (1, around(item)), (2, around(edited(rng, item, 4))), (3, around(item[:20])), (4, around(words(rng, 30))), (5, around([w.upper() + "," for w in item])),
        (6, around(item[:6])), (7, None), (8, ""), (9, " ".join(item)), (10, around([*item, *other])), (10, around([*item, *other])),
        (11, around(["Too", "short!"])), (12, around(["too", "x", "short"])), (None, " ".join(other)), (13, around(item) + " filler" * 100_000),
    ]
    df = spark.createDataFrame([(i, t, "p", "k", "s") for i, t in docs], EXTRA)
    bench = spark.createDataFrame([(100, " ".join(item), 1), (101, " ".join(other), 2), (102, None, 3), (103, "too short", 4), (None, "x " * 9, 5), (104, "", 6), (100, " ".join(item), 1)], "item_id long, text string, doc_id int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(-1, 101), (1, 100), (2, 100), (3, 100), (5, 100), (9, 100), (10, 100), (10, 100), (10, 101), (10, 101), (11, 103), (13, 100)]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7, 8, 12]
    for docs_, bench_ in ((df.limit(0), bench), (df, bench.limit(0))):
        assert decontaminate.leaks(docs_, bench_).count() == 0
        assert decontaminate.clean(docs_, bench_).count() == docs_.count()


def test_seeds_find_what_all_pairs_alignment_finds(spark, monkeypatch):
    """Recall against Smith-Waterman of every item with every whole document; once with shuffled joins."""
    rng = random.Random(31)
    common = ["of", "the", "and", "to", "in"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else w for w in words(rng, n, 400)]
    items = {100 + k: text(rng.randrange(8, 40)) for k in range(25)}
    docs = {}
    for k in range(250):
        ws = text(rng.randrange(5, 120))
        if k % 2:
            held = edited(rng, rng.choice(list(items.values())), rng.randrange(9))
            ws[3:3] = held[: rng.randrange(len(held) // 2, len(held) + 1)]
        docs[k] = ws
    ids = {w: n + 1 for n, w in enumerate(sorted({w for ws in [*items.values(), *docs.values()] for w in ws}))}
    code = lambda ws: np.array([ids[w] for w in ws], np.uint64)
    want = set()
    for i, item in items.items():
        scores = decontaminate.align([code(ws) for ws in docs.values()], [code(item)] * len(docs))
        want |= {(k, i) for k, x in zip(docs, scores, strict=True) if x >= len(item)}
    df = spark.createDataFrame([(k, " ".join(ws)) for k, ws in docs.items()], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string")
    for most in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) > 50
    assert decontaminate.leaks(df.limit(0), bench).collect() == []
    assert decontaminate.leaks(df, bench.limit(0)).collect() == []


@pytest.mark.parametrize("told", [1000, 2])
def test_rows_whose_keys_collide_stay_apart(spark, monkeypatch, told):
    from pyspark.sql import functions as F

    from peptrellis.llm import common

    rng = random.Random(12)
    bases = [words(rng, 60) for _ in range(15)]
    texts = {k: " ".join(edited(rng, bases[k % 15], k // 15)) for k in range(40)}
    item = words(rng, 40)
    texts[40], texts[41] = " ".join(words(rng, 30) + item + words(rng, 30)), " ".join(words(rng, 80))
    docs = spark.createDataFrame([(i, t, "r", "l", "k") for i, t in texts.items()], "doc_id long, text string, _row string, _LEAK_row string, __ROW string").repartition(3)
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = {i: c for i, c in brute(texts).items()}
    monkeypatch.setattr(common, "_first_key", lambda: F.pmod(F.xxhash64("doc_id", "text"), F.lit(7)))
    monkeypatch.setattr(common, "TOLD_APART", told)
    assert {r.doc_id: r.class_id for r in nearcopy.near_duplicates(docs).collect()} == want
    kept = nearcopy.first_of_classes(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted((i, texts[i], "r", "l", "k") for i in set(want.values()))
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect())) == sorted((i, t, "r", "l", "k") for i, t in texts.items() if i != 40)

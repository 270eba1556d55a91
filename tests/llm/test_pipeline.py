"""The corpus pipeline, stage by stage and as a whole, on small awkward tables."""

import collections
import hashlib
import random

import pytest

pytest.importorskip("peptrellis.llm")
pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from peptrellis.llm import secrets  # noqa: E402

#: Columns that operators use inside have the same names as some of these.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, part string, nth int, size int, toxic int"
RUDE = ["idiot", "scum", "moron", "trash"]


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def table(spark, folder, rows, labels=(), benchmark=()):
    full = [(i, t, "en", s, None if t is None else len(t), 7, "k", "p", 1, 2, 0) for i, t, s in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def run_by_stages(spark, folder):
    """What each stage keeps, as (doc_id, text); the last one's rows."""
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = corpus_pipeline.staged(docs, "test")
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(4)
    rows, labels, hidden = [], [], {}
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    for i in range(80):
        bad = i % 4 == 0
        ws = words(rng, 40)
        for _ in range(4 if bad else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(RUDE))
        if i % 4 == 1:
            hidden[i] = hexes()
            ws[20:20] = ["token", "=", f'"{hidden[i]}"']
        if i % 4 == 2:
            ws[20:20] = ["order", str(rng.randrange(10**15, 10**16))]
        rows.append((i, " ".join(ws), "src"))
        labels.append((i, 1, int(bad)))
    item, copy, hidden[103] = words(rng, 30), words(rng, 60), hexes()
    near = " ".join([*copy[:-1], "other"])
    extra = [
        (100, " ".join(copy), "s"), (101, near, "s"), (None, near, None), (102, " ".join([*words(rng, 30), *item, *words(rng, 30)]), "s"), (103, " ".join(words(rng, 30)) + f' token = "{hidden[103]}" ' + " ".join(words(rng, 30)), "s"),
        (104, None, None), (105, "", ""), (None, None, "s"), (None, "", "s"), (106, " ".join(words(rng, 20)), "s"), (106, " ".join(words(rng, 20)), "s"), (107, "same words here", "s"), (107, "same words here", "s"),
        (108, " ".join(words(rng, 30_000)), "s"), (109, "x", "s"),
    ]
    folder = table(spark, tmp_path, rows + extra, [*labels, (None, 1, 1), (300, None, None)], [(1, " ".join(item)), (2, None), (None, "a b c")])
    (clean, single, unleaked, masked), out = run_by_stages(spark, folder)
    texts = rows + extra
    # Toxic documents go; nothing else does.
    assert collections.Counter(clean) == collections.Counter((i, t) for i, t, _ in texts if not (t and any(w in t.split() for w in RUDE)))
    # Of near copies one stays, and of repeated rows; rows without a word stay.
    gone = collections.Counter(clean) - collections.Counter(single)
    assert gone == collections.Counter([(101, near), (None, near), (107, "same words here")])
    # The leaked document goes.
    assert collections.Counter(single) - collections.Counter(unleaked) == collections.Counter([(102, extra[3][1])])
    # Secrets are masked, nobody goes.
    assert len(masked) == len(unleaked)
    hide = lambda i, t: t.replace(hidden[i], secrets.MASK) if i in hidden else t
    assert collections.Counter(masked) == collections.Counter((i, hide(i, t)) for i, t in unleaked)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == sorted((str(i), sha(t)) for i, t in masked)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in whole.collect()) == sorted((str(r.doc_id), r.ids_sha256) for r in out)


def test_empty_tables_and_no_labels(spark, tmp_path):
    assert corpus_pipeline.run(spark, table(spark, tmp_path / "none", [])).count() == 0
    rows = [(1, "some words of a text", "s"), (2, "other words, other text", "s"), (2, None, None)]
    got = corpus_pipeline.run(spark, table(spark, tmp_path / "few", rows, [(1, 1, 1), (2, 0, 0)])).collect()
    assert len(got) == 3

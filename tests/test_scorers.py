"""The contract of scorers: one load a process, a score for each sequence, each distinct one scored once."""

import os

import pytest
from pyspark.sql import functions as F

from peptrellis.operators import scorers


def loads(folder):
    """A scorer that leaves a file for each time it is loaded and each sequence that it scores."""

    def load():
        with open(f"{folder}/load-{os.getpid()}", "a") as f:
            f.write("x")

        def score(batch):
            with open(f"{folder}/scored-{os.getpid()}", "a") as f:
                f.write("".join(s + "\n" for s in batch))
            return [len(s) for s in batch]

        return score

    return load


def test_a_scorer_is_loaded_once_a_worker_and_sees_each_value_once(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else "A" * (1 + k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, sequence string").repartition(8)
    score = scorers.scorer(f"len {tmp_path}", loads(tmp_path))
    for _ in range(2):
        got = {r.id: r.score for r in scorers.score_distinct(df, score).collect()}
        assert got == {k: None if s is None else float(len(s)) for k, s in rows}
    files = list(tmp_path.glob("load-*"))
    assert files and all(f.read_text() == "x" for f in files)
    assert sorted(s for f in tmp_path.glob("scored-*") for s in f.read_text().split()) == sorted([f"{'A' * n}" for n in range(1, 6)] * 2)


def test_a_wrong_number_of_scores_is_an_error(spark):
    with pytest.raises(ValueError):
        scorers.checked(lambda batch: [1.0], ["A", "C"])
    short = scorers.scorer("too short", lambda: lambda batch: [0.0] * (len(batch) - 1))
    with pytest.raises(Exception, match="scores for"):
        spark.createDataFrame([("A",), ("C",)], "sequence string").select(short("sequence")).collect()


def test_single_sequences_and_nulls(spark):
    half = scorers.scorer("half", lambda: scorers.from_scalar(lambda s: None if s == "X" else len(s) / 2))
    df = spark.createDataFrame([("AB",), (None,), ("X",)], "sequence string")
    assert [r.s for r in df.select(half(F.col("sequence")).alias("s")).collect()] == [1.0, None, None]

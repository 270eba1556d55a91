"""Scorers that are plugged in: a batch of sequences in, a number for each out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batch = Callable[[list[str]], list[float]]
#: What this process has loaded, by name.
_loaded: dict[str, Batch] = {}


def loaded(name: str, load: Callable[[], Batch]) -> Batch:
    """The scorer of this name, loaded once a process: workers that live on keep it for later tasks."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def checked(score: Batch, batch: list[str]) -> list[float]:
    """A score for each of the batch; another number of them is an error, not a shift of all that follow."""
    out = [None if x is None else float(x) for x in score(batch)]
    if len(out) != len(batch):
        raise ValueError(f"a scorer gave {len(out)} scores for {len(batch)} sequences")
    return out


def from_scalar(score: Callable[[str], float]) -> Batch:
    """A batch scorer from one of single sequences."""
    return lambda batch: [score(s) for s in batch]


def scorer(name: str, load: Callable[[], Batch]) -> Callable[[Column | str], Column]:
    """A column function of a scorer. load makes it where it runs (a model is read there, not shipped). Nulls are not scored."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = loaded(name, load)
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype="float64")
            have = s.notna()
            if have.any():
                out[have] = [float("nan") if x is None else x for x in checked(score, s[have].tolist())]
            yield out

    return run


def score_distinct(df: DataFrame, score: Callable[[Column | str], Column], column: str = "sequence", name: str = "score") -> DataFrame:
    """df with the scores of a column, each distinct value scored once."""
    some = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, score(column))
    return df.join(some, column, "left")

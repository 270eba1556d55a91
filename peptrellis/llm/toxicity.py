"""Toxicity: a cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k), k = 0..2, one weight vector for all thresholds, theta_0 < theta_1 < theta_2. Features:
log(1 + occurrences) of words, and of beginnings of words, that tell the labelled classes apart. Grade 0: labelled clean. Labelled toxic texts get grade 1, 2 or
3 by the sum of the features that are marks of toxic texts (odds of at least MARK_ODDS for toxic), cut at its terciles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, FlatTexts, hash_runs, least_by_hash, map_texts, mix, staged
from .decontaminate import Among, drop_rows

GRADES = 4
#: Labelled rows that the model is fitted on at most: those with the least hash of their id.
FIT_ROWS = 20_000
#: Words taken as features at most, the most telling ones; and the labelled texts that must hold each.
VOCABULARY, MIN_TEXTS = 3000, 5
#: Features whose odds for the classes differ less say nothing on their own.
TELLING = 4.0
MARK_ODDS = 20.0
#: Bytes of the word beginnings that are features too: inflected forms share them.
PREFIXES = (4, 6)
STEPS, RATE, RIDGE = 400, 0.1, 1e-5
REJECT = 0.5


def features_of(flat: FlatTexts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the first PREFIXES bytes of longer words, and the row of each; rows ascend."""
    data = LOWER[flat.data]
    starts, ends, first = flat.runs(LETTERS)
    row = np.repeat(np.arange(flat.n), np.diff(first))
    kinds, rows = [hash_runs(data, starts, ends)], [row]
    for k in PREFIXES:
        long = ends - starts > k
        kinds.append(mix(hash_runs(data, starts[long], starts[long] + k) + np.uint64(k)))
        rows.append(row[long])
    h, row = np.concatenate(kinds), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    """Words (hashes, sorted), their weights, and ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.among = Among(self.words)

    def above(self, flat: FlatTexts) -> np.ndarray:
        """P(grade > k) of each row (rows x thresholds)."""
        row, feature, x = sparse(self.among, *features_of(flat))
        z = np.bincount(row, self.weights[feature] * x, minlength=flat.n)
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def sparse(among: Among, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, log(1 + occurrences)) of the members of `among`."""
    at, k = among.find(h)
    cells, n = np.unique(row[at] * max(len(among.values), 1) + k, return_counts=True)
    return cells // max(len(among.values), 1), cells % max(len(among.values), 1), np.log1p(n)


def fit_ordinal(row: np.ndarray, feature: np.ndarray, x: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log loss of the cumulative links; ordered by theta_k = theta_0 + sum of exp(d)."""
    n, cuts = len(grades), GRADES - 1
    over = grades[:, None] > np.arange(cuts)[None, :]
    share = np.clip(over.mean(axis=0), 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(1 / share - 1) + np.arange(cuts) * 1e-3)
    p = np.concatenate([np.zeros(n_features), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[feature] * x, minlength=n)
        error = _sigmoid(z[:, None] - theta[None, :]) - over
        g_theta = -error.mean(axis=0)
        g = np.concatenate([np.bincount(feature, error.sum(axis=1)[row] * x, minlength=n_features) / n + RIDGE * w, [g_theta.sum()], [g_theta[k + 1 :].sum() * gaps[k] for k in range(cuts - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal | None:
    """The model; None (nothing is rejected then) if the labelled rows don't hold both classes, or no feature tells them apart.

    labels: doc_id, toxic (0 or 1; null is skipped, as is a null doc_id; of repeated rows the most toxic counts). Of different texts
    of one doc_id the first by code points is learnt from. Grades 1 to 3 are terciles of marks, since labels say toxic or not only.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = staged(least_by_hash(marks, ["doc_id"], FIT_ROWS), "fit-rows")
    # FIT_ROWS ids at most, and one text each.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def bags(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        h, row = features_of(flat)
        first = np.searchsorted(row, np.arange(flat.n + 1))
        lists = [np.unique(h[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        cuts = pa.array(np.cumsum([0, *(len(u) for u, _ in lists)]), pa.int32())
        counts = pa.array(np.concatenate([x[1] for x in lists] or [np.zeros(0)]).astype(np.int32))
        return pa.record_batch({"doc_id": part.column("doc_id"), "toxic": part.column("toxic").cast(pa.int32()), "words": pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[0] for x in lists] or [np.zeros(0, np.uint64)]).view(np.int64))), "n": pa.ListArray.from_arrays(cuts, counts)})

    rows = staged(map_texts(texts, bags, "doc_id long, toxic int, words array<long>, n array<int>"), "fit-words")
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return None
    spread = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g")).where(F.col("b") + F.col("g") >= MIN_TEXTS)
    odds = ((F.col("b") + 0.5) / (bad - F.col("b") + 0.5)) / ((F.col("g") + 0.5) / (good - F.col("g") + 0.5))
    gap = F.abs(F.col("b") / bad - F.col("g") / good) / F.sqrt((F.col("b") + F.col("g")) / (bad + good))
    telling = spread.select("word", odds.alias("odds"), gap.alias("gap")).where((F.col("odds") >= TELLING) | (F.col("odds") <= 1 / TELLING)).orderBy(F.desc("gap"), "word").limit(VOCABULARY).collect()
    if not telling:
        return None
    words = np.array([r.word for r in telling], np.int64).view(np.uint64)
    marking = np.array([r.word for r in telling if r.odds >= MARK_ODDS], np.int64).view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    known = docs.sparkSession.sparkContext.broadcast(words)

    def features(batches):
        for batch in batches:
            w = batch.column("words").flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("words").offsets.to_numpy()))
            k = np.minimum(np.searchsorted(known.value, w), len(known.value) - 1)
            hit = np.flatnonzero(known.value[k] == w)
            cuts = pa.array(np.searchsorted(row[hit], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[hit].astype(np.int32))) for x in (k, batch.column("n").flatten().to_numpy())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "k", "n"])

    # FIT_ROWS rows of VOCABULARY features at most.
    got = sorted(rows.mapInArrow(features, "doc_id long, toxic int, k array<int>, n array<int>").collect(), key=lambda r: (r.doc_id, r.toxic, r.k, r.n))
    row = np.repeat(np.arange(len(got)), [len(r.k) for r in got])
    feature, n = (np.concatenate([np.array(getattr(r, c), np.int64) for r in got]) for c in ("k", "n"))
    toxic = np.array([r.toxic for r in got])
    is_mark = np.isin(words, marking)
    strength = np.bincount(row, np.log1p(n) * is_mark[feature], minlength=len(got))
    cuts = np.quantile(strength[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (strength > cuts[0]).astype(int) + (strength > cuts[1]), 0)
    weights, thresholds = fit_ordinal(row, feature, np.log1p(n), grades, len(words))
    return Ordinal(words, weights, thresholds)


def scored(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """doc_id, expected_severity (0 to 3), severity (likeliest grade), p_toxic, rejected, for each row of docs (doc_id, text; other
    columns are dropped). A null or empty text has no features. Without a model all are 0 and nothing is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        over = held.value.above(flat) if held.value else np.zeros((flat.n, GRADES - 1))
        each = -np.diff(np.c_[np.ones(flat.n), over, np.zeros(flat.n)], axis=1)
        return pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "expected_severity": over.sum(axis=1), "severity": pa.array(each.argmax(axis=1).astype(np.int32)), "p_toxic": over[:, 0], "rejected": pa.array(over[:, 0] >= REJECT)})

    return map_texts(docs.select("doc_id", "text"), rows, "doc_id long, expected_severity double, severity int, p_toxic double, rejected boolean")


def clean(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay as they are."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    return drop_rows(docs, lambda flat: np.flatnonzero(held.value.above(flat)[:, 0] >= REJECT))

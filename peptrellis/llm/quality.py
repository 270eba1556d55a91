"""Quality rules: text statistics and decision lists learnt from labels by sequential covering.

Everything is DataFrame expressions. A rule is a conjunction of thresholds on statistics; learning grows it by information gain on
two thirds of the labelled rows, prunes its last conditions on the other third, keeps it if it is precise there, and goes on with
the rows that it does not cover. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: What separates words, and the symbols counted.
SPACES, WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Thresholds tried for each statistic: so many quantiles of the bad and of the good rows, and the middles between.
QUANTILES = 10
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 12, 3, 0.97, 10
FEATURES = {
    "words": "n_words",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
    "digit_share": "n_digits / word_chars",
    "distinct_share": "n_distinct / n_words",
    "words_per_line": "n_words / n_lines",
}


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more, the first included."""

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.get(p, k + 1) - x, F.lit(3))).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    counted = _bind(words, lambda w: _bind(windows(w), lambda s: _bind(starts(s), covered)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(counted).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each row's whole text (null: no words). Other columns are dropped; repeated rows stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    dropped = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return lines.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        dropped(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        dropped("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        dropped("!?").cast("long").alias("n_marks"),
        dropped("0123456789").cast("long").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _features() -> list[Column]:
    return [F.round(F.coalesce(F.expr(f"try_divide(cast({e.split(' / ')[0]} as double), {e.split(' / ')[1]})") if "/" in e else F.expr(f"cast({e} as double)"), F.lit(0.0)), 4).alias(n) for n, e in FEATURES.items()]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


def _counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict:
    """(feature, threshold) -> (bad, good) rows above it, on the growing rows; also the totals under None."""
    if not any(thresholds.values()):
        return {None: (0, 0)}
    passed = lambda n, ts: F.size(F.filter(F.array(*(F.lit(float(t)) for t in ts)), lambda t: F.col(n) > t))
    pairs = F.array(*(F.struct(F.lit(n).alias("f"), passed(n, ts).alias("k")) for n, ts in thresholds.items() if ts))
    got = rows.select("bad", F.explode(pairs).alias("x")).groupBy("x.f", "x.k").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).collect()
    out: dict = {}
    for n, ts in thresholds.items():
        own = {r["k"]: (r["b"], r["g"]) for r in got if r["f"] == n}
        for k, t in enumerate(ts):
            out[n, t] = tuple(sum(v[i] for j, v in own.items() if j > k) for i in (0, 1))
    first = next((n for n, ts in thresholds.items() if ts), None)
    out[None] = tuple(sum(r[x] for r in got if r["f"] == first) for x in ("b", "g"))
    return out


def _thresholds(quantiles: list[float]) -> list[float]:
    known = sorted(set(quantiles))
    return sorted({*known, *((a + b) / 2 for a, b in zip(known[:-1], known[1:], strict=True))})


def _grow(rows: DataFrame) -> list[Condition]:
    chosen: list[Condition] = []
    while len(chosen) < MAX_CONDITIONS:
        at_each = F.array(*(F.lit((q + 0.5) / QUANTILES) for q in range(QUANTILES)))
        at = rows.agg(*(F.percentile_approx(F.when(F.col("bad") == b, F.col(n)), at_each, F.lit(2000)).alias(f"{n}_{b}") for n in FEATURES for b in (0, 1))).first()
        counts = _counts(rows, {n: _thresholds([*(at[f"{n}_0"] or []), *(at[f"{n}_1"] or [])]) for n in FEATURES})
        bad, good = counts.pop(None)
        if not bad or not good:
            break
        best = (0.0, None)
        for (n, t), (b, g) in sorted(counts.items()):
            for above, p, q in ((True, b, g), (False, bad - b, good - g)):
                if p >= MIN_COVERED and (gain := p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))) > best[0] + 1e-9:
                    best = (gain, Condition(n, above, t))
        if best[1] is None:
            break
        chosen.append(best[1])
        rows = rows.where(best[1].column())
    return chosen


def learn(labelled: DataFrame) -> list[Rule]:
    """An ordered list of rules for bad rows. labelled: the statistics, doc_id and bad (1: low quality, 0: good). Empty: no rules."""
    rows = staged(labelled.select("doc_id", "bad", *_features(), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0).alias("held")), "labelled")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions = _grow(rows.where(~F.col("held")))
        if not conditions:
            break
        ways = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        got = rows.where("held").agg(*(F.sum(F.when(r.column() & (F.col("bad") == b), 1).otherwise(0)).alias(f"n{k}_{b}") for k, r in enumerate(ways) for b in (0, 1))).first()
        score = lambda k: ((p := got[f"n{k}_1"] or 0) - (q := got[f"n{k}_0"] or 0)) / max(p + q, 1)
        best = max(range(len(ways)), key=lambda k: (score(k), -k))
        p, q = got[f"n{best}_1"] or 0, got[f"n{best}_0"] or 0
        if p + q == 0 or p / (p + q) < MIN_PRECISION:
            break
        rules.append(ways[best])
        rows = rows.where(~ways[best].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that fires (1, 2, ...); null if none does."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(), F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: the counts, base_failed, kept, rule (number of the learnt rule that rejects it, else null).

    labels: doc_id, quality (0 or 1; null is skipped; several labels of one document count as its least). A null or empty text has
    no words and fails the base. Without labels no rule is learnt. docs' other columns are dropped; repeated rows stay.
    """
    stats = staged(statistics(docs), "statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality").cast("int")).alias("bad"))
    rules = learn(stats.join(marks, "doc_id"))
    scored = stats.select("*", *_features()).withColumn("rule", verdict(rules)).withColumn("base_failed", base_failed())
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")

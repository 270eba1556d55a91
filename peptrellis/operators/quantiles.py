"""Exact quantiles by distributed selection: no task or buffer holds the values of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import in_order


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str], stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(by, n, q): how many values each group has, and its quantiles in the order of `probabilities`, linearly between neighbours.

    Equal values are counted first; ranges of the order of (by, value) then know how many values stand before them, so a rank is looked
    up in the one range that holds it. Nulls don't count; a group without values has no row.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = in_order(sizes, [*map(F.col, by), F.col("_v")], stage, "_n")
    groups = ordered.groupBy(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by))).agg(F.min("_before").alias("_base"), F.sum("_n").alias("n"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    rows = ordered.join(groups, same) if by else ordered.crossJoin(F.broadcast(groups))
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    # Of each probability the ranks on both sides, and how much each counts.
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), r.cast("long").alias("rank"), w.alias("share")) for k, p in enumerate(probabilities) for r, w in ((F.floor(at(p)), 1 - (at(p) - F.floor(at(p)))), (F.floor(at(p)) + 1, at(p) - F.floor(at(p))))))
    first = F.col("_before") - F.col("_base")
    held = F.filter(wanted, lambda x: (x["share"] > 0) & (x["rank"] >= first) & (x["rank"] < first + F.col("_n")))
    parts = rows.where(F.size(held) > 0).select(*by, "n", "_v", F.explode(held).alias("x"))
    each = [F.sum(F.when(F.col("x.k") == k, F.col("_v") * F.col("x.share"))) for k in range(len(probabilities))]
    return parts.groupBy(*by, "n").agg(F.array(*each).alias("q"))

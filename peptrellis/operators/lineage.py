"""Ancestry in a graph of variants with any number of parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_of(history: DataFrame, child: str, parents: str) -> DataFrame:
    """(child, ancestor): one row for each parent in a comma-joined list; blanks, repeats and a variant as its own parent go."""
    each = history.select(F.col(child).cast("string").alias("child"), F.explode(F.split(parents, ",")).alias("ancestor"))
    each = each.withColumn("ancestor", F.trim("ancestor")).where("child is not null and ancestor <> '' and ancestor <> child")
    return each.distinct()


def ancestry(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(child, ancestor, depth): all ancestors of each child, at their least depth.

    Each round doubles the depth that is known: a shortest way longer than the reach begins with one of exactly the reach, so only
    those are joined, with all that is known. Pairs that are known don't come again, so cycles end (nobody is its own ancestor), and
    the number of rounds is the logarithm of the longest shortest way.
    """
    known, reach = stage(edges.select("child", "ancestor", F.lit(1).alias("depth")), "lineage"), 1
    while True:
        far = known.where(F.col("depth") == reach).select("child", F.col("ancestor").alias("via"))
        on = known.select(F.col("child").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = far.join(on, "via").where("child <> ancestor").groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
        more = stage(more.join(known, ["child", "ancestor"], "left_anti"), "lineage-more")
        if more.isEmpty():
            return known
        known, reach = stage(known.unionByName(more), "lineage"), reach * 2

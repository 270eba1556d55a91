"""Nearest neighbours by edit distance, exactly, through an index of segments.

If two sequences are at most k edits apart, one of the k + 1 segments that either is cut into stands unchanged in the other, moved by k
places at most. Segments are the join key, so only sequences that share one are compared; the radius k grows until the nearest
neighbour that was found must be the nearest of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radii that are tried, and residues that a segment has at least (a shorter one would be shared by too many).
RADII, SEGMENT = (1, 2, 4, 8), 3


def _gap(edits: Column) -> Column:
    return edits / F.greatest("n", "m")


def candidates(queries: DataFrame, panel: DataFrame, k: int) -> DataFrame:
    """(sequence, n, other, m): pairs of a query and a panel member (sequence, n: its length) that share a segment; among them are all of
    at most k edits. Queries are long enough that whatever lies in reach has segments of SEGMENT residues or more."""
    pieces = F.sequence(F.lit(0), F.lit(k))
    begin = lambda j, n: F.floor(j * n / (k + 1)).cast("int")
    cut = lambda s, j, n, move: F.substr(s, begin(j, n) + 1 + move, begin(j + 1, n) - begin(j, n))
    index = panel.select(F.col("sequence").alias("other"), F.col("n").alias("m"), F.explode(pieces).alias("j")).where(F.col("m") >= SEGMENT * (k + 1))
    index = index.withColumn("piece", cut(F.col("other"), F.col("j"), F.col("m"), F.lit(0)))
    # A query asks for each length in reach, each segment and each move.
    asked = queries.select("sequence", "n", F.explode(F.sequence(F.col("n") - k, F.col("n") + k)).alias("m")).where(F.col("m") >= SEGMENT * (k + 1))
    asked = asked.select("*", F.explode(pieces).alias("j")).select("*", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("move"))
    inside = (begin(F.col("j"), F.col("m")) + F.col("move") >= 0) & (begin(F.col("j") + 1, F.col("m")) + F.col("move") <= F.col("n"))
    asked = asked.where(inside).withColumn("piece", cut(F.col("sequence"), F.col("j"), F.col("m"), F.col("move"))).select("sequence", "n", "m", "j", "piece").distinct()
    return asked.join(index, ["m", "j", "piece"]).where("sequence <> other").select("sequence", "n", "other", "m").distinct()


def nearest(sequences: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(sequence, distance) of each distinct sequence that another one lies within reach of: edits over the longer one's length, to the
    nearest other sequence.

    A neighbour of k edits is the nearest if its distance is not over (k + 1) / (n + k + 1), the least that k + 1 edits can give.
    Sequences without a neighbour that near are compared with all whose lengths allow a distance below the best known: quadratic in
    them, in blocks of lengths.
    """
    panel = stage(sequences.select("sequence").distinct().withColumn("n", F.length("sequence")), "panel")
    left, done = panel.withColumn("bound", F.lit(1.0)), []
    for k in RADII:
        able = F.col("n") - k >= SEGMENT * (k + 1)
        found = candidates(left.where(able), panel, k).withColumn("edits", F.levenshtein("sequence", "other", k)).where("edits >= 0")
        best = found.groupBy("sequence").agg(F.min(_gap(F.col("edits"))).alias("best"))
        left = stage(left.join(best, "sequence", "left").withColumn("bound", F.least("bound", F.coalesce("best", F.lit(1.0)))).drop("best"), "bounds")
        sure = able & (F.col("bound") <= (k + 1) / (F.col("n") + k + 1))
        done.append(left.where(sure).select("sequence", F.col("bound").alias("distance")))
        left = left.where(~sure)
    other = panel.select(F.col("sequence").alias("other"), F.col("n").alias("m"))
    # What begins alike gives the rest a first bound.
    alike = left.join(other, F.substring("sequence", 1, 3) == F.substring("other", 1, 3)).where("sequence <> other")
    first = alike.groupBy("sequence").agg(F.min(_gap(F.levenshtein("sequence", "other"))).alias("first"))
    left = stage(left.join(first, "sequence", "left").withColumn("bound", F.least("bound", F.coalesce("first", F.lit(1.0)))).drop("first"), "bounds")
    # |n - m| / max(n, m) <= bound: a text of another length differs by as many edits at least. Lengths are few by definition.
    lengths = F.broadcast(panel.select(F.col("n").alias("m")).distinct())
    reach = left.join(lengths, F.abs(F.col("n") - F.col("m")) <= F.col("bound") * F.greatest("n", "m") + 1e-9)
    rest = reach.join(other, "m").where("sequence <> other").groupBy("sequence").agg(F.min(_gap(F.levenshtein("sequence", "other"))).alias("distance"))
    for part in done:
        rest = rest.unionByName(part)
    return rest

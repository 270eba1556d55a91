"""Pareto layers: 1 for vectors that none dominates, then what only those dominate, to the last one; and counts of dominators.

A vector's layer is 1 + the deepest layer of those that dominate it. Layers are counted within runs. A run of up to RUN_VECTORS rows is
layered by one task, rows passing through it once (where they lie, if they lie together). Larger runs are cut into blocks of an order in which a vector stands behind all
that dominate it; a block is compared with each earlier one by tasks of their own and then chained in itself, so the number of jobs
follows the number of blocks and not that of layers, and all large runs advance together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import in_order

Stage = Callable[[DataFrame, str], DataFrame]
#: Rows of a run that one task layers at once, and vectors of a block of a larger run.
RUN_VECTORS = 20_000
#: Vectors that are compared with all before them at once.
DENSE = 256
#: Vectors of a range in which dominators are counted.
RANGE = 50_000


def _falling(vectors: np.ndarray) -> np.ndarray:
    """An order in which a vector stands behind all that dominate it: by falling sum, and by falling entries where sums are equal but
    for rounding."""
    return np.lexsort((*(-vectors.T[::-1]), -np.round(vectors.sum(axis=1), 9)))


def _plane(v: np.ndarray) -> np.ndarray:
    """Layers of distinct vectors of two entries: by falling entries, the longest chain that never rises in the second ends at each."""
    order = np.lexsort((-v[:, 1], -v[:, 0]))
    # Of each layer the highest second entry so far, negated: a vector stands behind the last layer that reaches its own.
    tops: list[float] = []
    out = np.zeros(len(v), np.int32)
    for i, y in zip(order.tolist(), (-v[order, 1]).tolist()):
        k = bisect_right(tops, y)
        tops[k : k + 1] = [y]
        out[i] = k + 1
    return out


def _over(ranks: np.ndarray) -> np.ndarray:
    """Of each vector, in the order of falling sums of ranks, who dominates it: a bit for each vector, in words. Whoever dominates has
    the greater sum."""
    n, total = len(ranks), ranks.sum(axis=1, dtype=np.int64)
    bits, each = np.zeros((n, -(-n // 64) * 8), np.uint8), np.ascontiguousarray(ranks.T)
    for at in range(0, n, DENSE):
        some, before = slice(at, at + DENSE), slice(0, min(n, at + DENSE))
        over = total[None, before] > total[some, None]
        for r in each:
            over &= r[None, before] >= r[some, None]
        packed = np.packbits(over, axis=1)
        bits[some, : packed.shape[1]] = packed
    return bits.view(np.uint64)


def _peeled(over: np.ndarray) -> np.ndarray:
    """Layers by peeling fronts: those that none of the rest dominates."""
    out, left, layer = np.zeros(len(over), np.int32), np.arange(len(over)), 0
    rest = np.ones(over.shape[1] * 64, bool)
    while len(left):
        layer += 1
        kept = np.bitwise_or.reduce(over & np.packbits(rest).view(np.uint64), axis=1) != 0
        out[left[~kept]] = layer
        rest[left[~kept]] = False
        over, left = over[kept], left[kept]
    return out


def layers_of(vectors: np.ndarray) -> np.ndarray:
    """Layers of vectors (higher is better); equal ones share theirs."""
    if not len(vectors):
        return np.zeros(0, np.int32)
    if vectors.shape[1] == 2:
        v, back = np.unique(vectors, axis=0, return_inverse=True)
        return _plane(v)[back.reshape(-1)]
    # Places among the distinct values of each entry are compared instead of values: exact, and small.
    ranks = np.column_stack([np.unique(c, return_inverse=True)[1].reshape(-1) for c in vectors.T]).astype(np.int16 if len(vectors) < 1 << 15 else np.int32)
    order = np.argsort(-ranks.sum(axis=1, dtype=np.int64), kind="stable")
    layers = np.empty(len(vectors), np.int32)
    layers[order] = _peeled(_over(ranks[order]))
    return layers


def chained(vectors: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Layers of distinct vectors where each has `base` layers above it outside."""
    order = _falling(vectors)
    v, out = vectors[order], base[order].astype(np.int32) + 1
    for i in range(1, len(v)):
        over = (v[:i] >= v[i]).all(axis=1)
        if over.any():
            out[i] = max(out[i], out[:i][over].max() + 1)
    layers = np.empty_like(out)
    layers[order] = out
    return layers


def deepest_over(mine: np.ndarray, others: np.ndarray, layers: np.ndarray) -> np.ndarray:
    """For each of mine the deepest layer among the others that are at least as great everywhere (0: none)."""
    order = np.argsort(-layers, kind="stable")
    out, left = np.zeros(len(mine), np.int64), np.arange(len(mine))
    for k in range(0, len(order), 512):
        some = order[k : k + 512]
        over = (others[some][None, :, :] >= mine[left][:, None, :]).all(axis=2)
        hit = over.any(axis=1)
        out[left[hit]] = layers[some][over[hit].argmax(axis=1)]
        left = left[~hit]
        if not len(left):
            break
    return out


def _named(df: DataFrame, scores: list[str], by: str | None) -> tuple[DataFrame, list[str]]:
    """df with _run and the scores that are compared, and their names."""
    names = [f"_s{k}" for k in range(len(scores))]
    full = df.withColumns({n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in zip(names, scores, strict=True)})
    return full.withColumn("_run", F.lit(0).cast("long") if by is None else F.col(by).cast("long")), names


def layers_in_place(df: DataFrame, scores: list[str], stage: Stage, by: str) -> DataFrame:
    """pareto_layers of rows that mostly lie by run already: each piece of a run (rows that follow each other in a partition) is layered
    where it lies and nothing is shuffled; runs in more than one piece or of more than RUN_VECTORS rows are then layered by
    pareto_layers. df is read once; what comes back is written."""
    full, names = _named(df, scores, by)
    schema = T.StructType([*df.schema.fields, T.StructField("_run", T.LongType()), T.StructField("layer", T.IntegerType()), T.StructField("_piece", T.LongType())])
    laid = stage(full.mapInArrow(_pieces(names, schema.names), schema), "laid")
    per = laid.groupBy(F.col("_run").alias("_again")).agg(F.min("_piece").alias("a"), F.max("_piece").alias("b"), F.max(F.col("layer").isNull()).alias("c"))
    again = stage(per.where("a <> b or c").select("_again"), "runs-again")
    if again.isEmpty():
        return laid.select(*df.columns, "layer")
    same = F.col("_run").eqNullSafe(F.col("_again"))
    rest = pareto_layers(laid.join(again, same, "left_semi").select(*df.columns), scores, stage, by)
    return laid.join(again, same, "left_anti").select(*df.columns, "layer").unionByName(rest)


def _pieces(names: list[str], out: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = TaskContext.get().partitionId() << 33, None

        def layered(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal piece
            vectors = np.column_stack([t.column(n).to_numpy() for n in names])
            layers, gone = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), bool)
            for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if last - first > RUN_VECTORS:
                    gone[first:last] = True
                else:
                    layers[first:last] = layers_of(vectors[first:last])
            pieces = piece + np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            piece += len(edges) - 1
            done = t.append_column("layer", pa.array(layers, pa.int32(), mask=gone)).append_column("_piece", pa.array(pieces, pa.int64()))
            yield from done.select(out).combine_chunks().to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            column = t.column("_run")
            # Null is a run too.
            key, none = column.fill_null(0).to_numpy(), column.is_null().to_numpy()
            starts = np.concatenate(([0], 1 + np.flatnonzero((key[1:] != key[:-1]) | (none[1:] != none[:-1]))))
            # The last run may go on in the next batch, unless it is too large for one task anyway.
            end = t.num_rows if t.num_rows - starts[-1] > RUN_VECTORS else starts[-1]
            if end:
                yield from layered(t.slice(0, end), np.append(starts[starts < end], end))
            held = t.slice(end) if end < t.num_rows else None
        if held is not None:
            yield from layered(held, np.array([0, held.num_rows]))

    return run


def pareto_layers(df: DataFrame, scores: list[str], stage: Stage, by: str | None = None) -> DataFrame:
    """df with layer, within each value of `by` (all rows without it). A missing score counts as 0. Equal vectors share a layer. df is
    read once to count runs and once to layer them. stage(df, name) writes a table to shared storage and reads it back."""
    full, names = _named(df, scores, by)
    large = full.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RUN_VECTORS).select(F.col("_run").alias("_large"))
    large = stage(large, "large-runs")
    schema = T.StructType([*full.schema.fields, T.StructField("layer", T.IntegerType())])
    same = F.col("_run").eqNullSafe(F.col("_large"))
    none = large.isEmpty()
    small = full if none else full.join(large, same, "left_anti")
    out = small.groupBy("_run").applyInArrow(_layered(names), schema)
    if not none:
        rest = full.join(large, same, "left_semi")
        found = _in_blocks(stage(rest.select("_run", *names).distinct(), "vectors"), names, stage)
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"f{c}")) for c in ("_run", *names)))
        found = found.select(*(F.col(c).alias(f"f{c}") for c in ("_run", *names)), "layer")
        out = out.unionByName(rest.join(found, on).drop(*(f"f{c}" for c in ("_run", *names))))
    return out.drop("_run", *names)


def _layered(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        vectors = np.column_stack([t.column(n).to_numpy() for n in names])
        return t.append_column("layer", pa.array(layers_of(vectors), pa.int32()))

    return run


def _in_blocks(vectors: DataFrame, names: list[str], stage: Stage) -> DataFrame:
    """Distinct vectors of some runs (_run, names) with their layers."""
    total = F.round(reduce(lambda a, b: a + b, map(F.col, names)), 9)
    order = [F.col("_run"), F.desc("_sum"), *map(F.desc, names)]
    placed = in_order(vectors.withColumn("_sum", total), order, stage, written=False).drop("_sum")
    first = placed.groupBy(F.col("_run").alias("_r")).agg(F.min("_before").alias("_first"))
    placed = placed.join(first, F.col("_run").eqNullSafe(F.col("_r"))).select("_run", *names, F.col("_before").alias("_at"), F.floor((F.col("_before") - F.col("_first")) / RUN_VECTORS).cast("int").alias("_b"))
    placed = stage(placed, "blocks")

    def above(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_at": one["_at"], "_base": deepest_over(one[names].to_numpy(), two[names].to_numpy(), two["layer"].to_numpy())})

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        return f.assign(layer=chained(f[names].to_numpy(), f["_base"].to_numpy())).drop(columns="_base")

    schema = "_run long, " + ", ".join(f"{n} double" for n in names) + ", _at long, _b int, layer int"
    done = None
    for block in range((placed.agg(F.max("_b")).first()[0] or 0) + 1):
        mine = placed.where(F.col("_b") == block)
        base = mine.withColumn("_base", F.lit(0).cast("long"))
        if done is not None:
            each = mine.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
            found = each.groupBy("_run", "_o").cogroup(done.groupBy("_run", "_b")).applyInPandas(above, "_at long, _base long")
            base = mine.join(found.groupBy("_at").agg(F.max("_base").alias("_base")), "_at").select(*mine.columns, "_base")
        layer = stage(base.groupBy("_run").applyInPandas(chain, schema), "layers")
        done = layer if done is None else done.unionByName(layer)
    return done.select("_run", *names, "layer")


def heavier(first: np.ndarray, second: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row the weight of all rows with a smaller `first` and a smaller `second` (ranks; `first` may repeat, `second` doesn't).

    By halves of the first ranks, at each level of their bits: what the lower half holds before a row of the upper half, in the order
    of the second."""
    out = np.zeros(len(first), np.int64)
    for bit in range(int(first.max()).bit_length() if len(first) else 0):
        group, upper = first >> (bit + 1), (first >> bit) & 1
        order = np.lexsort((second, group))
        lower = np.where(upper[order] == 0, weights[order], 0)
        sums = np.concatenate([[0], np.cumsum(lower)])
        edge = np.searchsorted(group[order], group[order])
        found = sums[:-1] - sums[edge]
        out[order] += np.where(upper[order] == 1, found, 0)
    return out


def dominators(df: DataFrame, one: str, two: str, stage: Stage) -> DataFrame:
    """df with dominated_by: how many rows are at least as great in both columns and greater in one.

    Distinct vectors get a rank by falling (one, two) and one by falling (two, one); whoever dominates stands before in both, and
    nobody else does. Ranks are cut into ranges of RANGE: what lies in earlier ranges of both is counted by prefix sums over the grid of
    ranges, what shares a range by halving inside it, so ties make no range larger and no pairs are compared.
    """
    vectors = stage(df.groupBy(one, two).agg(F.count(F.lit(1)).alias("_n")), "vectors")
    put = in_order(vectors, [F.desc(one), F.desc(two)], stage, written=True).withColumnRenamed("_before", "_i")
    put = in_order(put, [F.desc(two), F.desc(one)], stage).withColumnRenamed("_before", "_j")
    put = stage(put.withColumns({"_p": F.floor(F.col("_i") / RANGE), "_q": F.floor(F.col("_j") / RANGE)}), "placed")
    # Ranges times ranges.
    grid = put.select("_p").distinct().crossJoin(F.broadcast(put.select("_q").distinct())).join(put.groupBy("_p", "_q").agg(F.sum("_n").alias("_n")), ["_p", "_q"], "left")
    before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    corner = grid.withColumn("_row", before("_n", "_p", "_q")).withColumn("_corner", before("_row", "_q", "_p")).select("_p", "_q", "_corner")

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        i = f["_i"].to_numpy()
        return pd.DataFrame({"_i": i, "_k": heavier(i - i.min(), f["_j"].to_numpy(), f["_n"].to_numpy())})

    def beside(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_i": f["_i"], "_k": heavier(f["_p"].to_numpy(), f["_j"].to_numpy(), f["_n"].to_numpy())})

    parts = put.groupBy("_p").applyInPandas(inside, "_i long, _k long").unionByName(put.groupBy("_q").applyInPandas(beside, "_i long, _k long"))
    parts = parts.unionByName(put.join(corner, ["_p", "_q"]).select("_i", F.col("_corner").alias("_k")))
    counts = put.select(one, two, "_i").join(parts.groupBy("_i").agg(F.sum("_k").alias("dominated_by")), "_i").drop("_i")
    return df.join(counts, [one, two])

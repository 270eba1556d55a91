"""Synthesis assessment: what makes a sequence hard to make, step by step, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions.descriptors import SEQ, count_of

STEP_YIELD, ARGININE, RUN_EACH, MOTIF, OXIDATION = 0.99, 0.03, 0.04, 0.05, 0.01
#: Non-standard blocks and their cost; none is routinely available.
BLOCKS = [("d_amino_acid", 1.5), ("lipid_tail", 2.0), ("peg_chain", 1.6), ("cyclic", 1.8)]


def _found(sequences: pa.Array) -> pa.Array:
    """Of a batch: each sequence's drivers by position, how many are isomer motifs, and the crude purity."""
    r = B.Residues(sequences)
    is_in = lambda letters: np.isin(r.letters, [ord(a) for a in letters])
    branched = is_in("VIT")
    first = branched & ~(np.concatenate(([False], branched[:-1])) & (r.place > 0))
    begin = np.flatnonzero(first)
    # Branched residues belong to the last run that began.
    run = np.bincount(np.cumsum(first)[branched] - 1, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    long = run >= 3
    pair = r.pairs(1)
    motif = pair[np.isin(r.letters[pair], [ord("D"), ord("N")]) & (r.letters[pair + 1] == ord("G"))]
    arginine, oxidised = np.flatnonzero(is_in("R")), np.flatnonzero(is_in("MW"))
    parts = [(arginine, 1, ARGININE), (begin[long], run[long], run[long] * RUN_EACH), (motif, 2, MOTIF), (oxidised, 1, OXIDATION)]
    at, size, loss = (np.concatenate(x) for x in zip(*((a, np.broadcast_to(n, a.shape), np.broadcast_to(p, a.shape)) for a, n, p in parts), strict=True))
    # No two drivers begin at one residue.
    order = np.argsort(at)
    at, size, loss = at[order], size[order].astype(np.int64), loss[order].astype(float)
    ends = np.cumsum(size)
    text = r.letters[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    motifs = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(text.tobytes()))
    each = pa.StructArray.from_arrays([pa.array(r.place[at], pa.int32()), motifs, pa.array(loss)], ["position", "motif", "penalty"])
    keep = np.full(len(r.codes), STEP_YIELD)
    keep[at] = STEP_YIELD - loss
    keep = np.maximum(keep, 0.0)
    keep[r.at[1:][r.n > 0] - 1] = 1.0
    purity = np.ones(len(r.n))
    some = r.n > 0
    if some.any():
        purity[some] = np.multiply.reduceat(keep, r.at[:-1][some])
    return B.columns(
        r.null, drivers=B.lists(each, np.bincount(r.row[at], minlength=len(r.n))), n_drivers=np.bincount(r.row[at], minlength=len(r.n)).astype(np.int32),
        n_isomers=np.bincount(r.row[motif], minlength=len(r.n)).astype(np.int32), crude_purity=purity,
    )


def found() -> Column:
    """drivers: array<struct<position, motif, penalty>>, sorted: arginines, runs of three or more V/I/T, DG and NG, methionines and
    tryptophans; n_drivers, n_isomers (DG and NG); crude_purity: the product over the couplings of the step yield less the penalties at
    that position, 0 at least. Computed for whole batches."""
    what = "drivers array<struct<position int, motif string, penalty double>>, n_drivers int, n_isomers int, crude_purity double"
    return F.arrow_udf(_found, what).asNondeterministic()(SEQ)


def with_drivers(df: DataFrame) -> DataFrame:
    """df (sequence) with drivers."""
    return df.withColumn("_found", found()).select(*df.columns, F.col("_found.drivers").alias("drivers"))


def _band(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "medium").when(score < 120, "high").otherwise("very_high")


def assessed(df: DataFrame) -> DataFrame:
    """df (sequence, and a boolean for each of BLOCKS) with drivers, crude_purity, n_steps, difficulty, cost bands, purity_ceiling."""
    pairs = F.floor(count_of("C") / 2)
    blocks = sum((F.col(n).cast("int") for n, _ in BLOCKS), F.lit(0))
    cost = F.lit(1.0)
    for n, c in BLOCKS:
        cost = cost * F.when(F.col(n), c).otherwise(1.0)
    out = df.withColumn("_found", found()).withColumns({c: F.col(f"_found.{c}") for c in ("drivers", "n_drivers", "n_isomers", "crude_purity")}).drop("_found")
    out = out.withColumns({"pairs": pairs, "blocks": blocks, "cost": cost})
    folding = F.when(F.col("pairs") >= 3, 3).when(F.col("pairs") >= 2, 1).otherwise(0)
    score = F.col("n_drivers") + folding + 2 * F.col("blocks")
    steps = F.greatest(F.length(SEQ) - 1, F.lit(0)) + 2 * F.col("pairs") + F.when(F.col("cyclic"), 3).otherwise(0) + F.col("blocks")
    out = out.withColumns({"difficulty": F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low"), "n_steps": steps.cast("long")})
    small = F.col("n_steps") * F.col("cost") * F.when(F.col("difficulty") == "high", 2.0).when(F.col("difficulty") == "medium", 1.4).otherwise(1.0)
    large = F.col("n_steps") * F.col("cost") * F.when(F.col("pairs") >= 3, 2.5).when(F.col("pairs") >= 2, 1.5).otherwise(1.0) * (1 + 0.5 * F.col("blocks"))
    recovery = 0.95 - F.greatest(F.col("pairs") - 1, F.lit(0)) * 0.05 - F.col("n_isomers") * 0.08 - F.col("blocks") * 0.05
    return out.withColumns({"cost_100mg": _band(F.round(small, 9)), "cost_10g": _band(F.round(large, 9)), "purity_ceiling": F.col("crude_purity") * F.greatest(recovery, F.lit(0.0))}).drop("n_drivers", "n_isomers")

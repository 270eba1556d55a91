"""Sequence descriptors as column expressions: composition sums over residue counts, positional sums over residue arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from . import scales as S

SEQ = "sequence"


def count_of(letters: str, seq: Column | str = SEQ) -> Column:
    """How many of the letters the sequence holds. Letter by letter: what several sums share is counted once a row."""
    whole = F.length(seq)
    return reduce(lambda a, b: a + b, (whole - F.length(F.replace(seq, F.lit(a), F.lit(""))) for a in letters))


#: Residues are looked up by their code (A is 1) in literal arrays, so a lookup costs the same for any table.
_CODES = 27


def codes(seq: Column | str = SEQ) -> Column:
    """Each residue's code, in order."""
    return F.transform(letters(seq), lambda a: F.ascii(a) - 64)


def table_of(scale: Mapping[str, float], default: float | None = None) -> Column:
    """A literal array of the scale by code."""
    return F.array(*(F.lit(scale.get(chr(64 + k), default)).cast("double") for k in range(_CODES)))


def composition_sum(scale: Mapping[str, float], seq: Column | str = SEQ) -> Column:
    """Sum of a scale over the residues, from the residue counts."""
    return sum((count_of(a, seq) * F.lit(float(v)) for a, v in scale.items()), F.lit(0.0))


def mean_of(scale: Mapping[str, float], seq: Column | str = SEQ) -> Column:
    return composition_sum(scale, seq) / F.length(seq)


def letters(seq: Column | str = SEQ) -> Column:
    return F.split(seq, "")


def profile(scale: Mapping[str, float], seq: Column | str = SEQ) -> Column:
    """The scale's value of each residue, in order."""
    table = table_of(scale)
    return F.transform(codes(seq), lambda k: F.get(table, k))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length() -> Column:
    return F.length(SEQ)


def molecular_weight(acetyl: Column | None = None, amide: Column | None = None, lipid: Column | None = None) -> Column:
    """Average mass; acetylated and amidated ends and a lipid tail's mass shift it."""
    mass = composition_sum(S.MASS) - (F.length(SEQ) - 1) * F.lit(S.WATER)
    mass = mass if acetyl is None else mass + F.when(acetyl, S.ACETYL).otherwise(0.0)
    mass = mass if amide is None else mass + F.when(amide, S.AMIDE).otherwise(0.0)
    return mass if lipid is None else mass + F.coalesce(lipid, F.lit(0.0))


def _pk(end: Column, table: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for a, v in table.items():
        out = F.when(end == a, F.lit(v)).otherwise(out)
    return out


def net_charge(ph: float | Column = 7.4, acetyl: Column | None = None, amide: Column | None = None, blocked_lysines: Column | None = None) -> Column:
    """Henderson-Hasselbalch charge; a blocked terminus or an acylated lysine has none."""
    ph = F.lit(float(ph)) if isinstance(ph, (int, float)) else ph
    plus = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
    minus = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
    out = F.lit(0.0)
    for a, pk in S.PK_POSITIVE.items():
        n = count_of(a) - (F.coalesce(blocked_lysines, F.lit(0)) if a == "K" and blocked_lysines is not None else 0)
        out = out + n * plus(F.lit(pk))
    for a, pk in S.PK_NEGATIVE.items():
        out = out - count_of(a) * minus(F.lit(pk))
    first = plus(_pk(F.substring(SEQ, 1, 1), S.PK_N_TERM_OF, S.PK_N_TERM))
    last = minus(_pk(F.expr(f"right({SEQ}, 1)"), S.PK_C_TERM_OF, S.PK_C_TERM))
    out = out + (first if acetyl is None else F.when(acetyl, 0.0).otherwise(first))
    return out - (last if amide is None else F.when(amide, 0.0).otherwise(last))


def hydrophobicity() -> Column:
    return mean_of(S.EISENBERG)


def hydrophobic_fraction() -> Column:
    return count_of("".join(a for a, v in S.EISENBERG.items() if v > 0)) / F.length(SEQ)


def moment(scale: Mapping[str, float] = S.EISENBERG, degrees: float = 100.0, size: Column | None = None) -> Column:
    """Hydrophobic moment of the whole sequence, for a helix of `degrees` a residue, over its length.

    One pass over the residues; the sines and cosines of a whole number of turns stand in literal arrays (100 degrees come back
    after 18 residues), other angles are computed.
    """
    table, size = table_of(scale), F.length(SEQ) if size is None else size
    period = next((k for k in range(1, 361) if (k * degrees) % 360 == 0), None)
    if period:
        sines, cosines = (F.array(*(F.lit(f(math.radians(degrees * k))) for k in range(period))) for f in (math.sin, math.cos))
        turn = lambda i: (F.get(sines, i % period), F.get(cosines, i % period))
    else:
        turn = lambda i: (F.sin(F.radians(i * F.lit(degrees))), F.cos(F.radians(i * F.lit(degrees))))
    parts = F.transform(codes(), lambda k, i: F.struct(*((F.get(table, k) * t).alias(n) for n, t in zip("sc", turn(i), strict=True))))
    both = F.aggregate(
        parts,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")),
        lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["c"] + x["c"]).alias("c")),
        lambda a: F.sqrt(a["s"] * a["s"] + a["c"] * a["c"]),
    )
    return both / size


def amphipathicity(whole_moment: Column | None = None) -> Column:
    """Moment over the mean absolute hydrophobicity, between 0 and 1."""
    size = composition_sum({a: abs(v) for a, v in S.EISENBERG.items()}) / F.length(SEQ)
    ratio = (moment() if whole_moment is None else whole_moment) / size
    return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).otherwise(0.0)


def pairs(gap: int = 0) -> Column:
    """Residue pairs with `gap` residues between."""
    n = F.length(SEQ) - 1 - gap
    cut = lambda i: F.concat(F.substr(F.col(SEQ), i, F.lit(1)), F.substr(F.col(SEQ), i + 1 + gap, F.lit(1)))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), cut)).otherwise(F.array().cast("array<string>"))


def instability() -> Column:
    """Guruprasad's index: 10 / length times the sum of dipeptide weights; 0 under two residues."""
    pair = [(chr(64 + a), chr(64 + b)) for a in range(_CODES) for b in range(_CODES)]
    table = F.array(*(F.lit(float(S.DIWV.get(a + b, S.DIWV_DEFAULT))) for a, b in pair))
    each = codes()
    weights = F.zip_with(each, F.slice(each, F.lit(2), F.greatest(F.size(each) - 1, F.lit(0))), lambda a, b: F.get(table, a * _CODES + b))
    # The last residue has no partner: its null weight counts nothing.
    sum_ = F.aggregate(weights, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(F.length(SEQ) < 2, 0.0).otherwise(sum_ * 10.0 / F.length(SEQ))


def motif_positions(motifs: tuple[str, ...]) -> Column:
    """Positions (from 0) where one of the motifs (of one length) starts, overlapping ones too."""
    k = len(motifs[0])
    n = F.length(SEQ) - k
    at = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(F.col(SEQ), i + 1, F.lit(k)).isin(*motifs))
    return F.when(n >= 0, at).otherwise(F.array().cast("array<int>"))


def risk_category(count: Column, low_max: int = 0, medium_max: int = 2) -> Column:
    return F.when(count <= low_max, "low").when(count <= medium_max, "medium").otherwise("high")


def disulfide_category() -> Column:
    """By the number of cysteines: none, flag (odd), low (two), medium (four), high (more)."""
    n = count_of("C")
    return F.when(n == 0, "none").when(n % 2 == 1, "flag").when(n == 2, "low").when(n == 4, "medium").otherwise("high")


def window_max(scale: Mapping[str, float] = S.KYTE_DOOLITTLE, width: int = 5, seq: Column | str = SEQ) -> Column:
    """Highest mean over windows of `width` residues; of the whole sequence if it is shorter."""

    def most(sequences: pa.Array) -> pa.Array:
        r = B.Residues(sequences)
        value = B.scale(scale, np.nan)[r.codes]
        at = r.pairs(width - 1)
        mean = sum((value[at + k] for k in range(width)), np.zeros(len(at))) / width
        out = np.full(len(r.n), -np.inf)
        np.maximum.at(out, r.row[at], mean)
        with np.errstate(divide="ignore", invalid="ignore"):
            return B.columns(r.null, m=np.where(r.n < width, r.add(np.nan_to_num(value)) / r.n, out)).field(0)

    return F.arrow_udf(most, "double").asNondeterministic()(seq)


@F.pandas_udf(T.DoubleType())
def _zero_charge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    plus, minus = np.array(list(S.PK_POSITIVE.values())), np.array(list(S.PK_NEGATIVE.values()))
    for *counts, first, last in batches:
        n = np.stack(counts, axis=1).astype(float)
        low, high = np.zeros(len(n)), np.full(len(n), 14.0)
        for _ in range(60):
            ph = ((low + high) / 2)[:, None]
            charge = (n[:, :3] / (1 + 10 ** (ph - plus))).sum(axis=1) - (n[:, 3:] / (1 + 10 ** (minus - ph))).sum(axis=1)
            charge += 1 / (1 + 10 ** (ph[:, 0] - first.to_numpy())) - 1 / (1 + 10 ** (last.to_numpy() - ph[:, 0]))
            low, high = np.where(charge > 0, ph[:, 0], low), np.where(charge > 0, high, ph[:, 0])
        yield pd.Series((low + high) / 2)


def isoelectric_point() -> Column:
    """pH without net charge, by bisection of whole batches of residue counts."""
    ends = _pk(F.substring(SEQ, 1, 1), S.PK_N_TERM_OF, S.PK_N_TERM), _pk(F.expr(f"right({SEQ}, 1)"), S.PK_C_TERM_OF, S.PK_C_TERM)
    return _zero_charge(*(count_of(a) for a in (*S.PK_POSITIVE, *S.PK_NEGATIVE)), *ends)


def bound(df: DataFrame) -> DataFrame:
    """df with its columns computed once: conditions on them are not moved below, where each use would compute them again."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


_CHEM = {
    "length": "int", "molecular_weight": "double", "net_charge": "double", "hydrophobicity": "double", "hydrophobic_moment": "double",
    "amphipathicity": "double", "instability_index": "double", "n_oxidation": "int", "n_deamidation": "int", "disulfide_category": "string",
}


def moments(r: B.Residues, scale: Mapping[str, float], period: int = 18) -> np.ndarray:
    """`moment` for 100 degrees a residue, of a batch."""
    turn, value = r.place % period, B.scale(scale, np.nan)[r.codes]
    sines, cosines = (np.array([f(math.radians(100.0 * k)) for k in range(period)]) for f in (math.sin, math.cos))
    return np.sqrt(r.add(value * sines[turn]) ** 2 + r.add(value * cosines[turn]) ** 2) / r.n


def chem_of(sequences: pa.Array, ph: float, names: tuple[str, ...]) -> pa.StructArray:
    """The named descriptors of a batch; doubles to nine decimals."""
    r = B.Residues(sequences)
    counts, out = r.counts(), {}
    count = lambda letters: counts[:, [ord(a) - 64 for a in letters]].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if "molecular_weight" in names:
            out["molecular_weight"] = counts @ B.scale(S.MASS) - (r.n - 1) * S.WATER
        if "net_charge" in names:
            plus, minus = (lambda pk: 1 / (1 + 10.0 ** (ph - pk))), (lambda pk: 1 / (1 + 10.0 ** (pk - ph)))
            ends = [np.where(r.n > 0, np.append(r.codes, 0)[np.minimum(at, len(r.codes))], 0) for at in (r.at[:-1], np.maximum(r.at[1:] - 1, 0))]
            charge = counts @ B.scale({a: plus(pk) for a, pk in S.PK_POSITIVE.items()}) - counts @ B.scale({a: minus(pk) for a, pk in S.PK_NEGATIVE.items()})
            out["net_charge"] = charge + plus(B.scale(S.PK_N_TERM_OF, S.PK_N_TERM))[ends[0]] - minus(B.scale(S.PK_C_TERM_OF, S.PK_C_TERM))[ends[1]]
        if "hydrophobicity" in names:
            out["hydrophobicity"] = counts @ B.scale(S.EISENBERG) / r.n
        if {"hydrophobic_moment", "amphipathicity"} & set(names):
            out["hydrophobic_moment"] = moments(r, S.EISENBERG)
            size = counts @ B.scale({a: abs(v) for a, v in S.EISENBERG.items()}) / r.n
            out["amphipathicity"] = np.where(size > 0, np.clip(out["hydrophobic_moment"] / size, 0.0, 1.0), 0.0)
        if "instability_index" in names:
            table = np.array([[S.DIWV.get(chr(64 + a) + chr(64 + b), S.DIWV_DEFAULT) for b in range(_CODES)] for a in range(_CODES)], float)
            at = r.pairs(1)
            out["instability_index"] = np.where(r.n < 2, 0.0, r.add_at(at, table[r.codes[at], r.codes[at + 1]]) * 10.0 / r.n)
        out = {n: B.decimals(x, 9) for n, x in out.items()}
        if "n_deamidation" in names:
            at = r.pairs(1)
            at = at[(r.letters[at] == ord("N")) & np.isin(r.letters[at + 1], [ord("G"), ord("S")])]
            out["n_deamidation"] = np.bincount(r.row[at], minlength=len(r.n)).astype(np.int32)
    out |= {"length": r.n.astype(np.int32), "n_oxidation": count("MCW").astype(np.int32)}
    if "disulfide_category" in names:
        n = count("C")
        kind = np.select([n == 0, n % 2 == 1, n == 2, n == 4], [0, 1, 2, 3], 4)
        out["disulfide_category"] = pa.DictionaryArray.from_arrays(pa.array(kind, pa.int32(), mask=r.null), ["none", "flag", "low", "medium", "high"]).cast(pa.string())
    return B.columns(r.null, **{n: out[n] for n in names})


def physchem(df: DataFrame, ph: float = 7.4, only: tuple[str, ...] | None = None) -> DataFrame:
    """df (with sequence) and length, molecular_weight, net_charge, hydrophobicity, hydrophobic_moment, amphipathicity,
    instability_index, n_oxidation, n_deamidation, disulfide_category (or those in `only`), each computed once a row. Doubles are
    rounded to nine decimals, so that a threshold judges a sum the same whatever the order of its terms. Computed for whole batches: a
    row's own loops over its residues run uncompiled in Spark's expressions."""
    names = tuple(only or _CHEM)
    # Nondeterministic to the optimizer: no condition on a descriptor is moved below, where all would be computed again.
    chem = F.arrow_udf(lambda seq: chem_of(seq, ph, names), ", ".join(f"{n} {_CHEM[n]}" for n in names)).asNondeterministic()
    return df.withColumn("_chem", chem(SEQ)).select(*df.columns, *(F.col(f"_chem.{n}").alias(n) for n in names))

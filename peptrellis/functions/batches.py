"""Residues of Arrow batches as flat numpy arrays: what the descriptors add up, for all sequences of a batch at once."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings side by side, and n + 1 places where they begin; a null has none."""
    data = strings.cast(pa.large_binary())
    if data.null_count:
        data = data.fill_null(b"")
    _, places, held = data.buffers()
    at = np.frombuffer(places, np.int64, len(data) + 1 + data.offset)[data.offset :] if len(data) else np.zeros(1, np.int64)
    each = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return each[at[0] : at[-1]], at - at[0]


def decimals(x: np.ndarray, places: int) -> np.ndarray:
    """x to so many decimals, halves away from zero, and no negative zero."""
    ten = 10.0**places
    return np.copysign(np.floor(np.abs(x) * ten + 0.5), x) / ten + 0.0


class Residues:
    """A batch of sequences. Characters other than A to Z count as residues of code 0, which no scale knows."""

    def __init__(self, sequences: pa.Array):
        self.null = sequences.is_null().to_numpy(zero_copy_only=False)
        each, _ = flat(sequences)
        if len(each) and each.max() > 127:
            sequences = pc.replace_substring_regex(sequences, r"[^\x00-\x7F]", "?")
        self.letters, self.at = flat(sequences)
        self.n = np.diff(self.at)
        code = self.letters - np.uint8(64)
        self.codes = np.where(code < 27, code, 0).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.codes)) - self.at[self.row]

    def counts(self) -> np.ndarray:
        """How often each sequence holds each code."""
        return np.bincount(self.row * 27 + self.codes, minlength=27 * len(self.n)).reshape(-1, 27)

    def add(self, values: np.ndarray) -> np.ndarray:
        """Sums of each sequence's values (one a residue)."""
        if not len(values):
            return np.zeros(len(self.n))
        return np.where(self.n > 0, np.add.reduceat(np.append(values, 0.0), np.minimum(self.at[:-1], len(values))), 0.0)

    def pairs(self, lag: int) -> np.ndarray:
        """Places of residues that have another of their sequence `lag` further on."""
        return np.flatnonzero(self.place + lag < self.n[self.row])

    def add_at(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of each sequence's values at some places."""
        return np.bincount(self.row[places], weights=values, minlength=len(self.n))


def scale(table: Mapping[str, float], default: float = 0.0) -> np.ndarray:
    """A scale by code."""
    return np.array([table.get(chr(64 + k), default) for k in range(27)], float)


def columns(null: np.ndarray | None = None, **arrays: np.ndarray | pa.Array) -> pa.StructArray:
    """A struct of arrays; NaN and rows of `null` are null."""
    out = []
    for a in arrays.values():
        if isinstance(a, np.ndarray):
            gone = np.isnan(a) if a.dtype.kind == "f" else np.zeros(len(a), bool)
            a = pa.array(a, mask=gone if null is None else gone | null)
        out.append(a)
    return pa.StructArray.from_arrays(out, names=list(arrays))


def lists(values: np.ndarray, each: np.ndarray) -> pa.ListArray:
    """values cut into lists of so many elements each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))

"""What several operators share: the shared folder, staged tables, Arrow batches as flat byte arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes of text that one numpy step handles; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 19
#: Rows of whole documents that travel to a Python worker at once; bounds the Arrow buffers on both sides.
BATCH_ROWS = 1000


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_by_hash(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Up to `most` rows of df: those with the least hash of their keys (then by keys). A first cut by the hash, at half as many rows
    again as are wanted, keeps what tasks send to the final one small, however many tasks there are."""
    n = df.count()
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*keys), F.lit(1 << 32)))
    if n > 2 * most:
        hashed = hashed.where(F.col("_hash") < int((1 << 32) * 1.5 * most / n))
    return hashed.orderBy("_hash", *keys).limit(most).drop("_hash")


class FlatTexts:
    """UTF-8 texts of some rows end to end: data[offsets[i]:offsets[i+1]] is row i. A null text is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> FlatTexts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes b with inside[b], never across rows: starts, ends, and the first run of each row (n + 1)."""
        w = inside[self.data]
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        before, after = np.empty_like(w), np.empty_like(w)
        before[0], after[-1] = False, False
        before[1:], after[:-1] = w[:-1], w[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(w))]
        before[edges], after[edges - 1] = False, False
        starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def byte_set(chars: bytes, above: bool = False, invert: bool = False) -> np.ndarray:
    """A table over bytes: True for chars, and for all bytes of non-ASCII characters if above."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    if above:
        table[128:] = True
    return ~table if invert else table


#: Bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = byte_set(b" \t\n\x0b\x0c\r", invert=True)
#: Bytes of words made of letters (all non-ASCII characters count as letters).
LETTERS = byte_set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", above=True)
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a run from which on a digest takes the polynomial's place.
LONG_RUN = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """The first n powers. A worker keeps those that parts of usual size need; a longer text's are made for it and let go."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base))
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], alike wherever a run stands: polynomials of up to LONG_RUN bytes, digests of longer runs,
    since a polynomial modulo 2^64 gives some pairs of 1,024 bytes and more the same value."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(_BASE, n), out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    out = mix((sums[ends] - sums[starts]) * _table(inverse, n)[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_RUN):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that hash_runs gives for these words."""
    flat = FlatTexts.of(pa.array(words, pa.string()))
    return hash_runs(flat.data, flat.offsets[:-1], flat.offsets[1:])


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts have about `most` bytes; a longer single text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)


#: Keys of different rows that may be told apart by name.
TOLD_APART = 1000


def _first_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text")


def _second_key() -> Column:
    """64 bits of a digest of what _first_key hashes."""
    whole = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce(F.md5("text"), F.lit("")))
    half = lambda k: F.conv(F.substring(F.md5(whole), k, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def row_key(docs: DataFrame) -> Column:
    """A long for each row of docs (doc_id long, text), equal for rows of equal doc_id (or none) and text only: a hash, but rows whose
    hash other rows have too are keyed by a second one. 64 bits alone would give some of 10^10 rows the key of another."""
    both = docs.select(_first_key().alias("k"), _second_key().alias("s")).groupBy("k").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    shared = [r.k for r in both.where("low < high").select("k").limit(TOLD_APART + 1).collect()]
    if len(shared) > TOLD_APART:
        # Not by chance: the hash was aimed at.
        return _second_key()
    return F.when(_first_key().isin(shared), _second_key()).otherwise(_first_key()) if shared else _first_key()


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Send BATCH_ROWS rows at a time to Python, if the session allows more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch, FlatTexts], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over parts of bounded bytes; f gets the part and its texts."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = f(part, FlatTexts.of(part.column(column)))
                if out is not None and out.num_rows:
                    yield out
        # Workers live on: what Arrow holds for the next task goes back to the system.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered:
    """Values of strings in two generations: when the younger is full it becomes the older one, whose entries come back on use.

    Bounds a worker's memory, not the result; frequent strings stay. Strings over `long` characters are forgotten after each use.
    """

    def __init__(self, most: int, long: int = 64):
        self.most, self.long = most, long
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, rows: list[list[str]], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The joined values of each row; make gives those of strings that are not remembered."""
        new = self.new
        missing = set().union(*rows).difference(new)
        back = missing.intersection(self.old)
        new.update({w: self.old[w] for w in back})
        missing -= back
        if missing:
            new.update(make(list(missing)))
        out = [b"".join(map(new.__getitem__, r)) for r in rows]
        for w in missing:
            if len(w) > self.long:
                new.pop(w, None)
        if len(new) > self.most:
            self.old, self.new = new, {}
        return out

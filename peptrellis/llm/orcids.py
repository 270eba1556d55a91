"""Token ids as ORC files: integer run-length encoded id lists, row indexes, Bloom filters on doc_id.

Files follow ascending doc_id. Each row holds doc_id, shard (number of its file's task, ascending), at (ids before it in the
shard), n_tokens and ids. Readers take stripes in parallel; statistics, row indexes and Bloom filters skip what a doc_id cannot be in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches

SCHEMA = "doc_id long, shard int, at long, n_tokens int, ids array<int>"
OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Bytes of text that are split and deduplicated together.
PART_BYTES = 4 << 20
#: Distinct words, and bytes of them, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 500_000, 32 << 20
#: Separates words that are encoded in one text; words that hold it (special tokens do) are encoded alone.
SEPARATOR = "|"
#: Words are encoded in joined texts of so many.
JOINED = 200
#: ASCII marks that form a token run of their own where they end a word after a letter.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != SEPARATOR)


class WordEncoder:
    """The tokenizers library over words between ASCII white space, each distinct word once.

    For tokenizers whose normaliser and pre-tokeniser drop white space, lower-case, and split letters from marks, as the word
    BPE with word ends does: no token then crosses ASCII white space, and an ASCII word without SEPARATOR has the ids of its
    lower-cased letters followed by those of its closing marks. All other words reach the library as they are, so special tokens
    (matched before any normalising) and characters that compose keep their own ids.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()
        mark = self._ids([SEPARATOR])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _forget(self) -> None:
        #: Place and number of a word's ids in `flat`, as place << 32 | number.
        self.seen: dict[str, int] = {}
        self.flat, self.used, self.bytes = np.zeros(1 << 16, np.int32), 0, 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        packed = (self.used + cuts[:-1] << 32) | np.diff(cuts)
        self.seen.update(zip(words, packed.tolist(), strict=True))
        self.used += len(ids)
        self.bytes += sum(map(len, words))

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if SEPARATOR not in w] if self.mark is not None else []
        alone = [w for w in words if SEPARATOR in w] if self.mark is not None else words
        if alone:
            ids = self._ids(alone)
            self._keep(alone, np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
        if plain:
            groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
            closing = np.array([self.mark], np.int32)
            ids = np.concatenate([x for g in self._ids([f" {SEPARATOR} ".join(g) for g in groups]) for x in (g, closing)])
            ends = np.flatnonzero(ids == self.mark)
            self._keep(plain, np.delete(ids, ends), np.concatenate([[0], ends - np.arange(len(ends))]))

    def _packed(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            self._learn(list({words[k] for k in new}))
            out[new] = [self.seen[words[k]] for k in new]
        return out

    def _of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and each word's first (n + 1)."""
        if len(self.seen) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, SEPARATOR)))
        low = pc.if_else(plain, pc.ascii_lower(words), words)
        core = pc.ascii_rtrim(low, characters=MARKS)
        core = pc.if_else(pc.and_(plain, pc.ascii_is_alpha(pc.utf8_slice_codeunits(core, -1))), core, low)
        closing = np.flatnonzero(pc.binary_length(core).to_numpy() < pc.binary_length(low).to_numpy())
        cores = core.to_numpy(zero_copy_only=False).tolist()
        some = low.take(pa.array(closing)).to_numpy(zero_copy_only=False).tolist()
        packed = np.zeros((len(cores), 2), np.int64)
        packed[:, 0] = self._packed(cores)
        packed[closing, 1] = self._packed([w[len(cores[k]) :] for k, w in zip(closing.tolist(), some, strict=True)])
        pieces = packed.reshape(-1)
        ids, cuts = _gathered(self.flat, pieces >> 32, pieces & 0xFFFFFFFF)
        return ids, cuts[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) end to end, and each text's first (n + 1)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, cuts = self._of_distinct(words.dictionary)
        at = words.indices.to_numpy()
        ids, ends = _gathered(ids, cuts[:-1][at], np.diff(cuts)[at])
        return ids, ends[lists.offsets.to_numpy()]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[k]:starts[k] + sizes[k]] for all k, end to end, and where each begins (n + 1)."""
    cuts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=cuts[1:])
    return flat[np.repeat(starts - cuts[:-1], sizes) + np.arange(cuts[-1])], cuts


_loaded: dict[str, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    """A worker keeps its encoder, and what it remembers, for its next tasks."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = WordEncoder(spec)
    return _loaded[spec]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode docs' whole texts (null: empty), append end_id to each, and write them to path in ascending doc_id order (nulls
    first). Repeated rows are written as often as they stand; rows of one doc_id follow each other in no stated order. Columns
    other than doc_id and text are ignored. An empty table gives files without rows."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard, at = _encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                ids, cuts = encoder.encode(part.column("text"))
                ids = np.insert(ids, cuts[1:], end_id)
                cuts = cuts + np.arange(len(cuts))
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "shard": pa.array(np.full(part.num_rows, shard, np.int32)),
                    "at": pa.array(at + cuts[:-1]),
                    "n_tokens": pa.array(np.diff(cuts).astype(np.int32)),
                    "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
                })
                at += int(cuts[-1])

    small_batches(docs.sparkSession)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = wanted.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(rows, SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The rows of the files; a filter on doc_id reaches their statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if where is None else df.where(where)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files: one row for each row written (a
    null or empty text has its end id alone; a null doc_id stays null). The id column is read once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            cuts = lists.offsets.to_numpy()
            values = np.asarray(lists.values).astype("<u4")
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "shard": batch.column("shard"), "at": batch.column("at"),
                "n_tokens": batch.column("n_tokens").cast(pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
            })

    per = read_tokens(spark, path).mapInArrow(rows, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    # A row for each task that wrote a file, from two small columns.
    totals = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return per.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

"""Importance resampling towards a target distribution: hashed n-gram features, gains by bucket, a weighted draw without return.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes, bytes.split yields the words, zlib.crc32 extends a run of
words by seeding with the run before it, Counters sum features inside a task before they are added up by bucket. A document's weight
is the floored mean of its features' gains; Gumbel noise from its id makes the highest scores a draw in proportion to exp(weight).

Null and empty texts have no features and weight 0; a text is read in slices, however long; repeated rows are documents of their own
and rank beside each other (ties of score and doc_id by n_features, then weight); a null doc_id is hashed as no characters and ranks
first among ties. Other columns are not looked at. An empty table gives an empty result, an empty target gains of its smoothing alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import CHUNK_BYTES, slices, small_batches, staged

#: Keeps digits, letters and all bytes of non-ASCII characters; lower-cases A-Z; everything else becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Runs of up to so many words, buckets, seed, percent drawn, words that a document must have to be drawn.
LENGTHS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, "2024", 10, 20
#: Words whose gains a task remembers.
REMEMBERED = 200_000


def word_lists(text: bytes, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, from slices of about `most` bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + most
        part = text[at:end].translate(FOLD)
        while end < len(text) and part[-1] != 32 and FOLD[text[end]] != 32:
            more = text[end : end + most].translate(FOLD)
            cut = more.find(b" ")
            part += more if cut < 0 else more[:cut]
            end += len(more) if cut < 0 else cut
        at = end
        yield part.split()


def runs(text: bytes, lengths: int) -> Iterator[tuple[list[bytes], list[list[int]]]]:
    """For each slice of a text its words, and the crc32 of all runs of 2 to `lengths` words that end in it, by length."""
    last: list[bytes] = []
    for words in word_lists(text):
        longer = []
        if lengths > 1:
            joined = last + words
            spaced = [b" " + w for w in joined]
            crc = list(map(zlib.crc32, joined))
            for m in range(2, lengths + 1):
                crc = [zlib.crc32(w, c) for w, c in zip(spaced[m - 1 :], crc)]
                # Runs that end among the words of earlier slices were given with those.
                longer.append(crc[max(0, len(last) - m + 1) :])
            last = joined[max(0, len(joined) - lengths + 1) :]
        yield words, longer


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_counts(texts: DataFrame, lengths: int = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words: Counter[bytes] = Counter()
                crcs: Counter[int] = Counter()
                for text in _texts(part):
                    for singles, longer in runs(text, lengths):
                        words.update(singles)
                        for level in longer:
                            crcs.update(level)
                for keys, counts in ((map(zlib.crc32, words), words), (crcs, crcs)):
                    np.add.at(total, np.fromiter(keys, np.int64, len(counts)) % buckets, np.fromiter(counts.values(), np.int64, len(counts)))
        hit = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(hit, pa.int64()), "n": pa.array(total[hit], pa.int64())})

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the bucket counts of the source and the target (one row a bucket each)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((source, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = n
    return np.floor(1000 * np.log((t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets)))).astype(np.int64)


class _Gains(dict):
    """Gains of words, worked out when first seen."""

    def __init__(self, by_bucket: list[int]):
        super().__init__()
        self.by_bucket = by_bucket

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        gain = self.by_bucket[zlib.crc32(word) % len(self.by_bucket)]
        if len(word) <= 64:
            self[word] = gain
        return gain


def weights(docs: DataFrame, by_bucket: np.ndarray, lengths: int = LENGTHS) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row a document."""
    table = by_bucket.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Gains(table)
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_features, weight = [], [], []
                for text in _texts(part):
                    n = m = total = 0
                    for singles, longer in runs(text, lengths):
                        n += len(singles)
                        total += sum(map(known.__getitem__, singles))
                        for level in longer:
                            m += len(level)
                            total += sum(table[c % len(table)] for c in level)
                    n_words.append(n)
                    n_features.append(n + m)
                    weight.append(total // (n + m) if n else 0)
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weight, pa.int64())})
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, lengths: int = LENGTHS, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank); rank counts from 1 among those drawn and is null for others."""
    by_bucket = gains(bucket_counts(docs, lengths, buckets), bucket_counts(target, lengths, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(share))).cast("long")
    scored = staged(weights(docs, by_bucket, lengths).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ties = [F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = global_rank(scored.where(able), "score", ties, staged)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).union(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


#: The reflected CRC-32 of the sixteen half bytes.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
SQL = f"""WITH words AS (
  SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
bytes AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT DISTINCT w FROM words)),
halves AS (SELECT w, list_transform(range(length(hx)), lambda i: instr('0123456789ABCDEF', hx[xor(i, 1) + 1]) - 1) AS nibs FROM bytes),
buckets AS (SELECT w, xor(list_reduce(list_prepend(cast(4294967295 AS bigint), nibs), lambda c, x: xor(cast({_NIBBLES}[(xor(c, x) & 15) + 1] AS bigint), c >> 4)), 4294967295) % {BUCKETS} AS bucket FROM halves),
counts AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM counts),
gains AS (SELECT bucket, cast(floor(1000 * ln((t + 1.0::double) * (big_s + {BUCKETS}) / ((s + 1.0::double) * (big_t + {BUCKETS})))) AS bigint) AS gain FROM counts, totals),
sums AS (SELECT id, count(*) AS n, cast(sum(gain) AS bigint) AS total FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 's' GROUP BY id),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(cast(floor(total / n) AS bigint), 0) AS weight, cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS bigint) AS h FROM documents LEFT JOIN sums ON doc_id = id),
scored AS (SELECT doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) AS bigint) AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * many // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""

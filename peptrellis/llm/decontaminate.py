"""Benchmark decontamination: rare n-gram seeds join documents to benchmark items, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased. An item's seeds are its three-word n-grams that are rare in the corpus: all
but those that are both among the item's commonest (beyond the quantile RARER) and commoner than RARE. Items of fewer than SHORT words are one seed
as a whole. Seeds meet the documents' n-grams in a join; hits of one item near each other open a window of the document, which is
aligned with the item: match 2, mismatch and gap -1. A local score of half the item's own score or more is a leak, so paraphrased,
edited and partial copies count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, FlatTexts, byte_set, free_name, hash_runs, map_texts, mix, row_key, staged

SEED_WORDS, MATCH, MISMATCH, GAP, LEAK = 3, 2, -1, -1, 0.5
#: Items of fewer words are looked for as they stand.
SHORT = 6
#: Share of all the corpus' n-grams from which on one is common.
RARE = 1e-5
#: Share of an item's n-grams that are seeds however common they are: of an item that leaked often none is rare.
RARER = 0.75
#: Rows of seeds, windows or items that are broadcast in joins; beyond, they are shuffled.
BROADCAST_ROWS = 200_000
#: Bits of the filter that n-grams of documents must pass before they are joined: 64 for each n-gram looked for, within these bounds.
FILTER_BITS = (1 << 16, 1 << 27)
#: Cells of alignment rows that are computed at once.
CELLS = 1 << 18

ALNUM = byte_set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", above=True)


def words_of(flat: FlatTexts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows end to end, and each row's first (n + 1)."""
    starts, ends, first = flat.runs(ALNUM)
    return hash_runs(LOWER[flat.data], starts, ends), first


def ngrams(h: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """Hashes of h[i:i + n]."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[j : len(out) + j]
    return mix(out)


class Among:
    """Membership of hashes in a fixed set: a bitmap over 20 bits first, then binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.values & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and their indexes in values."""
        at = np.flatnonzero(self.map[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(self.values) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        hit = self.values[k] == h[at]
        return at[hit], k[hit]


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of windows[k] with items[k], all at once, one item word after the other."""
    wide, long = max(map(len, windows)), max(map(len, items))
    w = np.zeros((len(windows), wide), np.uint64)
    t = np.ones((len(items), long), np.uint64)
    for k, (a, b) in enumerate(zip(windows, items, strict=True)):
        w[k, : len(a)], t[k, : len(b)] = a, b
    ramp = np.arange(wide, dtype=np.int32) * -GAP
    above = np.zeros((len(windows), wide + 1), np.int32)
    best = np.zeros(len(windows), np.int32)
    for i in range(long):
        x = above[:, :-1] + np.where(w == t[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        np.maximum(x, above[:, 1:] + GAP, out=x)
        np.maximum(x, 0, out=x)
        above[:, 1:] = np.maximum.accumulate(x + ramp, axis=1) - ramp
        np.maximum(best, above.max(axis=1), out=best)
    return best


class Filter:
    """Two bits for each n-gram looked for, in a map of bounded size: it lets all of them pass, and few others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64(bits - 1), words

    @classmethod
    def of(cls, grams: DataFrame) -> Filter:
        """grams: gram. A row of the map for each 64 bits comes to the driver, whatever the number of n-grams."""
        least, most = FILTER_BITS
        bits = min(most, max(least, 1 << (64 * grams.count()).bit_length()))
        each = grams.select(F.explode(F.array(F.col("gram"), F.shiftright("gram", 32))).alias("at")).selectExpr(f"at & {bits - 1} AS bit")
        rows = each.selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, int(bit & 63)) AS bit")
        words = np.zeros(bits >> 6, np.int64)
        got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        words[got["word"].to_numpy()] = got["bits"].to_numpy()
        return cls(bits, words.view(np.uint64))

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Positions in h that pass."""
        at = np.arange(len(h))
        for shift in (0, 32):
            bit = (h[at] >> np.uint64(shift)) & self.mask
            at = at[(self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0]
        return at


def _inside(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of `width` words that do not cross rows: hashes, rows, and places in their rows."""
    grams = ngrams(h, width)
    row = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    at = np.flatnonzero(np.arange(len(grams)) + width <= first[row + 1])
    return grams[at], row[at], at - first[row[at]]


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, size (words), words (their hashes as bytes), grams (seed candidates: struct gram, at, width)."""

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        h, first = words_of(flat)
        grams = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            width = SEED_WORDS if b - a >= SHORT else int(b - a)
            own = ngrams(h[a:b], width).view(np.int64).tolist() if width else []
            grams.append([{"gram": g, "at": k, "width": width} for k, g in enumerate(own)])
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("width", pa.int32())]))
        words = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.record_batch([part.column("item"), part.column("item_id"), pa.array(np.diff(first).astype(np.int32)), pa.array(words, pa.binary()), pa.array(grams, kind)], names=["item", "item_id", "size", "words", "grams"])

    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    keyed = wanted.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return map_texts(keyed, rows, "item long, item_id long, size int, words binary, grams array<struct<gram: long, at: int, width: int>>").where("size > 0")


def _small(df: DataFrame) -> DataFrame:
    """A staged df, broadcast in joins if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _counts(docs: DataFrame, grams: DataFrame, widths: list[int]) -> DataFrame:
    """gram, n: how often n-grams that pass the filter of `grams` stand in docs. A null gram counts all n-grams of SEED_WORDS words."""
    held = docs.sparkSession.sparkContext.broadcast(Filter.of(grams))

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        h, first = words_of(flat)
        some = [_inside(h, first, w)[0] for w in widths]
        hit, n = np.unique(np.concatenate([g[held.value.passing(g)] for g in some]), return_counts=True)
        total = int(np.maximum(np.diff(first) - SEED_WORDS + 1, 0).sum())
        return pa.record_batch([pa.array([None, *hit.view(np.int64).tolist()], pa.int64()), pa.array([total, *n.tolist()], pa.int64())], names=["gram", "n"])

    return map_texts(docs.select("text"), rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _hits(docs: DataFrame, seeds: DataFrame, widths: list[int]) -> DataFrame:
    """row, gram, at (its first word in the document): all places in docs of n-grams that pass the filter of the seeds."""
    held = docs.sparkSession.sparkContext.broadcast(Filter.of(seeds.select("gram").distinct()))

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        h, first = words_of(flat)
        keys, out = part.column("row").to_numpy(), []
        for w in widths:
            grams, row, at = _inside(h, first, w)
            k = held.value.passing(grams)
            out.append((keys[row[k]], grams[k].view(np.int64), at[k]))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["row", "gram", "at"])

    return map_texts(docs.select("row", "text"), rows, "row long, gram long, at long")


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, windows (item, low, high): where in which rows seeds of which items stand, a window for hits near each other."""
    grams = items.select("item", "size", F.explode("grams").alias("g")).select("item", "size", "g.*")
    grams = staged(grams, "item-grams")
    # SHORT widths at most.
    widths = sorted(r.width for r in grams.select("width").distinct().collect()) or [SEED_WORDS]
    counts = staged(_counts(docs, grams.select("gram").distinct(), widths), "gram-counts")
    total = counts.where("gram is null").select(F.col("n").alias("total"))
    known = grams.join(_small(counts), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(total))
    line = F.percentile("n", RARER).over(Window.partitionBy("item"))
    seeds = staged(known.withColumn("line", line).where((F.col("n") <= F.col("line")) | (F.col("n") <= RARE * F.col("total"))).select("item", "size", "gram", F.col("at").alias("place")), "seeds")
    found = _hits(docs, seeds, widths).join(_small(seeds), "gram").select("row", "item", "size", (F.col("at") - F.col("place")).alias("begin")).distinct()
    near = Window.partitionBy("row", "item").orderBy("begin")
    opens = F.coalesce(F.col("begin") - F.lag("begin").over(near) > F.col("size"), F.lit(True))
    spans = found.withColumn("opens", opens.cast("int")).withColumn("k", F.sum("opens").over(near)).groupBy("row", "item", "k").agg(F.min("begin").alias("low"), F.max("begin").alias("high"), F.first("size").alias("size"))
    pad = F.expr("size div 2 + 3")
    window = F.struct("item", F.greatest(F.lit(0), F.col("low") - pad).alias("low"), (F.col("high") + F.col("size") + pad).alias("high"))
    return spans.groupBy("row").agg(F.collect_list(window).alias("windows"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity (local alignment score over the item's own), window_start, window_end (in the document's words):
    the best window of each document row and item that leaked.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null texts hold nothing; a null doc_id stays null. Items
    without a word or with a null id are skipped; of one item id, each different text is an item. Items of fewer than SHORT words
    leak where all their words stand in a row. Repeated rows of docs give repeated leaks; repeated items count once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _leaks(own.withColumn("row", row_key(own)), benchmark).drop("row")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = staged(_items(benchmark), "items")
    windows = staged(_windows(docs, items), "windows")
    schema = "nth long, row long, doc_id long, item long, low long, high long, piece binary"

    def cut(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        h, first = words_of(flat)
        out: list[list] = [[] for _ in range(7)]
        for r, (nth, row, doc, some) in enumerate(zip(*(part.column(c).to_pylist() for c in ("nth", "row", "doc_id", "windows")), strict=True)):
            for w in some:
                low, high = w["low"], min(w["high"], int(first[r + 1] - first[r]))
                for to, x in zip(out, (nth, row, doc, w["item"], low, high, h[first[r] + low : first[r] + high].tobytes()), strict=True):
                    to.append(x)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["nth", "row", "doc_id", "item", "low", "high", "piece"])

    # A number for each row of docs, written down: repeated rows stay apart.
    whole = docs.join(_small(windows), "row").withColumn("nth", F.monotonically_increasing_id())
    found = staged(map_texts(whole, cut, schema), "pieces")
    both = found.join(_small(items.select("item", "item_id", "words")), "item")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("piece", "words"))
            x = similarities(one, two)
            hit = pa.array(np.flatnonzero(x >= LEAK))
            yield pa.record_batch([*(batch.column(c).take(hit) for c in ("nth", "row", "doc_id", "item", "item_id", "low", "high")), pa.array(x).take(hit)], names=["nth", "row", "doc_id", "item", "item_id", "low", "high", "similarity"])

    all_ = both.mapInArrow(scored, "nth long, row long, doc_id long, item long, item_id long, low long, high long, similarity double")
    best = F.max(F.struct("similarity", (-F.col("low")).alias("minus"), "high")).alias("x")
    per = all_.groupBy("nth", "row", "doc_id", "item", "item_id").agg(best)
    return per.select("row", "doc_id", "item_id", "x.similarity", (-F.col("x.minus")).alias("window_start"), F.col("x.high").alias("window_end"))


def similarities(pieces: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Local scores of pieces[k] with items[k] over the items' own scores: alike sizes are aligned together."""
    out = np.zeros(len(pieces))
    order = sorted(range(len(pieces)), key=lambda k: (len(pieces[k]), len(items[k])))
    k = 0
    while k < len(order):
        take = 1
        while k + take < len(order) and (take + 1) * len(pieces[order[k + take]]) <= CELLS:
            take += 1
        some = order[k : k + take]
        k += take
        scores = align([pieces[j] for j in some], [items[j] for j in some])
        out[some] = scores / np.array([MATCH * len(items[j]) for j in some])
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a leak; all columns and other rows (null and empty texts, null ids, repeated ones) stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key, name = row_key(own), free_name(docs, "_row")
    bad = staged(_leaks(own.withColumn("row", key), benchmark).select("row").distinct(), "leaked")
    return docs.withColumn(name, key).join(_small(bad.withColumnRenamed("row", name)), name, "left_anti").select(*docs.columns)


def drop_rows(docs: DataFrame, bad: Callable[[FlatTexts], np.ndarray]) -> DataFrame:
    """docs without the rows (of each part) that bad returns the numbers of."""

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        keep = np.ones(flat.n, bool)
        keep[bad(flat)] = False
        return part.filter(pa.array(keep))

    return map_texts(docs, rows, docs.schema)

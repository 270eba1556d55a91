"""Order MinHash near-duplicate classes.

Five-word shingles (words: runs without white space, A-Z lower-cased) are labelled with their occurrence number in the text.
Each of SKETCHES sketches samples the ELL shingles of least seeded hash and keeps them in text order. Texts that share a sketch
are candidates; a banded alignment of their shingle sequences (a longest chain of equal labelled shingles that moves forward in
both texts and stays inside the band that a similarity of 0.8 allows) verifies them: chain / (n_a + n_b - chain) >= 0.8.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, FlatTexts, free_name, hash_runs, map_texts, mix, row_key, staged

WORDS, SIMILARITY, SKETCHES, ELL = 5, 0.8, 16, 2
#: Texts of a similarity of SIMILARITY share a sketch with probability of 0.6 at least; a pair with fewer than AGREE equal sketches
#: of SKETCHES is no candidate (one such pair in 10,000 at 0.8, fewer above).
AGREE = 3
#: Rows of a table (ids or places, about 50 bytes each) that may be broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 200_000
#: Texts of a bucket, and shingles of those that are aligned, that one task pairs at once.
BLOCK_TEXTS, BLOCK_SHINGLES = 4096, 500_000
#: Texts of a bucket, and links of a node, from which on what they wait for is broadcast instead of shuffled to one task.
HOT = 1000


def shingles(flat: FlatTexts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all rows end to end, and each row's first (n + 1). Fewer than k words: one shingle of them all."""
    data = LOWER[flat.data]
    starts, ends, first = flat.runs(NON_SPACE)
    h = hash_runs(data, starts, ends)
    counts = np.diff(first)
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n_sh)])
    at = np.repeat(first[:-1] - offsets[:-1], n_sh) + np.arange(offsets[-1])
    left = np.repeat(first[1:], n_sh) - at
    out = np.zeros(len(at), np.uint64)
    last = max(len(h) - 1, 0)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + np.where(left > j, h[np.minimum(at + j, last)] if len(h) else 0, 0).astype(np.uint64)
    out = mix(out)
    rows = np.repeat(np.arange(flat.n), n_sh)
    order = np.lexsort((np.arange(len(out)), out, rows))
    s, r = out[order], rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    runs = np.flatnonzero(new)
    occurrence = np.arange(len(s)) - np.repeat(runs, np.diff(np.append(runs, len(s))))
    labelled = np.empty_like(out)
    labelled[order] = mix(s + occurrence.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return labelled, offsets


def sketches(labelled: np.ndarray, offsets: np.ndarray, m: int = SKETCHES) -> np.ndarray:
    """m order sketches of each row (rows x m, uint64); rows must have a shingle each."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, m), np.uint64)
    if not n:
        return out
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(m):
        v = mix(labelled ^ np.uint64((j + 1) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
        picked = []
        for _ in range(ELL):
            least = np.minimum.reduceat(v, offsets[:-1])
            hit = np.flatnonzero(v == np.repeat(least, sizes))
            row = np.searchsorted(offsets, hit, "right") - 1
            pos = np.empty(n, np.int64)
            pos[row[::-1]] = hit[::-1]
            picked.append(pos)
            v[pos] = top
        key = np.full(n, np.uint64(j))
        for pos in np.sort(np.stack(picked), axis=0):
            key = mix(key * np.uint64(0x8EBC6AF09C88C6E3) + labelled[pos])
        out[:, j] = key
    return out


#: Longs that hold the last 16 bits of each sketch, four to one.
PRINTS = SKETCHES // 4


def _sketch_rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
    import hashlib

    labelled, offsets = shingles(flat)
    full = np.flatnonzero(np.diff(offsets))
    keys = sketches(labelled, np.append(offsets[full], offsets[-1]))
    lists = np.zeros(flat.n, np.int64)
    lists[full] = SKETCHES
    low = np.zeros((flat.n, SKETCHES), np.uint64)
    low[full] = keys & np.uint64(0xFFFF)
    prints = np.bitwise_or.reduce(low.reshape(flat.n, PRINTS, 4) << (np.arange(4, dtype=np.uint64) * np.uint64(16)), axis=2).view(np.int64)
    digests = [hashlib.blake2b(labelled[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.record_batch({
        "doc_id": part.column("doc_id").cast(pa.int64()),
        "id": part.column("id").cast(pa.int64()),
        "same": pa.array(digests, pa.binary()),
        "n_shingles": pa.array(np.diff(offsets), pa.int64()),
        **{f"f{k}": pa.array(prints[:, k]) for k in range(PRINTS)},
        "sketch": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64), pa.int64())),
    })


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest chain of equal labelled shingles, forward in both, within the band of SIMILARITY."""
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    band = (len(a) + len(b)) * (1 - SIMILARITY) / (1 + SIMILARITY)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    c = aligned(a, b)
    return c / (len(a) + len(b) - c)


def _agree(one: str, two: str) -> Column:
    """How many of the sketches whose prints are in the columns one0.., two0.. are equal (16 bits tell: rarely one too many)."""
    differ = []
    for k in range(PRINTS):
        z = F.col(f"{one}{k}").bitwiseXOR(F.col(f"{two}{k}"))
        for step, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step)).bitwiseAND(F.lit(mask))
        differ.append(F.bit_count(z))
    return F.lit(SKETCHES) - reduce(lambda a, b: a + b, differ)


def _close(one: str, two: str) -> Column:
    """Whether texts of so many shingles can have SIMILARITY at all."""
    return F.least(one, two) >= SIMILARITY * F.greatest(one, two)


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast in joins if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined by key with a staged table of buckets (key, size, ...). Buckets of HOT texts and more, a HOT-th of all rows at
    most, are broadcast, so no task gets all rows of one."""
    hot = table.where(F.col("size") >= HOT)
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(table, "key")
    calm = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(table.where(F.col("size") < HOT), "key")
    return rows.join(F.broadcast(hot), "key").union(calm)


def _arrays(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """doc_id and its labelled shingles (as bytes) for the ids; repeated: docs may hold a row twice."""
    wanted = docs.select("doc_id", "text").join(_small(ids), "doc_id", "left_semi")

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        labelled, offsets = shingles(flat)
        return pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "shingles": pa.array([labelled[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())})

    arrays = map_texts(wanted, rows, "doc_id long, shingles binary")
    return arrays.dropDuplicates(["doc_id"]) if repeated else arrays


def _verified(docs: DataFrame, rays: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) of rays that the alignment confirms. Each b travels to a part of its hub a; a's shingles go to those parts
    once."""
    rays = staged(rays, "rays")
    parts = rays.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("deals"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    many = parts.where("deals > 1")
    spokes = rays.join(_small(many), "a", "left").select("a", F.pmod(F.hash("b"), F.coalesce("deals", F.lit(1))).alias("deal"), "b", F.col("b").alias("doc_id"))
    places = staged(hubs.union(spokes), "places")
    arrays = _arrays(docs, places.select("doc_id").distinct(), repeated)
    together = arrays.join(_small(places), "doc_id").repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
                if b is None:
                    hub, left = a, np.frombuffer(s, np.uint64)
                elif hub == a and similarity(left, np.frombuffer(s, np.uint64)) >= SIMILARITY:
                    found.append((a, b))
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return staged(together.mapInArrow(check, "a long, b long"), "links")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, part): the least doc_id that links (a, b) connect to each node. Rounds of neighbour minima and pointer jumps; nodes
    with many links send their labels by broadcast, so no task holds all links of one node."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    hot = staged(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).select("b"), "hot-nodes")
    # An edge in HOT at most.
    n_hot = hot.count()
    busy = 0 < n_hot <= BROADCAST_ROWS
    calm = both.join(F.broadcast(hot), "b", "left_anti") if busy else both
    labels = staged(both.select(F.col("a").alias("doc_id")).distinct().withColumn("part", F.col("doc_id")), "labels")
    while True:
        near = calm.join(labels, calm.b == labels.doc_id).select("a", "part")
        if busy:
            told = labels.join(F.broadcast(hot), labels.doc_id == hot.b, "left_semi").select(F.col("doc_id").alias("b"), "part")
            near = near.union(both.join(F.broadcast(told), "b").select("a", "part"))
        near = near.groupBy("a").agg(F.min("part").alias("least"))
        low = labels.join(near, labels.doc_id == near.a).select("doc_id", F.least("part", "least").alias("part"), F.col("part").alias("was"))
        # What a node has learnt also goes to the node that its old label names.
        told = low.groupBy(F.col("was").alias("doc_id")).agg(F.min("part").alias("told"))
        low = staged(low.join(told, "doc_id", "left").select("doc_id", F.least("part", "told").alias("part"), "was"), "low")
        # Labels that many nodes share are looked up once each.
        over = low.select(F.col("doc_id").alias("up"), F.col("part").alias("to"))
        named = low.select("part").distinct().join(over, F.col("part") == F.col("up")).select(F.col("part").alias("up"), "to")
        new = staged(low.join(_small(named), low.part == F.col("up"), "left").select("doc_id", F.least("part", "to").alias("part"), "was"), "labels")
        changed = new.where("part <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            break
    return nodes.select("doc_id").join(labels, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), n_copies (rows with its exact shingles, itself
    included), n_links (links of its text to other texts that were verified to find its class: not more than that takes), n_class (rows of the class).

    docs: doc_id, text; other columns are ignored. Texts that are null or without a word are a class of their own each.
    Different texts of one doc_id are classed apart. A row without doc_id is classed by its text like others; class_id is null where
    no row of the class has a doc_id. Exact copies (equal shingles) collapse before the search.
    """
    return _classed(docs, row_key(_own(docs))).select("id", "class_id", "n_copies", "n_links", "n_class").withColumnRenamed("id", "doc_id")


def first_of_classes(docs: DataFrame) -> DataFrame:
    """Of each class of near copies the row with the least doc_id (then of the least row key); of repeated rows of it, one. A row
    without doc_id stays only where no row of its class has one. Rows without doc_id and without a word all stay."""
    key, name = row_key(_own(docs)), free_name(docs, "_row")
    found = _classed(docs, key)
    least = found.where("part is not null").groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("x")).select("x.row")
    blank = found.where("part is null")
    keyed = docs.withColumn(name, key)
    one = least.union(blank.where("id is not null").select("row")).select(F.col("row").alias(name)).distinct()
    every = blank.where("id is null").select(F.col("row").alias(name)).distinct()
    kept = keyed.join(one, name, "left_semi").dropDuplicates([name])
    return kept.unionByName(keyed.where("doc_id is null").join(every, name, "left_semi")).select(*docs.columns)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a first search: the hub of a bucket and a text of it. A bucket's hub is the text whose sketches are the most
    shared: near the centre of its group."""
    some = ("doc_id", "n_shingles", *(f"f{k}" for k in range(PRINTS)))
    top = F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), *some)).alias("top")
    hubs = members.groupBy("key", "size").agg(top).select("key", "size", *(F.col(f"top.{c}").alias(f"hub_{c}") for c in some))
    rays = _by_key(members.drop("size"), staged(hubs, "hubs")).where((F.col("doc_id") != F.col("hub_doc_id")) & _close("n_shingles", "hub_n_shingles"))
    return rays.where(_agree("f", "hub_f") >= AGREE).select(F.col("hub_doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _dealt(rows: DataFrame, load: str, most: int) -> DataFrame:
    """rows (key, part, home, doc_id, ..., load) with block and pair: tasks of a bucket. A bucket of a load up to `most` is one task.
    The rows of the home part and the others of a larger one are cut into blocks, and each pair of blocks is a task, but for pairs of
    home blocks: home rows are connected already."""
    at_home = F.col("part") == F.col("home")
    loads = rows.groupBy("key").agg(F.sum(F.when(at_home, F.col(load)).otherwise(0)).alias("h"), F.sum(F.when(at_home, 0).otherwise(F.col(load))).alias("o"), F.count(F.lit(1)).alias("size"))
    blocks = lambda c: F.when(F.col("h") + F.col("o") <= most, F.lit(1 if c == "o" else 0)).otherwise(F.ceil(F.col(c) / most)).cast("long").alias(f"n{c}")
    put = _by_key(rows, staged(loads.select("key", "size", blocks("h"), blocks("o")), "loads")).drop("size")
    h, o, mix_ = F.col("nh"), F.col("no"), F.hash("doc_id")
    put = put.withColumn("block", F.when((h > 0) & at_home, F.pmod(mix_, h)).otherwise(h + F.pmod(mix_, o)))
    name = lambda one, two: one * (h + o) + two
    others = F.transform(F.sequence(h, h + o - 1), lambda x: name(F.least(x, F.col("block")), F.greatest(x, F.col("block"))))
    homes = F.when(h > 0, F.transform(F.sequence(F.lit(0).cast("long"), h - 1), lambda x: name(x, F.col("block")))).otherwise(F.array().cast("array<long>"))
    pairs = F.when(F.col("block") < h, F.transform(F.sequence(h, h + o - 1), lambda x: name(F.col("block"), x))).otherwise(F.concat(homes, others))
    return put.withColumn("pair", F.explode(pairs)).drop("nh", "no").repartition("key", "pair").sortWithinPartitions("key", "pair")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key and pair, which follow each other."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, pair = (batch.column(c).to_numpy() for c in ("key", "pair"))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if rest and (rest[0].column("key")[0].as_py(), rest[0].column("pair")[0].as_py()) != (key[a], pair[a]):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


def _active(key: int, part: np.ndarray, n: np.ndarray, block: np.ndarray, home: int, sketch: np.ndarray) -> np.ndarray:
    """Which rows of a bucket have a partner: of another part, near enough in length, with AGREE equal sketches or more, of which
    this bucket is the first."""
    out = np.zeros(len(part), bool)
    cross = len(np.unique(block)) > 1
    for x in np.flatnonzero(part != home):
        may = (part != part[x]) & (np.minimum(n, n[x]) >= SIMILARITY * np.maximum(n, n[x]))
        if cross:
            may &= block != block[x]
        some = np.flatnonzero(may)
        if len(some):
            same = sketch[some] == sketch[x]
            hit = some[(same.sum(axis=1) >= AGREE) & (sketch[x][same.argmax(axis=1)] == key)]
            if len(hit):
                out[hit] = out[x] = True
    return out


def _open_rows(members: DataFrame, parts: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows of buckets with several parts that have a partner there: key, doc_id, part, home, n_shingles. A pair meets in one
    bucket, the first that its texts share; a row stands for all its partners, so there are no more of them than of sketches."""
    tagged = staged(members.select("key", "doc_id").join(parts, "doc_id"), "tagged")
    sizes = tagged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("size")).where(F.col("top.n") < F.col("size"))
    homes = staged(homes.select("key", "size", F.col("top.part").alias("home")), "homes")
    mixed = staged(_by_key(tagged, homes).drop("size").join(codes.select("doc_id", "n_shingles", "sketch"), "doc_id").withColumn("one", F.lit(1)), "mixed")

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            part, n, block = (t.column(c).to_numpy() for c in ("part", "n_shingles", "block"))
            sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
            hit = _active(t.column("key")[0].as_py(), part, n, block, t.column("home")[0].as_py(), sketch)
            if hit.any():
                yield from t.filter(pa.array(hit)).select(names).combine_chunks().to_batches()

    names = ["key", "doc_id", "part", "home", "n_shingles"]
    found = _dealt(mixed, "one", BLOCK_TEXTS).mapInArrow(partnered, ", ".join(f"{c} long" for c in names))
    return staged(found.distinct(), "open")


def _joining(part: np.ndarray, block: np.ndarray, home: int, arrays: list[np.ndarray]) -> list[tuple[int, int]]:
    """Confirmed links that connect what is connected among the rows of a bucket and not one part already, as positions."""
    cross = len(np.unique(block)) > 1
    root = {p: p for p in part.tolist()}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    sizes = np.array([len(x) for x in arrays])
    every = np.concatenate(arrays)
    order = np.argsort(every, kind="stable")
    values, owner = every[order], np.repeat(np.arange(len(arrays)), sizes)[order]
    out = []
    for x in np.flatnonzero(part != home).tolist():
        low, high = np.searchsorted(values, arrays[x], "left"), np.searchsorted(values, arrays[x], "right")
        n = high - low
        both = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(arrays))
        may = both * (1 + SIMILARITY) >= SIMILARITY * (sizes + sizes[x])
        if cross:
            may &= block != block[x]
        some = np.flatnonzero(may)
        for y in some[np.argsort(-both[some], kind="stable")].tolist():
            one, two = top(int(part[x])), top(int(part[y]))
            if one != two and similarity(arrays[x], arrays[y]) >= SIMILARITY:
                root[one] = two
                out.append((x, y))
    return out


def _across(docs: DataFrame, rows: DataFrame, repeated: bool) -> DataFrame:
    """Links (a, b) between different parts among the rows of `_open_rows`: shingles travel to a row's bucket, where an index from
    shingles to texts finds who has enough in common, and the alignment confirms."""
    arrays = _arrays(docs, rows.select("doc_id").distinct(), repeated)
    dealt = staged(_dealt(rows, "n_shingles", BLOCK_SHINGLES), "dealt")
    together = dealt.join(arrays, "doc_id").repartition("key", "pair").sortWithinPartitions("key", "pair")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            doc, part, block = (t.column(c).to_numpy() for c in ("doc_id", "part", "block"))
            found = _joining(part, block, t.column("home")[0].as_py(), [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()])
            if found:
                yield pa.record_batch([pa.array(doc[list(x)]) for x in zip(*found, strict=True)], names=["a", "b"])

    return staged(together.mapInArrow(links, "a long, b long"), "links")


def _classed(docs: DataFrame, key: Column) -> DataFrame:
    """near_duplicates with id for doc_id, row (the row's key) and part (of the class; null without a word)."""
    # From here on, doc_id is the row key.
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("doc_id"), "text")
    prints = [f"f{k}" for k in range(PRINTS)]
    rows = staged(map_texts(docs, _sketch_rows, "doc_id long, id long, same binary, n_shingles long, " + "".join(f"{f} long, " for f in prints) + "sketch array<long>"), "sketches")
    worded = rows.where("n_shingles > 0")
    repeated = worded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    classes = worded.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n_copies"))
    codes = worded.join(classes, [worded.same == classes.same, worded.doc_id == classes.rep], "left_semi").select("doc_id", "n_shingles", *prints, "sketch")
    codes = staged(codes.dropDuplicates(["doc_id"]) if repeated else codes, "codes")
    each = codes.select("doc_id", F.explode("sketch").alias("key"))
    sizes = staged(each.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = staged(_by_key(each, sizes), "shared")
    # SKETCHES rows a text at most.
    weighed = shared.withColumn("weight", F.sum(F.log2("size")).over(Window.partitionBy("doc_id")))
    members = staged(weighed.join(codes.drop("sketch"), "doc_id"), "members")
    first = _verified(docs, _stars(members), repeated)
    parts = staged(components(members.select("doc_id").distinct(), first), "parts")
    second = _across(docs, _open_rows(members, parts, codes), repeated)
    links = staged(first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    joined = components(classes.select(F.col("rep").alias("doc_id")), links)
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    rep = staged(classes.join(joined, classes.rep == joined.doc_id, "left").drop("doc_id").join(degree, F.col("rep") == degree.a, "left").select("same", "part", "least_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    per_class = rep.groupBy("part").agg(F.sum("n_copies").alias("n_class"), F.min("least_id").alias("class_id"))
    rep = rep.drop("least_id").join(per_class, "part", "left")
    one = F.lit(1).cast("long")
    none = rows.where("n_shingles = 0").select(F.col("doc_id").alias("row"), "id", F.lit(None).cast("long").alias("part"), F.col("id").alias("class_id"), one.alias("n_copies"), F.lit(0).cast("long").alias("n_links"), one.alias("n_class"))
    return worded.select(F.col("doc_id").alias("row"), "id", "same").join(rep, "same").select("row", "id", "part", "class_id", "n_copies", "n_links", "n_class").union(none)

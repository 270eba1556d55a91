"""Removal of long passages that repeat across documents, through a compacted de Bruijn graph of token k-mers.

Edges of the graph are K-word runs. Of each window of WINDOW words the k-mers of least hash are kept (a choice that only the window's
words make, so equal windows keep equal edges): one edge in about 18 words. Edges that lie in two documents or more are repeated. An
edge is nonbranching if all its occurrences stand between the same edges and words, which a digest of that neighbourhood tells; runs
of nonbranching repeated edges compact into paths, on which every window lies in the same documents as its edges, so joining edges to
their occurrences decides whole runs of windows. Other windows whose own least edge is repeated (where passages begin, end or are
edited) are read again at their source coordinates, and 128-bit digests of their words are joined.

Words are runs without ASCII white space. Exact copies of a word sequence collapse before the graph is built. A document without an
id neither loses words nor makes others lose any; rows that share an id do not affect each other, and each is answered by its own
text. Null, empty and short texts have no window and lose nothing. Other columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, NON_SPACE, FlatTexts, _table, hash_runs, map_texts, mix, staged

WINDOW, K = 50, 15
#: The neighbourhood of an edge without one before or after it in its document.
OPEN = -(1 << 63)
#: Documents whose ids may be broadcast, to pick their texts without shuffling all others; beyond, a shuffled join.
BROADCAST_ROWS = 200_000


class Words:
    """The words of some texts: hashes, the first of each row (n + 1), and the texts with words one space apart."""

    def __init__(self, flat: FlatTexts):
        starts, ends, self.first = flat.runs(NON_SPACE)
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        out = np.full(int(self.ends[-1]) + 1 if len(sizes) else 0, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[self.ends] = False
        out[inside] = flat.data[NON_SPACE[flat.data]]
        self.text = out.tobytes()
        self.hashes = hash_runs(flat.data, starts, ends)
        self.n = flat.n

    def row(self, i: int) -> bytes:
        a, b = self.first[i], self.first[i + 1]
        return self.text[self.starts[a] : self.ends[b - 1]] if b > a else b""

    def anchors(self, window: int = WINDOW, k: int = K) -> np.ndarray:
        """Places of the kept k-mers; sets self.kmers, and self.least: the least k-mer of the window that starts at each word (0: none)."""
        n, reach = len(self.hashes), window - k + 1
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.kmers, self.least = np.full(n, top), np.zeros(n, np.uint64)
        if n < window:
            return np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * _table(_BASE, n), out=sums[1:])
        self.kmers[: n - k + 1] = mix((sums[k:] - sums[:-k]) * _table(pow(_BASE, -1, 1 << 64), n)[: n - k + 1])
        self.kmers[left < k] = top
        self.least = np.where(left >= window, _sliding(self.kmers, reach, np.minimum, top), np.uint64(0))
        most = _sliding(np.concatenate([np.zeros(reach - 1, np.uint64), self.least]), reach, np.maximum, np.uint64(0))[:n]
        return np.flatnonzero((self.kmers == most) & (most > 0))


def _sliding(x: np.ndarray, w: int, of, fill: np.uint64) -> np.ndarray:
    """of(x[i], ..., x[i + w - 1]) for each i."""
    out, span = np.concatenate([x, np.full(w - 1, fill)]), 1
    while span * 2 <= w:
        out = of(out[:-span], out[span:])
        span *= 2
    return of(out[: len(x)], out[w - span : w - span + len(x)])


def _digest(text: bytes, size: int) -> bytes:
    return hashlib.blake2b(text, digest_size=size).digest()


def _row_id(same: bytes) -> int:
    return int.from_bytes(same[:8], "little", signed=True)


def _edge_rows(window: int, k: int):
    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        words = Words(flat)
        at = words.anchors(window, k)
        row = np.searchsorted(words.first, at, "right") - 1
        near = np.full(len(at), OPEN, np.int64)
        inner = np.flatnonzero((row[1:-1] == row[:-2]) & (row[1:-1] == row[2:])) + 1
        before, behind, text = at[inner - 1], at[inner + 1], words.text
        ends = zip(words.starts[before].tolist(), words.ends[behind + k - 1].tolist(), (at[inner] - before).tolist(), (behind - at[inner]).tolist())
        near[inner] = np.frombuffer(b"".join(_digest(b"%d %d %b" % (u, v, text[x:y]), 8) for x, y, u, v in ends), np.int64) if len(inner) else 0
        texts = [words.row(i) for i in range(flat.n)]
        same = [_digest(t, 16) for t in texts]
        offsets = pa.array(np.searchsorted(row, np.arange(flat.n + 1)), pa.int32())
        lists = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
        return pa.record_batch({
            "doc_id": part.column("doc_id").cast(pa.int64()),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "same": pa.array(same, pa.binary()),
            "row": pa.array(list(map(_row_id, same)), pa.int64()),
            "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            "pos": lists(at - words.first[row], pa.int32()),
            "edge": lists(words.kmers[at].view(np.int64), pa.int64()),
            "near": lists(near, pa.int64()),
        })

    return rows


_EDGE_SCHEMA = "doc_id long, n_words long, same binary, row long, sha string, pos array<int>, edge array<long>, near array<long>"


def _window_rows(window: int, k: int):
    """Runs of windows on compacted paths that a smaller document has, and digests of the windows with a branching edge."""

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        words = Words(flat)
        at = words.anchors(window, k)
        edge_row = np.searchsorted(words.first, at, "right") - 1
        doc, row = (part.column(c).to_pylist() for c in ("doc_id", "row"))
        marks, out = part.column("marks"), []
        for i in range(flat.n):
            a, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
            if n < window or _row_id(_digest(words.row(i), 16)) != row[i]:
                continue
            places = at[edge_row == i] - a
            mark = np.unique(marks[i].values.to_numpy(zero_copy_only=False))
            flags = np.zeros(len(places), np.int64)
            flags[np.searchsorted(places, mark >> 3)] = mark & 7 | 8
            start = np.arange(n - window + 1)
            low, high = np.searchsorted(places, start), np.searchsorted(places, start + window - k, "right")
            sums = np.concatenate([[0], np.cumsum(flags & 12 == 12)])
            # On a path: all edges kept in the window are repeated and nonbranching, here and so wherever the window stands.
            path = sums[high] - sums[low] == high - low
            # The window's own edge: repeated; in a smaller document; in a larger one.
            values, which = np.unique(words.kmers[a + places], return_index=True)
            own = flags[which[np.searchsorted(values, words.least[a : a + len(start)])]]
            below, above = (own & 1) > 0, (own & 2) > 0
            runs = np.flatnonzero(np.diff(np.concatenate([[False], path & below, [False]])))
            for x, y in zip(runs[::2].tolist(), runs[1::2].tolist()):
                out.append((doc[i], row[i], x, y - x, None, None, 1))
            for x in np.flatnonzero(~path & (below | above)).tolist():
                d = _digest(words.text[words.starts[a + x] : words.ends[a + x + window - 1]], 16)
                out.append((doc[i], row[i], x, 1, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), int(below[x]) + 2 * int(above[x])))
        columns = list(zip(*out)) if out else [()] * 7
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, _WINDOW_KINDS)], names=["doc_id", "row", "start", "n", "d1", "d2", "role"])

    return rows


_WINDOW_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
_WINDOW_SCHEMA = "doc_id long, row long, start int, n int, d1 long, d2 long, role int"


def texts_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found (staged, with doc_id) with the texts of its documents."""
    ids = found.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if found.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts.join(found, "doc_id")


def spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, removed). rows: (doc_id, row, n_words, sha, copy) for every document; copy: a smaller document has all its words in this
    order. removed: (doc_id, row, windows) for those that lose part of their words; a window run is start << 32 | number of windows."""
    edges = staged(map_texts(docs.select("doc_id", "text"), _edge_rows(window, k), _EDGE_SCHEMA), "edges")
    able = edges.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    copies = able.groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = staged(copies, "copies")
    slim = edges.select("doc_id", "row", "n_words", "sha", "same").join(copies, "same", "left")
    rows = slim.select("doc_id", "row", "n_words", "sha", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("copy"))
    one = able.join(copies, "same", "left_anti")
    least = able.join(copies, "same").where("doc_id = least").drop("least").dropDuplicates(["same"])
    placed = one.unionByName(least).select("doc_id", "row", F.explode(F.arrays_zip("pos", "edge", "near")).alias("e")).select("doc_id", "row", "e.*")
    repeated = placed.groupBy("edge").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("near").alias("a"), F.max("near").alias("b")).where("low < high")
    repeated = staged(repeated.select("edge", "low", "high", ((F.col("a") == F.col("b")) & (F.col("a") != OPEN)).alias("simple")), "repeated")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    mark = F.shiftleft(F.col("pos").cast("long"), 3) + bit(F.col("low") < F.col("doc_id"), 1) + bit(F.col("doc_id") < F.col("high"), 2) + bit(F.col("simple"), 4)
    marked = staged(placed.join(repeated, "edge").groupBy("doc_id", "row").agg(F.collect_list(mark).alias("marks")), "marks")
    windows = staged(map_texts(texts_of(docs, marked), _window_rows(window, k), _WINDOW_SCHEMA), "windows")
    branching = windows.where("d1 is not null")
    # Written first, so that a window of very many documents can be split between tasks of the join.
    least = staged(branching.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("d1", "d2", "low"), "windows-least")
    later = branching.where("role % 2 = 1").join(least, ["d1", "d2"]).where("low < doc_id").select("doc_id", "row", "start", "n")
    lost = windows.where("d1 is null").select("doc_id", "row", "start", "n").union(later)
    run = F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")
    return rows, staged(lost.groupBy("doc_id", "row").agg(F.collect_set(run).alias("windows")), "removed")


def _kept_rows(window: int):
    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        words = Words(flat)
        doc, row, runs = (part.column(c) for c in ("doc_id", "row", "windows"))
        keep, removed, texts = [], [], []
        for i in range(flat.n):
            if _row_id(_digest(words.row(i), 16)) != row[i].as_py():
                continue
            a, b = int(words.first[i]), int(words.first[i + 1])
            run = runs[i].values.to_numpy(zero_copy_only=False)
            change = np.zeros(b - a + 1, np.int64)
            np.add.at(change, run >> 32, 1)
            np.add.at(change, (run >> 32) + (run & 0xFFFFFFFF) + window - 1, -1)
            kept = np.cumsum(change)[:-1] == 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
            texts.append(b" ".join(words.text[words.starts[a + x] : words.ends[a + y - 1]] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())))
            removed.append(len(kept) - int(kept.sum()))
            keep.append(i)
        at = pa.array(keep, pa.int64())
        return pa.record_batch({"doc_id": doc.take(at), "row": row.take(at), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.binary()).cast(pa.string())})

    return rows


def kept_texts(docs: DataFrame, removed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, n_removed, kept) for the rows of `removed`: the words that stay, one space apart."""
    out = map_texts(texts_of(docs, removed), _kept_rows(window), "doc_id long, row long, n_removed long, kept string")
    return out


def digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Every document's (doc_id, n_words, n_removed, kept_sha256)."""
    rows, removed = spans(docs, window, k)
    cut = kept_texts(docs, removed, window).select("doc_id", "row", "n_removed", F.sha2("kept", 256).alias("cut")).dropDuplicates(["doc_id", "row"])
    n = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut", "sha"))
    return rows.join(cut, ["doc_id", "row"], "left").select("doc_id", "n_words", n.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


SQL = f"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(ws[i + 1:i + {WINDOW}], ' ')) AS d FROM (SELECT doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) AS i FROM words)),
firsts AS (SELECT d, min(doc_id) AS low FROM windows GROUP BY d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN firsts USING (d) WHERE low < doc_id),
tokens AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM tokens ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

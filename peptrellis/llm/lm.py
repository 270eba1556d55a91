"""Language-model scoring: a gated recurrent network in numpy, trained by truncated backpropagation.

Counting. Word counts cover all training documents. The FREQUENT commonest words that reach N / 2**20 (2**20 at most, so the table
may be broadcast) are looked up in tasks; the counts of all rarer words come by a shuffled join.

Model. A gated recurrent unit reads the previous word of a document and predicts a class of words, then the word within the class.
The vocabulary is the VOCABULARY commonest words and the end; all others are one more class, within which a word of count c has the
share (c + 1) / Z, with one unit left for words never seen, so the probabilities of all words sum to one. Its biases start at the
corpus' log frequencies.

Training. A warm-up on each WARM_PART-th document, in replicas that are averaged, gives the starting point. Then each task trains
its own replica on all training documents of its partition, windows of WINDOW steps with the state carried on (lanes that begin
inside a document take it from the BURN_IN tokens before), and the replicas are averaged, weighted by their tokens, in a tree. Scores therefore depend on how the input is split into partitions (not the counts or
the base). Scoring carries the state through each whole document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, FlatTexts, hash_runs, slices, small_batches, staged

HIDDEN, CLASSES, VOCABULARY, WINDOW, LANES = 16, 32, 2047, 16, 512
#: Tokens that lead to the state of a training lane that begins inside a document.
BURN_IN = 64
FREQUENT = 1 << 20
#: Of so many documents (by a hash of their ids) one takes part in the warm-up.
WARM_PART = 16
RATE_WARM, RATE = 0.1, 0.03
#: Tokens that a task holds at once, and replicas summed by one task.
HELD, FAN_IN = 1_500_000, 16
#: The end of a text, as a word hash (no word hashes to it but by chance of 2**-64) and as a word of the model.
END_HASH, END = np.uint64(0x5EED0FE4D), 0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(flat: FlatTexts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, END_HASH after each row, and each row's first (n + 1)."""
    starts, ends, first = flat.runs(NON_SPACE)
    h = hash_runs(LOWER[flat.data], starts, ends)
    return np.insert(h, first[1:], END_HASH), first + np.arange(flat.n + 1)


class Index:
    """Positions of hashes in a sorted set; -1 for others. Buckets by the leading 20 bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.first = np.searchsorted(values, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(values)))

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        bucket = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        open_ = np.flatnonzero(end > at)
        at, end, left = at[open_], end[open_], h[open_]
        while len(open_):
            hit = self.values[at] == left
            out[open_[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            open_, at, end, left = open_[on], at[on] + 1, end[on], left[on]
        return out


class Words:
    """What counting gives: N, V, the frequent words with their counts and model ids (-1: outside), Z, and classes.

    Model ids follow falling counts (END is 0); class k holds ids bounds[k] to bounds[k + 1]; the class after the last is for all
    words outside.
    """

    def __init__(self, n: int, v: int, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.n, self.v, self.counts, self.index = n, v, counts[order], Index(hashes[order])
        hashes = hashes[order]
        end = int(self.index.find(np.array([END_HASH]))[0])
        ranked = np.lexsort((hashes, -self.counts))
        ranked = np.concatenate([[end], ranked[ranked != end][:VOCABULARY]])
        self.model = np.full(len(hashes), -1, np.int32)
        self.model[ranked] = np.arange(len(ranked))
        own = self.counts[ranked].astype(float)
        self.size = len(ranked)
        self.z = (n - own.sum()) + (v - self.size) + 1
        weight = np.cumsum(np.sqrt(own + 1))
        k = np.minimum((weight - np.sqrt(own + 1)) / weight[-1] * CLASSES, CLASSES - 1).astype(int)
        self.bounds = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [self.size]])
        self.class_of = np.append(np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)), len(self.bounds) - 1)
        self.class_mass = np.append(np.add.reduceat(own, self.bounds[:-1]), n - own.sum()) + 1
        self.own = own

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model ids (size for words outside) and positions among the frequent (-1 for rare)."""
        at = self.index.find(h)
        model = np.where(at >= 0, self.model[at], -1)
        return np.where(model < 0, self.size, model).astype(np.int32), at


class Gru:
    """Parameters as float32 arrays, by name, and the passes over windows."""

    def __init__(self, words: Words, flat: np.ndarray | None = None):
        self.words, h, c, k = words, HIDDEN, len(words.bounds), words.size
        shapes = {"x": (k + 1, 3 * h), "u": (h, 2 * h), "un": (h, h), "c": (h, c), "bc": (c,), "o": (k, h), "bo": (k,)}
        self.p, at = {}, 0
        if flat is None:
            rng = np.random.default_rng(11)
            draw = {"x": 0.1, "u": 0.3, "un": 0.3, "c": 0.05, "bc": 0, "o": 0.05, "bo": 0}
            self.p = {n: (rng.standard_normal(s) * draw[n]).astype(np.float32) for n, s in shapes.items()}
            self.p["bc"] = np.log(words.class_mass / words.class_mass.sum()).astype(np.float32)
            self.p["bo"] = np.log(words.own + 1).astype(np.float32)
        else:
            for n, s in shapes.items():
                size = int(np.prod(s))
                self.p[n] = flat[at : at + size].reshape(s).astype(np.float32)
                at += size

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each step (steps x lanes x HIDDEN). x: previous words; keep: 0 where a document starts."""
        p, n = self.p, HIDDEN
        a = p["x"][x]
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            if not keep[t].all():
                h = h * keep[t][:, None]
            zr = a[t, :, : 2 * n] + h @ p["u"]
            np.multiply(zr, 0.5, out=zr)
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :n], zr[:, n:]
            rh = r * h
            new = rh @ p["un"]
            new += a[t, :, 2 * n :]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((h, z, r, rh, new))
            h = new + z * (h - new)
            out[t] = h
        return out

    def predict(self, states: np.ndarray, y: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
        """Natural log probabilities of y after the states; with learn also the losses' gradients by state and by parameter."""
        w, p = self.words, self.p
        n = len(y)
        target = w.class_of[y]
        z = states @ p["c"] + p["bc"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        log_p = np.log(z[np.arange(n), target])
        grads: dict = {}
        d_states = None
        if learn:
            z[np.arange(n), target] -= 1
            d_states = z @ p["c"].T
            grads = {"c": states.T @ z, "bc": z.sum(axis=0), "o": np.zeros_like(p["o"]), "bo": np.zeros_like(p["bo"])}
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(len(w.bounds)))
        for k in range(len(w.bounds) - 1):
            rows, a, b = order[cuts[k] : cuts[k + 1]], w.bounds[k], w.bounds[k + 1]
            if b - a < 2 or not len(rows):
                continue
            s, at = states[rows], y[rows] - a
            q = s @ p["o"][a:b].T + p["bo"][a:b]
            q -= q.max(axis=1, keepdims=True)
            np.exp(q, out=q)
            q /= q.sum(axis=1, keepdims=True)
            pick = np.arange(len(rows))
            log_p[rows] += np.log(q[pick, at])
            if learn:
                q[pick, at] -= 1
                d_states[rows] += q @ p["o"][a:b]
                grads["o"][a:b] = q.T @ s
                grads["bo"][a:b] = q.sum(axis=0)
        return log_p, d_states, grads

    def learn(self, stream: np.ndarray, rate: float, squares: dict) -> None:
        """One pass of truncated backpropagation over a stream of documents (model ids, each ended by END), in lanes; AdaGrad. Every
        token is predicted once: the last lane is filled up with -1, which is not. A lane that begins inside a document takes the
        state that the BURN_IN tokens before it lead to."""
        lanes = max(1, min(LANES, len(stream) // 64))
        steps = -(-len(stream) // lanes)
        y = np.append(stream, np.full(lanes * steps - len(stream), -1, stream.dtype)).reshape(lanes, steps).T
        # What each step reads: the token before, back to BURN_IN before a lane's first.
        padded = np.concatenate([np.full(BURN_IN + 1, END, stream.dtype), stream, np.full(lanes * steps - len(stream), END, stream.dtype)])
        at = np.arange(lanes) * steps
        early = padded[at[None, :] + np.arange(BURN_IN)[:, None]]
        h = self.run(early, (early != END).astype(np.float32), np.zeros((lanes, HIDDEN), np.float32))[-1]
        x = padded[at[None, :] + BURN_IN + np.arange(steps)[:, None]]
        keep = (x != END).astype(np.float32)
        for t in range(0, steps, WINDOW):
            h = self._step(x[t : t + WINDOW], y[t : t + WINDOW], keep[t : t + WINDOW], h, rate, squares)

    def _step(self, x, y, keep, h, rate, squares) -> np.ndarray:
        p, n, trace = self.p, HIDDEN, []
        states = self.run(x, keep, h, trace)
        real = y.reshape(-1) >= 0
        if real.all():
            _, d, grads = self.predict(states.reshape(-1, n), y.reshape(-1), True)
        else:
            d = np.zeros((y.size, n), np.float32)
            _, d[real], grads = self.predict(states.reshape(-1, n)[real], y.reshape(-1)[real], True)
        d = d.reshape(states.shape)
        da = np.empty((*x.shape, 3 * n), np.float32)
        carry = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, rh, new = trace[t]
            dh = d[t] + carry
            dn = dh * (1 - z) * (1 - new * new)
            drh = dn @ p["un"].T
            g = da[t]
            g[:, :n] = dh * (before - new) * z * (1 - z)
            g[:, n : 2 * n] = drh * before * r * (1 - r)
            g[:, 2 * n :] = dn
            carry = (dh * z + drh * r + g[:, : 2 * n] @ p["u"].T) * keep[t][:, None]
        all_h = np.concatenate([s[0] for s in trace])
        all_rh = np.concatenate([s[3] for s in trace])
        flat = da.reshape(-1, 3 * n)
        grads["u"], grads["un"] = all_h.T @ flat[:, : 2 * n], all_rh.T @ flat[:, 2 * n :]
        ids = x.reshape(-1)
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        touched = ids[order][starts]
        gx = np.add.reduceat(flat[order], starts, axis=0)
        scale = np.float32(1 / np.sqrt(max(real.sum(), 1)))
        gx *= scale
        squares["x"][touched] += gx * gx
        p["x"][touched] -= rate * gx / np.sqrt(squares["x"][touched])
        for name, g in grads.items():
            g *= scale
            squares[name] += g * g
            p[name] -= rate * g / np.sqrt(squares[name])
        return states[-1]

    def squares(self) -> dict:
        return {n: np.full_like(v, 1e-2) for n, v in self.p.items()}

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each document (ids[first[k]:first[k + 1]], END included): documents are dealt to lanes, longest first,
        so that lanes are about even; the state restarts with each document."""
        sizes = np.diff(first)
        out = np.zeros(len(sizes))
        if not len(sizes):
            return out
        longest = int(sizes.max())
        lanes = max(1, min(LANES, int(sizes.sum()) // max(longest, 64)))
        fill: list[tuple[int, int]] = [(0, k) for k in range(lanes)]
        import heapq

        where: list[list[int]] = [[] for _ in range(lanes)]
        for k in np.argsort(-sizes, kind="stable").tolist():
            used, lane = fill[0]
            where[lane].append(k)
            heapq.heapreplace(fill, (used + int(sizes[k]), lane))
        streams = [np.concatenate([ids[first[k] : first[k + 1]] for k in w]) for w in where]
        docs = [np.repeat(w, sizes[w]) for w in where]
        by_length = np.argsort([-len(s) for s in streams], kind="stable")
        streams, docs = [streams[k] for k in by_length], [docs[k] for k in by_length]
        lengths = np.array([len(s) for s in streams])
        y = np.full((lengths[0], lanes), -1, np.int32)
        d = np.zeros((lengths[0], lanes), np.int32)
        for k, (s, w) in enumerate(zip(streams, docs, strict=True)):
            y[: len(s), k], d[: len(s), k] = s, w
        x = np.vstack([np.full((1, lanes), END, np.int32), y[:-1]])
        keep = (x != END).astype(np.float32)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, len(y), WINDOW):
            alive = int(np.searchsorted(-lengths, -t, "left"))
            part = slice(t, t + WINDOW)
            states = self.run(np.maximum(x[part, :alive], 0), keep[part, :alive], h[:alive])
            h = states[-1]
            real = y[part, :alive] >= 0
            log_p, _, _ = self.predict(states[real], y[part, :alive][real], False)
            out += np.bincount(d[part, :alive][real], log_p, minlength=len(out))
        return out / np.log(10)


def _buffers(batches: Iterator[pa.RecordBatch], words: Words, training: bool):
    """Parts of about HELD tokens: (doc ids, model ids, positions among frequent words, hashes, first). training: no held-out rows."""
    parts: list = []
    total = 0

    def joined():
        docs = [d for p in parts for d in p[0]]
        cuts = np.cumsum([0, *(len(p[1]) for p in parts)])
        first = np.concatenate([*(p[4][:-1] + c for p, c in zip(parts, cuts, strict=False)), [cuts[-1]]]).astype(np.int64)
        return docs, *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)), first

    for batch in batches:
        if training:
            batch = batch.filter(pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()], pa.bool_()))
        for part in slices(batch, "text"):
            h, first = tokens(FlatTexts.of(part.column("text")))
            model, at = words.ids(h)
            parts.append((part.column("doc_id").to_pylist(), model, at, h, first))
            total += len(h)
            if total >= HELD:
                yield joined()
                parts, total = [], 0
    if parts:
        yield joined()


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash as a signed long), n: counts over the training documents; the end of a text counts as a word."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        size = 0

        def merged():
            words, n = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            uniq, back = np.unique(words, return_inverse=True)
            return uniq, np.bincount(back, n, minlength=len(uniq)).astype(np.int64)

        def out(words, n):
            return pa.record_batch({"word": pa.array(words.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            batch = batch.filter(pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()], pa.bool_()))
            for part in slices(batch, "text"):
                h, _ = tokens(FlatTexts.of(part.column("text")))
                kept.append(np.unique(h, return_counts=True))
                size += len(kept[-1][0])
                if size > 2_000_000:
                    kept = [merged()]
                    size = len(kept[0][0])
                    if size > 1_500_000:
                        yield out(*kept[0])
                        kept, size = [], 0
        if kept:
            yield out(*merged())

    return docs.select("doc_id", "text").mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def collect_words(counts: DataFrame) -> Words | None:
    """None without training documents. The frequent words are FREQUENT at most, whatever the corpus."""
    n, v = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not n:
        return None
    least = max(1, -(-n // FREQUENT))
    end = int(np.array([END_HASH]).view(np.int64)[0])
    got = counts.where((F.col("n") >= least) | (F.col("word") == end)).toPandas()
    return Words(int(n), int(v), got["word"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64))


def _averaged(replicas: DataFrame, size: int) -> np.ndarray:
    """Mean of the parameters by tokens: sums of FAN_IN replicas at a time, until few are left for the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens_, least = np.zeros(size), 0, None
        for batch in batches:
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in ("replica", "tokens", "params")), strict=True):
                total += np.frombuffer(raw, np.float64)
                tokens_ += n
                least = k if least is None else min(k, least)
        if tokens_:
            yield pa.record_batch({"replica": pa.array([least], pa.int64()), "tokens": pa.array([tokens_], pa.int64()), "params": pa.array([total.tobytes()], pa.binary())})

    n = replicas.count()
    while n > FAN_IN:
        parts = -(-n // FAN_IN)
        replicas = staged(replicas.repartition(parts).mapInArrow(summed, "replica long, tokens long, params binary"), "replicas")
        n = replicas.count()
    rows = sorted(replicas.collect(), key=lambda r: r.replica)
    return sum(np.frombuffer(r.params, np.float64) for r in rows) / sum(r.tokens for r in rows)


def train(docs: DataFrame, words: Words) -> np.ndarray:
    """The model's parameters."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(words)
    rows = docs.select("doc_id", "text")
    size = len(Gru(words).flat())

    def replica(start, rate):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Gru(held.value, start.value if start else None)
            squares, n = model.squares(), 0
            for _, ids, _, _, _ in _buffers(batches, held.value, True):
                model.learn(ids, rate, squares)
                n += len(ids)
            if n:
                yield pa.record_batch({"replica": pa.array([TaskContext.get().partitionId()], pa.int64()), "tokens": pa.array([n], pa.int64()), "params": pa.array([(model.flat().astype(np.float64) * n).tobytes()], pa.binary())})

        return run

    schema = "replica long, tokens long, params binary"
    warm = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(WARM_PART)) == 0)
    first = staged(warm.mapInArrow(replica(None, RATE_WARM), schema), "warm")
    start = _averaged(first, size) if first.count() else Gru(words).flat().astype(np.float64)
    return _averaged(staged(rows.mapInArrow(replica(sc.broadcast(start), RATE), schema), "replicas"), size)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text; others are dropped).

    A null text is empty: its end is its only token. A row without id is a training row. Without training rows both scores are the
    base's. Repeated rows stay, and count as often in training.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = staged(count_words(docs), "counts")
    words = collect_words(counts)
    params = train(docs, words) if words else None
    held = spark.sparkContext.broadcast((words, params))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, params = held.value
        base, seen = TaskContext.get().partitionId() << 40, 0
        if words is None:
            words = Words(0, 0, np.array([END_HASH]), np.zeros(1, np.int64))
        model = Gru(words, params)
        log_counts = np.log10(words.counts + 1.0)
        for ids, model_ids, at, h, first in _buffers(batches, words, False):
            n = len(ids)
            row = np.repeat(np.arange(n), np.diff(first))
            total = lambda w, where: np.bincount(row[where], w, minlength=n)  # noqa: B023, E731
            common, outside, rare = at >= 0, model_ids == words.size, at < 0
            gru = model.score(model_ids, first) if words.n else np.zeros(n)
            gru += total(log_counts[at[outside & common]], outside & common)
            # Distinct rare words of each row.
            r, w = row[rare], h[rare]
            order = np.lexsort((w, r))
            r, w = r[order], w[order]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])][: len(r)])
            times = np.diff(np.append(new, len(r)))
            cuts = np.searchsorted(r[new], np.arange(n + 1)).astype(np.int32)
            yield pa.record_batch({
                "row": pa.array(base + seen + np.arange(n)),
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array([held_out(i) for i in ids], pa.bool_()),
                "n_tokens": pa.array(np.diff(first)),
                "known": pa.array(total(None, common & (words.counts[at] > 0)).astype(np.int64)),
                "outside": pa.array(total(None, outside).astype(np.int64)),
                "common_log": pa.array(total(log_counts[at[common]], common)),
                "gru": pa.array(gru),
                "rare": pa.ListArray.from_arrays(cuts, pa.array(w[new].view(np.int64))),
                "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
            })
            seen += n

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, outside long, common_log double, gru double, rare array<long>, times array<int>"
    per = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema), "scores")
    n, v, z = (words.n, words.v, float(words.z)) if words else (0, 0, 1.0)
    least = max(1, -(-n // FREQUENT))
    each = per.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = each.join(counts.where(F.col("n") < least), "word")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("times").alias("rare_known"))
    full = per.drop("rare", "times").join(sums, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("common_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    score = F.col("gru") + rare_log - F.col("outside") * F.log10(F.lit(z)) if n else base
    return full.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))

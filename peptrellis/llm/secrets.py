"""Secret scans: candidates from text, judged by a random forest that removes false positives.

Candidates are runs of letters, digits, + / _ - of 12 characters or more that hold a digit or are all upper case; whatever has the
format of a well-known key or is a private key block, inside a run or not; and values of four characters or more assigned to a name
with a secret's word, whatever their characters. Candidates that overlap are one. Features: its length and character classes, how
likely its character transitions are in the corpus, how much of it dictionary words cover, the path it comes from, and the words
beside it. The forest is trained on labelled findings; what has a well-known format is a secret in any case.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_text
from .common import LETTERS, LOWER, FlatTexts, byte_set, least_by_hash, map_texts, staged

MIN_LENGTH = 12
BODY = byte_set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
#: Labelled findings that the forest is trained on at most: those with the least hash of document and position.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF, SECRET = 30, 8, 32, 5, 0.5
MASK = "[SECRET]"

#: Formats of well-known keys; words of secrets' names; names of other long strings; paths of tests.
KEY_FORMATS = [
    r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36}", r"xox[abp]-[0-9A-Za-z-]{10,}", r"[sr]k_live_[0-9A-Za-z]{16,}", r"AIza[0-9A-Za-z_-]{35}", r"glpat-[0-9A-Za-z_-]{20}", r"npm_[0-9A-Za-z]{36}",
    r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]|-(?!----))*-----END [A-Z ]{0,20}PRIVATE KEY-----",
]
SECRET_WORDS = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "auth", "credential", "bearer")
OTHER_WORDS = ("sha", "commit", "uuid", "isbn", "phone", "order", "card", "account", "id", "page", "version", "build")
TEST_PATHS = re.compile(r"(?i)(^|[/_.-])(test|tests|example|examples|sample|doc|docs|fixture|mock)([/_.-]|$)")
_KEY = re.compile("|".join(KEY_FORMATS).encode())
_NAME = re.compile(rb"(?i)(?:" + "|".join(SECRET_WORDS).encode() + rb")[a-z0-9_-]*[\"']?[ \t]*$")
_VALUE = re.compile(rb"[ \t]*[\"'`]?([^\s\"'`]{4,})")
_OTHER_NAME = re.compile(r"(?i)(?:^|[^a-z])(?:" + "|".join(OTHER_WORDS) + r")[a-z0-9_]*\W{0,4}$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_NUMBER = re.compile(r"[\d\W_TZ]+")
#: Hexadecimal digits as long as keys are, with letters and digits, and what stands before a value.
_HEX_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{16,}|[0-9A-F]{16,})")
_ASSIGNED = re.compile(r"[=:][ \t]*[\"'`]?$")
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "distinct", "entropy", "transitions", "dictionary", "test_path", "path_depth", "secret_word", "other_word")


def dictionary(path: str) -> frozenset[str]:
    """Lower-case words of three letters or more in a tokenizer's vocabulary (a bounded, published word list)."""
    import json

    words = (w.lstrip("Ġ").lower() for w in json.loads(tokenizer_text(path))["model"]["vocab"])
    return frozenset(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha())


def transitions(docs: DataFrame) -> np.ndarray:
    """log of the share of each lower-cased byte after each other one, inside words of all texts (256 x 256)."""

    def counts(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        data = LOWER[flat.data]
        both = np.flatnonzero(LETTERS[data[:-1]] & LETTERS[data[1:]]) if len(data) else np.zeros(0, np.int64)
        n = np.bincount(data[both].astype(np.int64) * 256 + data[both + 1], minlength=1)
        some = np.flatnonzero(n)
        return pa.record_batch({"pair": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    table = np.ones((256, 256))
    for r in map_texts(docs.select("text"), counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair // 256, r.pair % 256] += r.n
    return np.log(table / table.sum(axis=1, keepdims=True))


def _coverage(word: str, words: frozenset[str]) -> float:
    k = covered = 0
    while k < len(word):
        for end in range(min(len(word), k + 12), k + 2, -1):
            if word[k:end] in words:
                covered += end - k
                k = end
                break
        else:
            k += 1
    return covered / len(word)


@dataclass
class Context:
    """What the features need besides the text."""

    steps: np.ndarray
    words: frozenset[str]

    def features(self, found: bytes, before: str, path: str) -> list[float]:
        n, text = len(found), found.decode("utf-8", "ignore")
        codes = LOWER[np.frombuffer(found, np.uint8)].astype(np.int64)
        counts = np.bincount(codes)
        share = counts[counts > 0] / n
        near = re.findall(r"[a-z]+", before.lower())[-3:]
        return [
            float(n), sum(c.isdigit() for c in text) / n, sum(c.isupper() for c in text) / n, sum(c.islower() for c in text) / n, sum(not c.isalnum() for c in text) / n,
            len(share) / n, float(-(share * np.log2(share)).sum()),
            float(self.steps[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0, _coverage(text.lower(), self.words),
            float(bool(TEST_PATHS.search(path))), float(path.count("/")),
            float(any(w in x for x in near for w in SECRET_WORDS)), float(any(x == w for x in near for w in OTHER_WORDS)),
        ]


def _runs(flat: FlatTexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of long runs that may be keys, and their rows."""
    starts, ends, first = flat.runs(BODY)
    row = np.repeat(np.arange(flat.n), np.diff(first))
    long = ends - starts >= MIN_LENGTH
    starts, ends, row = starts[long], ends[long], row[long]
    if not len(starts):
        return starts, ends, row
    digit = np.concatenate([[0], np.cumsum((flat.data >= 48) & (flat.data <= 57))])
    upper = np.concatenate([[0], np.cumsum((flat.data >= 65) & (flat.data <= 90))])
    keep = (digit[ends] > digit[starts]) | (upper[ends] - upper[starts] == ends - starts)
    return starts[keep], ends[keep], row[keep]


def candidates(flat: FlatTexts) -> list[tuple[int, int, int, bool]]:
    """(row, byte start, byte end, whether a well-known format is in it) of all candidates, in order; none overlap."""
    raw = flat.data.tobytes()
    found = [(r, a, b, False) for a, b, r in zip(*(x.tolist() for x in _runs(flat)), strict=True)]
    for r, (lo, hi) in enumerate(zip(flat.offsets[:-1].tolist(), flat.offsets[1:].tolist(), strict=True)):
        found += [(r, *m.span(), True) for m in _KEY.finditer(raw, lo, hi)]
    marks = np.flatnonzero((flat.data == ord("=")) | (flat.data == ord(":")))
    rows = np.searchsorted(flat.offsets, marks, "right") - 1
    for r, at in zip(rows.tolist(), marks.tolist(), strict=True):
        if _NAME.search(raw, max(int(flat.offsets[r]), at - 48), at) and (m := _VALUE.match(raw, at + 1, int(flat.offsets[r + 1]))):
            a, b = m.span(1)
            b = a + len(raw[a:b].rstrip(b",;)]}>."))
            if b - a >= 4:
                found.append((r, a, b, False))
    out: list[tuple[int, int, int, bool]] = []
    for r, a, b, known in sorted(found):
        if out and out[-1][0] == r and a < out[-1][2]:
            out[-1] = (r, out[-1][1], max(b, out[-1][2]), known or out[-1][3])
        else:
            out.append((r, a, b, known))
    return out


def findings(docs: DataFrame, context: Context) -> DataFrame:
    """doc_id, start, length (characters), known_format, label (see label_of), features, for each candidate of each row of docs
    (doc_id, text, source as the path)."""
    held = docs.sparkSession.sparkContext.broadcast(context)

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        ids, paths = part.column("doc_id").to_pylist(), part.column("source").to_pylist()
        out = [(ids[r], s, n, f, y, x) for r, s, n, f, y, x in _described(flat, held.value, paths)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.float64()))
        return pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "length", "known_format", "label", "features"])

    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source), rows, "doc_id long, start long, length long, known_format boolean, label int, features array<double>")


def label_of(found: str, before: str, known: bool, coverage: float) -> int | None:
    """A finding's label by form and name: 1 for well-known formats and for assigned hexadecimal digits of a key's length; 0 for numbers
    and times, UUIDs, dictionary words, and what is named otherwise (a commit, an account); None (not learnt from) for the rest. Coverage
    and other names are features too; transitions, entropy, path and secret names are not looked at here."""
    if known:
        return 1
    if _NUMBER.fullmatch(found) or _UUID.fullmatch(found) or coverage >= 0.6 or _OTHER_NAME.search(before) or found.isalpha() and found.isupper():
        return 0
    return 1 if _HEX_KEY.fullmatch(found) and _ASSIGNED.search(before) else None


def _described(flat: FlatTexts, context: Context, paths: list):
    """(row, start and length in characters, known format, label, features) of each candidate."""
    raw = flat.data.tobytes()
    seen, chars, byte = -1, 0, 0
    dictionary_at = FEATURES.index("dictionary")
    for r, a, b, known in candidates(flat):
        lo = int(flat.offsets[r])
        if r != seen:
            seen, chars, byte = r, 0, lo
        chars += len(raw[byte:a].decode("utf-8"))
        byte = a
        before = raw[max(lo, a - 48) : a].decode("utf-8", "ignore")
        text = raw[a:b].decode("utf-8")
        x = context.features(raw[a:b], before, paths[r] or "")
        yield r, chars, len(text), known, label_of(text, before, known, x[dictionary_at]), x


@dataclass
class Forest:
    """Decision trees over binned features as flat arrays: feature (-1: leaf), bin threshold, children, leaf probability."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, ...]]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, total = self.binned(x), np.zeros(len(x))
        for feature, cut, left, right, p in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = np.where(b[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += p[at]
        return total / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Forest:
    """A random forest: bootstrap rows, a random sqrt of the features at each split, Gini gain over binned thresholds."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    forest = Forest(edges, [])
    b, rng = forest.binned(x), np.random.default_rng(seed)
    tries = max(1, round(math.sqrt(x.shape[1])))
    for _ in range(TREES):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            me, p = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0, 0, 0, p])
            if depth == DEPTH or p in (0.0, 1.0) or len(rows) < 2 * MIN_LEAF:
                return me
            best = (1e-12, -1, 0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                n = np.cumsum(np.bincount(b[rows, f], minlength=BINS + 1))
                one = np.cumsum(np.bincount(b[rows, f], y[rows], minlength=BINS + 1))
                m, rest = n[-1] - n, one[-1] - one
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = one**2 / n + (n - one) ** 2 / n + rest**2 / m + (m - rest) ** 2 / m - (one[-1] ** 2 + (n[-1] - one[-1]) ** 2) / n[-1]
                gain[(n < MIN_LEAF) | (m < MIN_LEAF)] = -1
                k = int(np.nanargmax(gain))
                best = max(best, (float(gain[k]), int(f), k))
            if best[1] >= 0:
                goes = b[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1:]
                nodes[me][2] = split(rows[goes], depth + 1)
                nodes[me][3] = split(rows[~goes], depth + 1)
            return me

        split(rng.integers(0, len(y), len(y)), 0)
        flat = np.array(nodes)
        forest.trees.append((*(flat[:, k].astype(np.int64) for k in range(4)), flat[:, 4]))
    return forest


def train(labelled: DataFrame) -> Forest | None:
    """The forest; None without both classes. labelled: doc_id, start, features, label (0, 1; null is skipped)."""
    some = least_by_hash(labelled.where("label is not null").select("doc_id", "start", "features", "label"), ["doc_id", "start"], FIT_ROWS).collect()
    some.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start, r.features))
    x, y = np.array([r.features for r in some]), np.array([r.label for r in some], float)
    return grow(x, y) if len(set(y.tolist())) == 2 else None


def scan(docs: DataFrame, words: str) -> DataFrame:
    """doc_id, start, length (characters), known_format, p_secret, is_secret, for each candidate in each row of docs (doc_id, text,
    source; other columns are dropped). words: path of a tokenizer's file, for its words. Null and empty texts hold none; a null
    source is an empty path; a null doc_id stays null. Repeated rows give repeated findings. Without labelled findings of both classes only well-known
    formats are secrets."""
    found = staged(findings(docs, Context(transitions(docs), dictionary(words))), "findings")
    model = docs.sparkSession.sparkContext.broadcast(train(found))

    def rows(batches):
        for batch in batches:
            known = np.array(batch.column("known_format").to_pylist(), float)
            x = np.array(batch.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
            p = model.value.probability(x) if model.value else known
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "length", "known_format")), pa.array(p), pa.array((p >= SECRET) | (known > 0))], names=["doc_id", "start", "length", "known_format", "p_secret", "is_secret"])

    return found.mapInArrow(rows, "doc_id long, start long, length long, known_format boolean, p_secret double, is_secret boolean")


def masked(docs: DataFrame, words: str) -> DataFrame:
    """docs with each secret in its text replaced by MASK and n_chars, where it is a column, brought up to date. All rows and columns
    stay."""
    context = Context(transitions(docs), dictionary(words))
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    found = staged(findings(docs.select("doc_id", "text", source), context), "findings")
    held = docs.sparkSession.sparkContext.broadcast((context, train(found)))

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        context, forest = held.value
        found = list(_described(flat, context, part.column("source").to_pylist()))
        if not found:
            return part
        p = forest.probability(np.array([f[5] for f in found])) if forest else np.zeros(len(found))
        texts = part.column("text").to_pylist()
        cuts: dict[int, list] = {}
        for f, q in zip(found, p, strict=True):
            if q >= SECRET or f[3]:
                cuts.setdefault(f[0], []).append((f[1], f[1] + f[2]))
        sizes = part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else None
        for r, spans in cuts.items():
            for a, b in reversed(spans):
                texts[r] = texts[r][:a] + MASK + texts[r][b:]
            if sizes:
                sizes[r] = len(texts[r])
        names = part.schema.names
        columns = list(part.columns)
        columns[names.index("text")] = pa.array(texts, part.schema.field("text").type)
        if sizes:
            columns[names.index("n_chars")] = pa.array(sizes, part.schema.field("n_chars").type)
        return pa.record_batch(columns, names=names)

    return map_texts(docs, rows, docs.schema)

"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. Each round looks up all neighbouring pairs by binary search over the sorted
pair keys, finds the lowest rank in each word, and merges that pair's occurrences, left to right, in all words at once.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import FlatTexts, Remembered, map_texts

#: Unicode white space, and the published pre-tokenisation pattern of byte-level BPE over it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: No token crosses from a character that isn't white space to one that is: such chunks are encoded on their own.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Chunks that a worker remembers in a generation.
REMEMBERED = 120_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """A byte-level BPE model from the text of a tokenizers file (no normaliser; byte-level pre-tokeniser and decoder)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys, kind="stable").astype(np.int64)
        self.keys = keys[self.ranks]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        to_byte = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.split = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.seen = Remembered(REMEMBERED)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (not empty)."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        none = len(self.made)
        while True:
            inner = np.zeros(len(ids), bool)
            inner[:-1] = word[1:] == word[:-1]
            key = ids << 32
            key[:-1] |= ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(inner & (self.keys[at] == key), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            # Words without a pair to merge are done and leave the array.
            done = least == none
            spans = np.diff(np.r_[starts, len(ids)])
            for k in np.flatnonzero(done):
                out[word[starts[k]]] = ids[starts[k] : starts[k] + spans[k]]
            if done.all():
                return out
            hit = np.flatnonzero(rank == np.repeat(np.where(done, -1, least), spans))
            # In a row of overlapping occurrences (aaaa) every second one merges.
            fresh = np.r_[True, np.diff(hit) != 1]
            begin = np.flatnonzero(fresh)
            nth = np.arange(len(hit)) - np.repeat(begin, np.diff(np.r_[begin, len(hit)]))
            hit = hit[nth % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.repeat(~done, spans)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        parts = [PIECES.findall(c) for c in chunks]
        new = list({p for ps in parts for p in ps})
        ids = {p: i.astype("<u4").tobytes() for p, i in zip(new, self.merge([p.encode("utf-8") for p in new]), strict=True)}
        return {c: b"".join(map(ids.__getitem__, ps)) for c, ps in zip(chunks, parts, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Special tokens' strings in a text become their ids."""
        split = [re.split(f"({self.split})", t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        parts = [p for s in split for p in s[::2]]
        ids = iter(self.seen.values([CHUNKS.findall(p) for p in parts], self._learn))
        return [b"".join(np.uint32(self.special[p]).tobytes() if k % 2 else next(ids) for k, p in enumerate(s)) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids; bytes that are no UTF-8 become U+FFFD."""
        n = self.lengths[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        raw = self.blob[at].tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode("utf-8")
        return raw


_loaded: dict[int, Bpe] = {}


def _model(text: str) -> Bpe:
    """The model of a tokenizers file's text; a worker keeps the last one for its next tasks."""
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(text)
    return _loaded[key]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' keep columns, with ids_bytes (little-endian unsigned 32-bit ids of the whole text) and decoded (text of those ids).

    docs needs a text column; a null text is empty and has no ids. Other columns are dropped.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        model = _model(spec.value)
        ids = model.encode([t or "" for t in part.column("text").to_pylist()])
        flat_ids = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        cuts = np.cumsum([0, *(len(i) // 4 for i in ids)])
        texts = [model.decode(flat_ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch({k: part.column(k) for k in keep} | {"ids_bytes": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.binary()).cast(pa.string())})

    picked = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in keep)
    return map_texts(picked, rows, f"{schema}, ids_bytes binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text; other columns are dropped).

    A null or empty text has no tokens and the digests of nothing. Repeated rows give repeated rows; a null doc_id stays null. The
    strings of special tokens in a text become their ids, as the library has it."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def rows(part: pa.RecordBatch, flat: FlatTexts) -> pa.RecordBatch:
        model = _model(spec.value)
        ids = model.encode([t or "" for t in part.column("text").to_pylist()])
        texts = [model.decode(np.frombuffer(i, "<u4").astype(np.int64)) for i in ids]
        return pa.record_batch({"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids], "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})

    return map_texts(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

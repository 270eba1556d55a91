"""BPE and ORC token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("peptrellis.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from peptrellis.llm import bpe, orcids  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab' \n\t\r\x0b\x1c\x1d\x85\xa0 　éß中文字😀👩‍ñ12½٣!?,.<|>́​ "
ODD = ["", "aaaaaaa aaaa", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "  a  b   ", "\n\n\nabc\n\n", "it's don't we'll I'M", " " * 500 + "x", "a" * 3000, "ΑΣ İ ǅ", "é ́x <|startoftext|>"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    own, library = bpe.Bpe(bpe.tokenizer_text(BYTE)), Tokenizer.from_file(BYTE)
    want = library.encode_batch(texts(), add_special_tokens=False)
    for text, ids, e in zip(texts(), own.encode(texts()), want, strict=True):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == e.ids, text
        assert own.decode(got.astype(np.int64)).decode() == library.decode(e.ids, skip_special_tokens=False)


def test_broken_utf8_decodes_as_the_library_does():
    from tokenizers import Tokenizer

    own, library = bpe.Bpe(bpe.tokenizer_text(BYTE)), Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(4)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(1, 12))
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_words_apart_equal_whole_texts():
    from tokenizers import Tokenizer

    own, library = orcids.WordEncoder(bpe.tokenizer_text(WORD)), Tokenizer.from_file(WORD)
    rng = random.Random(7)
    case = lambda t: "".join(rng.choice((c.lower(), c.upper())) for c in t)
    special = [rng.choice(("", "b", "B,", "x|")) + case(rng.choice(("<|startoftext|>", "<|endoftext|>"))) + rng.choice(("", " b", "é.", "H\u0331", ",")) for _ in range(300)]
    marks = ["".join(rng.choice("aBz'sS9|<>.,;:!?&$*#-_ é") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    every = [*texts(), *special, *marks, "Lorem, IPSUM don't. " * 100_000, "H\u0331 h\u0331 E\u0301, \u212a", None]
    ids, cuts = own.encode(pa.array(every, pa.string()))
    for k, (text, e) in enumerate(zip(every, library.encode_batch([t or "" for t in every], add_special_tokens=False), strict=True)):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == e.ids, (text or "")[:100]


def test_a_full_memory_starts_anew(monkeypatch):
    own = orcids.WordEncoder(bpe.tokenizer_text(WORD))
    want = own.encode(pa.array(texts()))
    monkeypatch.setattr(orcids, "REMEMBERED", 3)
    for _ in range(2):
        for got, full in zip(own.encode(pa.array(texts())), want, strict=True):
            assert np.array_equal(got, full)


def test_digests_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello wörld", "z"), (3, "Hello wörld", "z"), (None, "a", "b")], "doc_id long, text string, ids_sha256 string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.digests(df, BYTE).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [(i, d) for i, _, d in got] == [(0, sha("a")), (1, sha("")), (2, sha("")), (3, sha("Hello wörld")), (3, sha("Hello wörld"))]
    assert [n for _, n, _ in got][1:3] == [0, 0]
    assert bpe.digests(df.limit(0), BYTE).collect() == []
    full = bpe.encoded(df, BYTE, keep=("doc_id", "ids_sha256")).where("doc_id = 3").first()
    assert full.decoded == "Hello wörld" and full.ids_sha256 == "z"


def test_orc_files_hold_the_ids_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = [(None, "null <|ENDOFTEXT|> id"), *enumerate(texts()[:400]), (500, None), (500, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(7)
    path = str(tmp_path / "ids")
    orcids.write_tokens(df, path, WORD, 1)
    got = orcids.token_digests(spark, path).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = orcids.read_tokens(spark, path, F.col("doc_id") == 9)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1
    empty = str(tmp_path / "none")
    orcids.write_tokens(df.limit(0), empty, WORD, 1)
    assert orcids.token_digests(spark, empty).count() == 0

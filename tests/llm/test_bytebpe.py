"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import bytebpe, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [(1, None), (2, ""), (3, "a<|endoftext|>b <|endoftext|>"), (4, "  x\n\n y\t"), (5, "Ω՘꭬é'll don't   x'S"), (6, "日本語 1234 😀😀 𝕏𝟙 𐐀"), (7, "\x00\x1c a\x85b 　c"), (8, "word " * 50_000), (8, "other"), (None, "null id"), (4, "  x\n\n y\t"), (9, "a" * 30_000), (10, " " * 3000 + "x"), (11, "𐍈" * 3000)]


@pytest.fixture(scope="module")
def own():
    return bytebpe.known(queries.vocabulary_path("byte_bpe_50k.tiktoken"), PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(queries.vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(docs_of, library):
    path = queries.vocabulary_path("byte_bpe_50k.tiktoken")
    rows = ODD + [(100 + k, "same text in many rows") for k in range(500)]
    coded = bytebpe.encode(docs_of(rows), path, PATTERN)
    got = sorted(((r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4")), bytes(r.decoded)) for r in coded.collect()), key=str)
    want = [(i, (t or ""), library.encode_ordinary(t or "")) for i, t in rows]
    assert got == sorted(((i, len(ids), tuple(ids), t.encode()) for i, t, ids in want), key=str)
    back = sorted(((r.doc_id, bytes(r.raw), r.text) for r in bytebpe.decode(coded, path, PATTERN).collect()), key=str)
    assert back == sorted(((i, t.encode(), t) for i, t, _ in want), key=str)
    assert bytebpe.encode(docs_of([]), path, PATTERN).count() == 0


def test_query(spark, sf, library):
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_pieces_and_offsets(own, library):
    r = random.Random(1)
    letters = [*"aab  '''stremvld  \n\n\t\r\x0b\x1c\x85\xa0 12\xb2١.,!-éßçñЖ中文ǅ́　😀𝕏𐐀🏽‍", "'re", "'ll", "'s", " '", "<|endoftext|>"]
    for _ in range(300):
        rows = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(6)] + [None, ""]
        pieces, count = own.pieces(pa.array(rows, pa.string()))
        flat, at = pieces.to_pylist(), 0
        for text, n in zip(rows, count, strict=True):
            assert flat[at : at + n] == ([p for p, _ in own.split.pre_tokenize_str(text)] if text else [])
            at += n
        ids = [library.encode_ordinary(t or "") for t in rows]
        found = bytebpe._rows(own, pa.array(range(8)), np.array(sum(ids, []), np.uint32), np.array([len(x) for x in ids]))
        for text, one, starts, split in zip(rows, ids, found.column(3).to_pylist(), found.column(4).to_pylist(), strict=True):
            assert np.frombuffer(starts or b"", "<u4").tolist() == library.decode_with_offsets(one)[1]
            texts = bytebpe.token_texts(own, np.array(one, np.int64))
            assert "".join(texts) == (text or "")
            assert split == sum((library.decode_single_token_bytes(i)[0] & 0xC0) == 0x80 for i in one)


def test_token_that_no_merge_makes():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4}
    assert bytebpe.halves(b"abc", ranks) is None and bytebpe.halves(b"ab", ranks) == (b"a", b"b")


def test_unknown_id(own):
    with pytest.raises(ValueError):
        own.decode(np.array([50_256]))

import os
import random
import struct

import pytest
import sentencepiece

from cohort.llm import pieces
from cohort.llm.registry import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file here")


def fields(raw, lo=0, hi=None):
    """(number, wire type, start of value, end of value) of a protocol buffer message."""
    hi = len(raw) if hi is None else hi
    while lo < hi:
        tag, lo = pieces._varint(raw, lo)
        if tag & 7 == 2:
            size, lo = pieces._varint(raw, lo)
            yield tag >> 3, 2, lo, lo + size
            lo += size
        elif tag & 7 == 0:
            start = lo
            _, lo = pieces._varint(raw, lo)
            yield tag >> 3, 0, start, lo
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, tag & 7, lo, lo + size
            lo += size


def as_unigram(raw):
    """The same pieces as a unigram model with small scores, whose sums 32 bits hold exactly."""
    out, rank = bytearray(raw), 0
    for n, _, a, z in fields(raw):
        if n == 1:
            for m, _, b, _ in fields(raw, a, z):
                if m == 2 and struct.unpack("<f", raw[b : b + 4])[0] != 0:
                    rank += 1
                    out[b : b + 4] = struct.pack("<f", -1.0 - (rank * 2654435761 % 64) / 8)
        elif n == 2:
            for m, _, b, _ in fields(raw, a, z):
                if m == 3:
                    out[b] = pieces.UNIGRAM
    return bytes(out)


@pytest.fixture(scope="module")
def raw():
    with open(PIECES, "rb") as f:
        return f.read()


def samples(n, seed):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "a", "in", "\U0001f600", "é", "\n", "\t", "中", "▁", "ing", "tion", "AB", "12", "...", "$$$", "\x00", " under", "\u00df", "x" * 9]
    return ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(n)]


def test_merges_equal_the_library(raw):
    lib, ours = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Vocabulary(raw=raw)
    assert ours.kind == pieces.BPE
    for t in samples(3000, 1):
        ids = lib.encode(t)
        assert ours.encode(t) == ids and ours.count(t) == len(ids) and ours.decode(ids) == lib.decode(ids)


def test_viterbi_equals_the_library(raw):
    model = as_unigram(raw)
    lib, ours = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Vocabulary(raw=model)
    assert ours.kind == pieces.UNIGRAM
    for t in samples(3000, 2):
        ids = lib.encode(t)
        assert ours.encode(t) == ids and ours.count(t) == len(ids)


def test_merges_by_definition(raw):
    ours = pieces.Vocabulary(raw=raw)
    rng = random.Random(4)
    for _ in range(300):
        chunk = "▁" + "".join(rng.choices("etaoinshr.,", k=rng.randint(1, 12)))
        assert [ours.pieces[i] for i in ours.solve(chunk)] == ours.merged(chunk)


def test_memo_generations(raw, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 5)
    ours, lib = pieces.Vocabulary(raw=raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ["one two three four", "five six seven one", "two two eight", "nine ten one"] * 3:
        assert ours.encode(t) == lib.encode(t) and ours.count(t) == len(lib.encode(t))


def test_documents(spark):
    long = "word and more " * 40_000
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (None, "x", 6), (2, None, 7), (3, "", 8), (4, long, 9), (5, " lead \n tail ", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = pieces.encode_documents(df, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len(lib.encode(t or ""))) for i, t, _ in rows)
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in out)
    counts = pieces.count_documents(df, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_chars) for r in counts) == sorted((str(i), len(lib.encode(t or "")), len(t or "")) for i, t, _ in rows)
    back = pieces.decode_documents(pieces.encode_documents(df, PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    odd = spark.createDataFrame([(1, [1, 2, None, -4, 10**6, 15043]), (2, None)], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode_documents(odd, PIECES).collect())) == [(1, lib.decode([15043])), (2, None)]
    for f in (pieces.encode_documents, pieces.count_documents):
        assert f(df.limit(0), PIECES).count() == 0

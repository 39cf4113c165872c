import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from cohort.llm import fim, registry

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FOLDER = os.environ.get("COHORT_TEST_TABLES", "/root/testdata/sf0.001")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, rate=50, first=80):
    """The contract, word for word, on one text."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < first else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def odd_texts():
    long = "a" * (fim.PIECE_CHARS * 2 + 5) + " x" * (fim.PIECE_UNITS * 3) + "  "
    texts = [None, "", " ", "\t\n", "one", "a <P> b", "a<S>", "<M>", "<P", "ü é\n 😀 z " * 300, " lead", "trail ", long, "\x0b\x0c\r word with no break"]
    return [(i + 40 * k, t) for k in range(6) for i, t in enumerate(texts)]


def test_equals_plain_version(spark):
    rows = odd_texts() + [(None, "x y z"), (2**60 + 1, "big id"), (7, "same id"), (7, "same id")] + [(5, "again and again")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "place": F.lit("x"), "piece": F.lit(None).cast("string")})
    got = sorted((tuple(r) for r in fim.fim_digests(docs).collect()), key=str)
    assert got == sorted((plainly(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert all(r[6] == sha(t or "") for r, (_, t) in zip(sorted(got, key=str), sorted(rows, key=lambda r: str(plainly(*r))), strict=True))


def test_texts_and_restoring(spark):
    docs = spark.createDataFrame(odd_texts(), "doc_id long, text string").withColumn("output_form", F.lit("old"))
    out = fim.fim_texts(docs, fim.Fim(rate=100, suffix_first=50))
    assert out.columns == ["doc_id", "text", "output_form", "output"]
    rows = out.collect()
    assert {r.output_form for r in rows} == {"plain", "spm", "psm"}
    assert all(fim.restore(r.output, r.output_form) == r.text for r in rows)
    assert all(sha(r.output or "") == plainly(r.doc_id, r.text, 100, 50)[5] for r in rows)


def test_pieces_are_small():
    chosen = fim.Fim(rate=100)
    for doc_id, text in odd_texts():
        ends, form, low, high = chosen.plan(text or "", doc_id)
        pieces = list(fim.pieces_of(text or "", ends, form, low, high))
        assert all(0 < len(p) <= fim.PIECE_CHARS and len(UNIT.findall(p)) <= fim.PIECE_UNITS + 1 for p in pieces)
        assert fim.restore("".join(pieces), form) == (text or "")


def test_empty_table_and_other_types(spark):
    docs = spark.createDataFrame([("x1", "a b c"), (None, None)], "key string, body string")
    assert fim.fim_digests(docs.limit(0), id_col="key", text_col="body").count() == 0
    got = fim.fim_digests(docs, id_col="key", text_col="body").collect()
    assert {r.key for r in got} == {"x1", None}


def test_one_shuffle(spark, capsys):
    fim.fim_digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = registry.op11_fill_in_middle(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(plainly(*r) for r in docs.collect())

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.llm import quality as q

WORDS = "the a of river stone green walk table light song paper cloud under bright".split()


def corpus(n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 120))
        junk = i % 4 == 0
        if junk:
            words = [[w.upper() + "!!" for w in words], [f"{w}###" for w in words], words[:1] * len(words)][i // 4 % 3]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(not junk)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    return df, y, held, q.fit(df, y.where(~held))


def test_held_out(spark, fitted):
    df, y, held, model = fitted
    rows = model.score(df, "text", "p").where(held).join(y, "doc_id").collect()
    assert len(rows) > 60 and sum((r.p >= q.THRESHOLD) == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_equals_brute_force(spark, fitted):
    """One text at a time, every voter by plain arithmetic; document frequencies from all texts."""
    df, _, _, model = fitted
    texts = [r.text for r in df.collect()]
    seen = sum((q.Terms()(t) > 0).astype(int) for t in texts)
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + seen)) + 1, rtol=1e-12)
    got = [r.p for r in model.score(df, "text", "p").collect()]
    for text, score in list(zip(texts, got, strict=True))[:60]:
        row = np.zeros(q.TERMS)
        for k, n in enumerate(q.Terms()(text)):
            row[k] = (1 + np.log(n)) * model.idf[k] if n else 0.0
        for part in (slice(0, q.WORD_TERMS), slice(q.WORD_TERMS, q.TERMS)):
            row[part] /= np.linalg.norm(row[part]) or 1.0
        z = row @ model.basis
        near = sorted(((float(z @ v / np.linalg.norm(z)), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        k = min(q.VOTERS, int(np.ceil(np.sqrt(len(near)))))
        votes = [(max(s, 0.0) ** q.POWER, y) for s, y in near if s >= near[k - 1][0] - q.TIE]
        assert score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-6)


def test_space_is_the_leading_singular_vectors(spark, fitted):
    df, y, held, model = fitted
    rows = [r.text for r in df.join(y, "doc_id").where(~held).collect()]
    x = q.weighted(rows, model.idf, q.Terms())
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(q.TOPICS, int((s > 1e-6 * s[0]).sum()))
    assert np.allclose(((x @ model.basis) ** 2).sum(), (s[:k] ** 2).sum(), rtol=1e-6)


def test_odd_texts(spark, fitted):
    df, _, _, model = fitted
    odd = [(None, None, "x"), (1, "", "x"), (2, " \n\t", "x"), (3, "river stone green walk " * 100_000, "x"), (3, "y" * 3_000_000, "x"), (4, "the a of river stone", "x"), (4, "the a of river stone", "x")]
    out = model.score(spark.createDataFrame(odd, df.schema), "text", "p")
    assert out.columns == ["doc_id", "text", "score", "p"]
    scores = [r.p for r in out.collect()]
    assert all(0.0 <= p <= 1.0 for p in scores) and scores[0] == scores[1] == scores[2] and scores[5] == scores[6]
    assert model.score(df.limit(0), "text", "p").count() == 0
    parts = list(q.stretches("ab cd " * 300_000))
    assert len(parts) == 2 and "".join(parts) == "ab cd " * 300_000


def test_few_labels(spark, fitted):
    df = fitted[0]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.p for r in q.fit(df, none).score(df, "text", "p").collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, None), (2, 7), (None, 0)], "doc_id long, quality int")
    assert {r.p for r in q.fit(df, odd).score(df, "text", "p").collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert all(0.0 <= r.p <= 1.0 for r in q.fit(df, both).score(df, "text", "p").collect())
    assert q.fit(df.limit(0), none).prior == 0.5


def test_bounded_sample_stands_for_all(spark, fitted):
    df, y, _, _ = fitted
    model = q.fit(df, y, fit_rows=60)
    assert len(model.vectors) == 60 and model.labels.sum() == 30
    assert model.prior == pytest.approx(0.75) and set(np.round(model.counts_for, 6)) == {round(100 / 30, 6), 10.0}


def test_forms():
    assert q.forms_of("And&&& x12-34 ÉTÉ") == "Aa&&& a0-0 A"
    terms = q.Terms()
    assert sorted(terms("a a a")[terms("a a a") > 0].tolist()) == [1, 2, 3, 3]
    assert (terms("word! words")[: q.WORD_TERMS] == terms("Word Wordy")[: q.WORD_TERMS]).all()
    signs = [frozenset(np.flatnonzero(terms(t)[q.WORD_TERMS :]).tolist()) for t in ("Ab&&&", "Xyz&", "ab&")]
    assert signs[0] == signs[1] != signs[2]


def test_stretches_change_nothing(monkeypatch):
    text = "Aa bb!! cc 12 Aa Aa aa zz zz\nzz qq " * 40
    whole = q.Terms()(text)
    for size in (1, 7, 30, 200):
        monkeypatch.setattr(q, "STRETCH", size)
        assert (q.Terms()(text) == whole).all()

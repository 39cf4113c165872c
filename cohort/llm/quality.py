"""Quality: votes of the nearest labelled documents in a latent-semantic space.

A document is two blocks of hashed terms, beginnings of words and forms (the shape of each word: letters, capitals, digits and signs as
they follow each other; words that repeat at once), each with sublinear counts times inverse document frequency, and of unit length.  Document
frequencies are counted over all documents.  The latent space is spanned by the leading right singular vectors of the labelled rows' term matrix,
from its Gram matrix, which Spark sums over the rows.  Labelled vectors are few (``FIT_ROWS``) and short, and are broadcast; every
document, in blocks, is compared with all of them by exact cosine, and the labels of its nearest vote by their similarity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ref

#: Learn from so many labelled rows at most, the first of each label by a hash of their id.
FIT_ROWS = 6_000
THRESHOLD = 0.7
WORD_TERMS, FORM_TERMS = 768, 256
TERMS = WORD_TERMS + FORM_TERMS
#: Dimensions of the latent space, voters, documents compared at once.
TOPICS, VOTERS, ROWS = 32, 25, 256
#: A vote counts its similarity to this power.
POWER = 8
#: Partitions of the labelled rows, so partial matrices.
PARTS = 4
#: Similarities closer than this are ties; all voters that tie with the last have a vote.
TIE = 1e-9
#: Letters of a word that count.
STEM = 4
#: Characters split into words at once, and terms that a task remembers.
STRETCH, REMEMBERED = 1 << 20, 50_000

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_LETTER, _CAPITAL, _REPEATED = re.compile(r"[^\W\d_]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"(.)\1+")


class _Shapes(dict):
    """Small letters as ``a``, capitals as ``A``, digits as ``0``, all else as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdecimal() else c if not _LETTER.match(c) else "A" if _CAPITAL.match(c) else "a"
        return self[code]


_SHAPE_OF = _Shapes()


def forms_of(stretch: str) -> str:
    """A stretch with each run of small letters, capitals or digits as one character: ``And&&& x`` is ``Aa&&& a``."""
    out = stretch.translate(_SHAPE_OF)
    for c in ("a", "A", "0"):
        while c + c in out:
            out = out.replace(c + c, c)
    return out


def stretches(text: str) -> Iterator[str]:
    """A text in parts of bounded size, cut at white space (a long word stays whole)."""
    start = 0
    while start < len(text):
        if len(text) - start > STRETCH and (cut := _SPACE.search(text, start + STRETCH)):
            end = cut.start()
        else:
            end = len(text)
        yield text[start:end]
        start = end


class Numbers(dict):
    """Numbers of terms by their text, for one of the two blocks; remembers some for a task."""

    def __init__(self, first: int, size: int):
        super().__init__()
        self.first, self.size = first, size

    def __missing__(self, term: str) -> int:
        n = self.first + crc32(_REPEATED.sub(r"\1", term).encode() if self.first else term.encode()) % self.size
        if len(self) < REMEMBERED and len(term) < 64:
            self[term] = n
        return n


class Terms:
    """Counts the terms of texts; one for a task."""

    def __init__(self):
        self.stems, self.forms = Numbers(0, WORD_TERMS), Numbers(WORD_TERMS, FORM_TERMS)

    def __call__(self, text: str | None) -> np.ndarray:
        """How often a whole text has each term: beginnings of words, then forms.  A text without words has one form of its own."""
        counts = np.zeros(TERMS, np.int64)
        last = np.zeros(0, np.int64)
        for stretch in stretches(text or ""):
            words = stretch.lower().split()
            numbers = [*map(self.stems.__getitem__, [w[:STEM] for w in words]), *map(self.forms.__getitem__, forms_of(stretch).split())]
            counts += np.bincount(numbers, minlength=TERMS) if numbers else 0
            row = np.concatenate([last, np.fromiter(map(hash, words), np.int64, len(words))])
            for lag in (1, 2):
                old = max(0, len(last) - lag)  # pairs within the last stretch are counted
                counts[self.forms[f" again {lag}"]] += np.count_nonzero(row[old + lag :] == row[old : len(row) - lag]) if len(row) > lag else 0
            last = row[-2:]
        if not counts.any():
            counts[self.forms[" empty"]] = 1
        return counts


def weighted(texts: Iterable[str | None], idf: np.ndarray, terms: Terms) -> np.ndarray:
    """A row of term weights for each text, both blocks of unit length (or zero)."""
    counts = np.array([terms(t) for t in texts]).reshape(-1, TERMS)
    rows = np.where(counts > 0, 1.0 + np.log(np.maximum(counts, 1)), 0.0) * idf
    return np.hstack([unit(rows[:, :WORD_TERMS]), unit(rows[:, WORD_TERMS:])])


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 1e-12)


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each term; what comes to the driver has the size of the term space."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        seen = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                seen[:TERMS] += terms(text) > 0
            seen[TERMS] += len(batch)
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"term": found, "n": seen[found]})

    counted = texts.select(ref(text_col).alias("text")).mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    for r in counted:
        out[r.term] = r.n
    return int(out[TERMS]), out[:TERMS]


def gram(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The Gram matrix of the rows' term weights: one partial matrix for each of few partitions, summed in their order."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        total = np.zeros((TERMS, TERMS))
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                block = weighted(batch["text"][lo : lo + ROWS], idf, terms)
                total += block.T @ block
        yield pd.DataFrame({"cells": [total.tobytes()]})

    parts = rows.select("text").coalesce(PARTS).mapInPandas(partial, "cells binary").collect()
    return sum((np.frombuffer(r.cells).reshape(TERMS, TERMS) for r in parts), np.zeros((TERMS, TERMS)))


@dataclass
class QualityModel:
    """Term weights, basis of the latent space, labelled vectors, labels, and how many labelled rows each stands for; without vectors,
    the share of label 1."""

    prior: float
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None
    counts_for: np.ndarray | None = None

    def votes(self, texts: Iterable[str | None], terms: Terms) -> np.ndarray:
        """Scores of a block of texts; one that is like no labelled row has the share of label 1."""
        found = unit(weighted(texts, self.idf, terms) @ self.basis) @ self.vectors.T
        k = min(VOTERS, math.isqrt(found.shape[1] - 1) + 1)
        bound = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k, None]
        row, voter = np.nonzero(found >= bound - TIE)
        weights = np.maximum(found[row, voter], 0.0) ** POWER * self.counts_for[voter]
        total = np.bincount(row, weights, len(found))
        share = np.divide(np.bincount(row, weights * self.labels[voter], len(found)), total, out=np.full(len(total), self.prior), where=total > 1e-12)
        return np.clip(np.round(share, 9), 0.0, 1.0)

    def score(self, docs: DataFrame, text_col: str, out: str) -> DataFrame:
        """``docs`` plus a score from 0 to 1 in ``out``, from the text alone.

        Null texts count as empty ones; those, and texts without words, have a term of their own.  Equal texts have equal scores;
        long texts are read whole, a stretch at a time.  An empty table stays empty; other columns, whatever their names, stay.
        """
        if self.vectors is None:
            return docs.withColumn(out, F.lit(self.prior))
        model = docs.sparkSession.sparkContext.broadcast(self)  # FIT_ROWS vectors at most

        @F.pandas_udf("double")
        def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            terms = Terms()
            for texts in batches:
                yield pd.Series(np.concatenate([model.value.votes(texts[lo : lo + ROWS], terms) for lo in range(0, len(texts), ROWS)] or [np.zeros(0)]))

        return docs.withColumn(out, voted(ref(text_col).cast("string")))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """``(text, label)`` of up to ``fit_rows`` labelled rows, half of them, if there are as many, of either label; and how many rows stand for one of each label."""
    y = (
        labels.select(ref(id_col).alias("id"), ref(label_col).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id").agg(F.min("label").alias("label"))
        .withColumn("h", F.xxhash64("id"))
    )
    sizes = {0: 0, 1: 0} | {r.label: r.n for r in y.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = int(sizes[1] < sizes[0])
    few = min(sizes[rare], fit_rows // 2)
    take = {rare: few, 1 - rare: min(sizes[1 - rare], fit_rows - few)}
    chosen = reduce(DataFrame.unionByName, (y.where(F.col("label") == k).orderBy("h", "id").limit(n) for k, n in take.items()))
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).cast("string").alias("text"))
    # at most `fit_rows` ids, so a broadcast of bounded size; an id that stands in many rows counts once
    first = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("label", "text")).alias("one"))
    return first.select("one.text", "one.label"), {k: sizes[k] / n for k, n in take.items() if n}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Counts terms over all of ``docs``, and learns the space and the voters from its labelled rows.

    Labels that are null or not 0 or 1 are ignored; an id labelled twice has the smaller label.  With labels of one kind only, every
    score is that label; with none, 0.5.
    """
    rows, stand_for = _labelled(docs, labels, id_col, text_col, label_col, fit_rows)
    rows = checkpointed(rows.repartition(PARTS))
    sizes = {r.label: r.n * stand_for[r.label] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0.0) / sum(sizes.values()) if sizes else 0.5
    if len(sizes) < 2:
        return QualityModel(prior)
    n, seen = document_frequencies(docs, text_col)
    idf = np.log((1.0 + n) / (1.0 + seen)) + 1.0
    values, basis = np.linalg.eigh(gram(rows, idf))
    basis = basis[:, np.argsort(values)[::-1][:TOPICS]]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            found = unit(weighted(batch["text"], idf, terms) @ basis)
            yield pd.DataFrame({"vector": list(found), "label": batch["label"]})

    voters = rows.mapInPandas(project, "vector array<double>, label int").collect()
    kinds = [r.label for r in voters]
    return QualityModel(prior, idf, basis, np.array([r.vector for r in voters]), np.array(kinds, float), np.array([stand_for[k] for k in kinds]))

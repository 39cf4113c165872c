"""A corpus pipeline over ``documents``: drop toxic texts, drop near-duplicates, mask secrets, mix sources, tokenize.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which the runner writes as Parquet and reads again as the
next stage's ``docs``.  All stages but the last keep the columns of ``documents``.

In every stage, null and empty texts are texts without words (kept, clean, without secrets or tokens), texts of any length are read
whole, rows that repeat are rows of their own but where one of a group stays, other columns stay whatever their names, and an empty
table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import mixing, pieces, secret_scan, simhash, toxicity
from cohort.llm.common import checkpoint_dir, fresh, prepare, ref, table
from cohort.llm.registry import PIECES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold; the model learns from all labels of these rows.

    Without labels of both kinds the lexicon alone scores (all labels toxic: every row goes).  Equal texts stay or go together.
    """
    prepare(spark)
    (score,) = fresh(docs, "score_")
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return model.score(docs, "text", score).where(ref(score) < toxicity.THRESHOLD).select(*[ref(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, and of rows that repeat with it, one.

    Texts without words are near-duplicates of each other.  A null doc_id stays only where its group has no other.
    """
    prepare(spark)
    return simhash.keep_one_per_component(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; every row stays, and null texts stay null."""
    prepare(spark)
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that each source comes near its target of words; a null source is one of them."""
    prepare(spark)
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; none for null and empty texts."""
    prepare(spark)
    return pieces.encode_documents(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: The stages learn trees and fuzzy keys, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The thin queries and the pipeline on the smallest tables, against DuckDB or brute force."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cohort.llm import registry

FOLDER = os.environ.get("COHORT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    ours = registry.QUERIES[name](spark, FOLDER)
    assert sorted(ours.columns) == sorted(names)
    assert sorted(str([r[c] for c in names]) for r in ours.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_rows_and_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name, columns in {
        "op3_token_counts": ["doc_id", "n_tokens", "n_chars"],
        "op4_simhash": ["doc_id", "fingerprint", "component_id"],
        "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op8_sentencepiece": ["doc_id", "n_tokens", "ids", "round_trip"],
        "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op12_quality": ["doc_id", "held_out", "score", "predicted"],
    }.items():
        out = registry.QUERIES[name](spark, FOLDER)
        assert out.columns == columns and out.count() == docs, name
    assert registry.QUERIES["op8_sentencepiece"](spark, FOLDER).where(~F.col("round_trip")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_dedup", "secrets", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "'x' AS score_", "'y' AS fp_")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
    assert p.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids", "round_trip"]

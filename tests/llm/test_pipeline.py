"""The stages of the pipeline: odd rows, empty tables and labels, and what each stage decides, checked by plain code."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from cohort.llm import mixing, secret_scan, simhash, toxicity

FOLDER = os.environ.get("COHORT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score_ string, fp_ int, rank_ int, redacted_ string"
SECRET = 'api_key = "abcdef123456"'


def odd(spark):
    words = "river stone green walk table light song paper cloud under bright slow".split()
    rows = [(i, " ".join(words[(i * j) % 12] + str(i) for j in range(1, 30)), "en", f"s{i % 2}", 1) for i in range(8)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "", "en", "s0", 0), (None, "only words here " + SECRET, "en", None, 3), (8, "hidden " + SECRET + " in " + " ".join(words), "en", "s1", 5)]
    rows += [rows[3], rows[3], (103, "stone " * 50_000, "xx", "s1", 9)]
    return spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_odd_rows_and_empty_tables(spark, no_labels, name):
    stage = dict(p.STAGES)[name]
    docs = odd(spark)
    for folder in (FOLDER, no_labels):
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = {r.doc_id for r in out.collect()}
        assert found <= {r.doc_id for r in docs.collect()}
        if name in ("secrets", "sentencepiece"):
            assert out.count() == docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_toxic_texts_go(spark, no_labels):
    docs = odd(spark)
    bad = spark.createDataFrame([(50, "you stupid idiot, you moron scum", "en", "s", 1, "", 1, 1, "")], SCHEMA)
    left = {r.doc_id for r in p.drop_toxic(spark, docs.unionByName(bad), no_labels).collect()}
    assert left == {r.doc_id for r in docs.collect()}


def test_one_of_each_group_stays(spark):
    docs = odd(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    near = {(a.doc_id, b.doc_id) for a in prints.values() for b in prints.values() if bin((a.fingerprint ^ b.fingerprint) & (2**64 - 1)).count("1") <= 2}
    out = [r.doc_id for r in p.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert len(out) == len(set(out))
    for r in rows:  # each row is kept, or near a smaller one that is
        assert r.doc_id in out or any(x in out for y, x in near if y == r.doc_id)
    assert 3 in out and not {101, 102} <= set(out)


def test_secrets_are_masked(spark):
    out = {r.doc_id: r for r in p.mask_secrets(spark, odd(spark), FOLDER).collect()}
    assert out[8].text.startswith("hidden [SECRET]") and out[8].n_chars == len(out[8].text) and out[100].text is None
    assert all(not secret_scan.base_spans(r.text or "") for r in out.values())


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    size = {s.source: s.n for s in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    target = {r.source: r.target for r in mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    taken = {}
    for r in p.mix_sources(spark, docs, FOLDER).collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    longest = docs.agg(F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert all(abs(taken.get(s, 0) - target[s]) <= 3 * longest and target[s] <= 3 * size[s] + 1e-6 for s in size)


def test_run_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r.doc_id for r in model.score(docs, "text", "s").where(F.col("s") < toxicity.THRESHOLD).collect()}
    out = p.run(spark, FOLDER).collect()
    assert out and {r.doc_id for r in out} <= clean
    for _, stage in p.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(map(tuple, docs.select("doc_id", "n_tokens", "ids").collect())) == sorted((r.doc_id, r.n_tokens, r.ids) for r in out)

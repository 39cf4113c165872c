"""The thin queries: each operator over its whole table, with production parameters, as ``opN_<name>``."""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, merkle, mixing, multi_index, pieces, prefix_forest, quality, secret_scan, simhash, toxicity, url_filter, warc
from .common import checkpoint_dir, prepare, table

TOKENIZERS = os.environ.get("COHORT_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"

URL_RULES = [
    url_filter.host_rule(verdict, text)
    for verdict, text in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, URL_RULES + list(url_filter.KEYWORDS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(prepare(spark))}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_documents(table(prepare(spark), sf_dir, "documents"), PIECES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(prepare(spark), sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return prefix_forest.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(prepare(spark), sf_dir, "documents"), PIECES)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(prepare(spark), sf_dir, "documents"))


def _classified(spark: SparkSession, sf_dir: str, classifier) -> DataFrame:
    """All documents scored by a classifier that learns from the labels that are not held out."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = classifier.fit(docs, labels).score(docs, "text", "score")
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(table(prepare(spark), sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    values = [F.col(c) for c in merkle.VALUES[:-1]]
    found = merkle.manifest(table(prepare(spark), sf_dir, "documents"), tampered=tampered, tampered_values=[*values, lowered])
    return found.withColumnRenamed("proof", "proof_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_warc, op3_token_counts, op4_simhash, op5_secrets,
        op6_embedding_dedup, op7_nearest, op8_sentencepiece, op9_mixing, op10_toxicity,
        op11_fill_in_middle, op12_quality, op13_merkle_manifest,
    )
}

#: DuckDB SQL over the same tables, where SQL can say what an operator computes.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
        ), p AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
            FROM u
        ), r AS (
            SELECT *, CASE
                WHEN regexp_matches(host, '(^|\.)www\.example\.com$') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM p
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[^0-9a-z])(casino|poker|porn|xxx|spam|adserver|doubleclick|viagra|torrent|ads([^0-9a-z].*)?[^0-9a-z]track|free([^0-9a-z].*)?[^0-9a-z]money)($|[^0-9a-z])') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM r
    """.replace("\\\\", "\\"),
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages
        ), m AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS head FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)
            ), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> head THEN head END AS refers_to
        FROM m
    """,
    "op11_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), u AS (
            SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM t
        ), k AS (
            SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ), p AS (
            SELECT *, array_to_string(units[1:low], '') AS pre, array_to_string(units[low + 1:high], '') AS mid, array_to_string(units[high + 1:], '') AS suf FROM k
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
            CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, crc, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
            FROM (
                SELECT doc_id, source, crc,
                    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS tampered
                FROM (
                    SELECT *, list_reduce(
                        flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295) AS crc,
                        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents
                )
            )
        ), up AS (
            SELECT source, 0 AS level, pos, leaf AS digest FROM d
            UNION ALL
            SELECT source, max(level) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
            FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM up) WHERE n > 1 GROUP BY source, pos // 16
        ), tops AS (SELECT source, max(level) AS level FROM up GROUP BY source),
        subroots AS (
            SELECT u.source, u.digest AS subroot, row_number() OVER (ORDER BY u.source NULLS FIRST) - 1 AS place
            FROM up u JOIN tops t ON u.source IS NOT DISTINCT FROM t.source AND u.level = t.level
        ), over AS (
            SELECT 0 AS level, place AS pos, subroot AS digest FROM subroots
            UNION ALL
            SELECT max(level) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM over) WHERE n > 1 GROUP BY pos // 16
        ), nodes AS (
            SELECT u.source, u.level, u.pos, u.digest FROM up u JOIN tops t ON u.source IS NOT DISTINCT FROM t.source AND u.level < t.level
        ), ends AS (SELECT max(level) AS level, arg_max(digest, level) AS root FROM over),
        runs AS (
            SELECT source, level, pos // 16 AS run, list(digest ORDER BY pos) AS digests FROM nodes GROUP BY source, level, pos // 16
        ), top_runs AS (
            SELECT level, pos // 16 AS run, list(digest ORDER BY pos) AS digests FROM over WHERE level < (SELECT level FROM ends) GROUP BY level, pos // 16
        ), steps AS (
            SELECT d.doc_id, d.source, d.pos AS id, r.level, d.pos // CAST(power(16, r.level) AS BIGINT) % 16 AS k, r.digests
            FROM d JOIN runs r ON r.source IS NOT DISTINCT FROM d.source AND r.run = d.pos // CAST(power(16, r.level + 1) AS BIGINT)
            UNION ALL
            SELECT d.doc_id, d.source, d.pos, t.level + 1000, s.place // CAST(power(16, t.level) AS BIGINT) % 16, t.digests
            FROM d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source JOIN top_runs t ON t.run = s.place // CAST(power(16, t.level + 1) AS BIGINT)
        ), paths AS (
            SELECT source, id, list(struct_pack(b := array_to_string(digests[:k], ''), a := array_to_string(digests[k + 2:], '')) ORDER BY level) AS path
            FROM steps GROUP BY source, id
        ), starts AS (
            SELECT d.*, s.subroot, coalesce(p.path, []) AS path,
                CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN tampered ELSE leaf END AS start
            FROM d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM d.source AND p.id = d.pos
        ), fold AS (
            SELECT source, pos, 0 AS step, start AS value, path FROM starts
            UNION ALL
            SELECT source, pos, step + 1, sha256(path[step + 1].b || value || path[step + 1].a), path FROM fold WHERE step < len(path)
        ), folded AS (SELECT source, pos, value AS folded_root FROM fold WHERE step = len(path))
        SELECT s.doc_id, s.leaf, s.subroot, e.root, sha256(array_to_string(list_transform(s.path, lambda p: p.b || p.a), '')) AS proof_sha256,
            f.folded_root, f.folded_root = e.root AS verified
        FROM starts s CROSS JOIN ends e JOIN folded f ON f.source IS NOT DISTINCT FROM s.source AND f.pos = s.pos
    """,
}

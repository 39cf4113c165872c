import base64
import hashlib

import pytest

from cohort.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
ROWS = [
    (5, "http://a/", "same", "x"), (2, "http://b/", "same", "x"), (9, None, "same", "x"), (1, "u\r\nWARC-Type: fake", "other \u00e9\U0001f600\r\n\r\nWARC/1.1", "x"),
    (3, "", None, "x"), (4, "u", "", "x"), (7, "u", "x" * 300_000, None), (None, "n", "same", "x"), (None, "n", "only nameless", "x"), (8, "r", "twice", "x"), (8, "r", "twice", "x"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    path = str(tmp_path / f"a{least}")
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), path, least)
    heads = {}
    for i, _, body, _ in ROWS:
        if i is not None:
            heads[body or ""] = min(i, heads.get(body or "", i))
    index = warc.read_index(spark, path).collect()
    assert len(index) == len(ROWS)
    want = []
    for i, _, body, _ in ROWS:
        raw = (body or "").encode()
        head = heads.get(body or "")
        first = head is None or i == head or len(raw) < least
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else head))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in index)
    assert spark.read.parquet(f"{path}/payloads").count() == len({b or "" for _, _, b, _ in ROWS})

    records = warc.read_records(spark, path).collect()
    assert sorted((str(i), (b or "").encode()) for i, _, b, _ in ROWS) == sorted((str(r.record_id), bytes(r.payload)) for r in records)
    for r in records:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = body[: int(fields["Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and body[len(block) :] == b"\r\n\r\n"
        assert block == (b"" if fields["WARC-Type"] == "revisit" else bytes(r.payload))
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "bad")
    warc.write_archive(spark.createDataFrame(ROWS[:2], SCHEMA), path)
    stored = spark.read.parquet(f"{path}/payloads")
    stored.selectExpr("digest", "CAST('other' AS BINARY) AS payload").write.parquet(f"{path}/changed")
    (tmp_path / "bad" / "payloads").rename(tmp_path / "bad" / "old")
    (tmp_path / "bad" / "changed").rename(tmp_path / "bad" / "payloads")
    for read in (warc.read_index, warc.read_records):
        with pytest.raises(Exception, match="does not match its digest"):
            read(spark, path).collect()


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_index(spark, path).count() == 0 and warc.read_records(spark, path).count() == 0

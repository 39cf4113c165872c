import random
import re

import pytest

from cohort.llm import mixing as m


def brute_targets(sizes, share=1.0):
    """Excess over three times a source's size is reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * share, set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        for s in above or open_:
            out[s] = 3.0 * sizes[s] if above else level * w[s]
            left -= out[s]
        open_ = open_ - above if above else set()
    return out


def rows(seed, hot=0.4):
    rng = random.Random(seed)
    names = ["b", "a", None, "\uffee", "\U0001f600", "é", "tiny", "none"]
    out = []
    for i in range(900):
        s = "b" if rng.random() < hot else rng.choice(names[1:6])
        out.append((i, " ".join(["w"] * rng.randint(0, 40)), s))
    return [*out, (900, "one word here", "tiny"), (901, None, "none"), (902, "", "none"), (903, "a\u00a0b c\x1fd\te\x0bf", None), (904, "x " * 300, "a"), (904, "x " * 300, "a"), (None, "n n", "a"), (None, "n n n", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'x' AS h")
    out = m.mix_report(df).join(df.selectExpr("doc_id", "source").dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL"), "doc_id").collect()
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r.size == n[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, target in want.items():
        assert abs(taken.get(s, 0) - target) <= 650 if s == "a" else abs(taken.get(s, 0) - target) <= 40
    again = m.mix_report(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, m.mix_report(df).collect()))


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame(rows(3), "doc_id long, text string, source string").selectExpr("*", "'x' AS src_", "2 AS epochs_")
    taken = {r[0]: r[1] for r in m.mix_report(df).where("doc_id < 900").select("doc_id", "taken").collect()}
    out = m.mix(df)
    assert out.columns == df.columns
    got = {}
    for r in out.where("doc_id < 900").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert {i: t for i, t in taken.items() if t} == {i: t for i, t in got.items() if t}


def test_native(spark):
    df = spark.createDataFrame(rows(4), "doc_id long, text string, source string")
    for out in (m.mix_report(df), m.mix(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_many_sources_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(rows(5), "doc_id long, text string, source string")
    want = sorted(map(str, m.mix_report(df).collect()))
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, m.mix_report(df).collect())) == want


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix_report(df).count() == 0 and m.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in m.mix_report(blank).collect()] == [(0, 0.0, 0)] * 2

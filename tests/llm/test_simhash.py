import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cohort.llm import simhash

SCHEMA = "doc_id long, text string, fp_ string"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: smallest id reachable} for {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = sorted(prints.items())
    for i, a in items:
        for j, b in items:
            if i < j and (a ^ b).bit_count() <= 2 and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in prints}


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Straße", "naïve", "K\u212a"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    return [*out, out[0], out[1] + " x", None, "", " \t\n", "one", "One", "two words", "a" * 200_000, "\u00a0 nb", "\x1f sep", " ".join(words * 5000)]


def test_fingerprints_and_components(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute_components(prints)


@pytest.mark.parametrize("bucket", [32, 2, 0])
def test_links_with_full_and_crowded_buckets(spark, bucket):
    """Dense clusters: chains at distance 2, balls around a centre, far points; with every bucket crowded, too."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        fps.add(c)
        for _ in range(25):
            c ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
            fps.add(c)
        fps |= {c ^ (1 << rng.randrange(64)) for _ in range(20)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), bucket)
    found = simhash.connected_components(edges)
    got = {r.node: r.component for r in found.collect()}
    want = brute_components({f: f % 2**64 for (f,) in signed})
    assert {f: got.get(f, f) for (f,) in signed} == want


def test_golay_keys_always_meet():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 400)
    flips = (np.uint64(1) << rng.integers(0, 64, (2, 400)).astype(np.uint64)).astype(np.uint64)
    b = (a.astype(np.uint64) ^ flips[0] ^ flips[1]).astype(np.int64)
    assert all(set(x) & set(y) for x, y in zip(simhash.fuzzy_keys(a), simhash.fuzzy_keys(b), strict=True))


def test_keep_one(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "x"), (2, "other words are here", "x"), (None, "none has an id", "x"), (None, "none has an id", "x"), (None, "a b c d", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one_per_component(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in df.collect() if r.doc_id == 2] + [df.collect()[1], df.collect()[4]]))


def test_keep_one_of_unique_ids(spark):
    """Where ids name their rows no text is fingerprinted again; one row without an id is such a case, too."""
    rows = [(3, "a b c d", "x"), (1, "A b c d", "x"), (2, "other words are here", "x"), (5, None, "x"), (4, "", "x"), (None, "none has an id", "x"), (None, "a b c d", "x")]
    for some in (rows[:6], rows):  # the second has two rows without an id
        kept = simhash.keep_one_per_component(spark.createDataFrame(some, SCHEMA))
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), (7, "x"), (7, "x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.simhash_components(df).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.simhash_components(df.limit(0)).count() == 0
    assert simhash.keep_one_per_component(df.limit(0)).count() == 0


def test_hex(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "f long").select(simhash.hex_fingerprint(F.col("f")).alias("h"))
    assert [r.h for r in df.collect()] == ["0" * 16, "f" * 16, "00000000000000ff"]


def test_components_of_odd_graphs(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000 + i) for i in range(200)]
    edges = spark.createDataFrame([*chain, *star, (9, 9), (None, 4), (42, 41)], "a long, b long")
    got = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[5000] == 4000
    assert 9 in got and len(got) == 301 + 200 + 201
    assert simhash.connected_components(edges.limit(0)).count() == 0

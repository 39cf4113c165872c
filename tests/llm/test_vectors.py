import numpy as np
import pytest

from cohort.llm import multi_index, prefix_forest
from cohort.llm.blocks import block_pairs

SCHEMA = "vec_id long, embedding array<float>, label int, cls int"
ODD = [(9001, None, 1, 0), (9002, [0.0] * 16, 1, 0), (9003, [float("nan")] + [1.0] * 15, 1, 0), (9004, [float("inf")] + [1.0] * 15, 1, 0), (9005, [None] + [1.0] * 15, 1, 0), (9006, [], 1, 0), (9007, [1.0, 2.0], 1, 0)]


def vectors(n=700, seed=3, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, width))
    rows = []
    for i in range(n):
        c = centres[i % 40] if i % 2 else centres[0]
        x = (c + rng.standard_normal(width) * rng.choice([0.02, 0.1, 0.25])) * rng.choice([0.1, 1.0, 50.0])
        rows.append((i, x.astype(np.float32).tolist(), None if i % 97 == 0 else int(i % 3), 0))
    rows += [(n + i, rows[5][1], rows[5][2], 0) for i in range(20)]  # exact copies
    return rows + ODD


def brute_links(rows):
    good = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in good], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[2] for r in good])
    near = (x @ x.T >= multi_index.THRESHOLD) & (y[:, None] == y[None, :])
    np.fill_diagonal(near, False)
    return [r[0] for r in good], near


def test_near_duplicates(spark):
    rows = vectors()
    ids, near = brute_links(rows)
    out = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    true = dict(zip(ids, near.sum(1), strict=True))
    assert all(out[i].n_links <= true[i] for i in ids)  # none below the threshold
    assert sum(out[i].n_links for i in ids) >= 0.95 * near.sum()
    for i, r in out.items():
        assert r.kept == (i == r.component_id)
        if i not in true:
            assert (r.n_links, r.component_id) == (0, i)
    root = list(range(len(ids)))
    for a, b in zip(*np.nonzero(near), strict=True):
        ra, rb = a, b
        while root[ra] != ra:
            ra = root[ra]
        while root[rb] != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)

    def find(i):
        while root[i] != i:
            i = root[i]
        return ids[i]

    same = sum(find(k) == out[i].component_id for k, i in enumerate(ids))
    assert same >= 0.95 * len(ids) and all(out[i].component_id >= find(k) for k, i in enumerate(ids))


def test_repeats_and_empty(spark):
    one = [0.5] * 16
    df = spark.createDataFrame([(4, one, 1, 0), (4, one, 1, 0), (2, [x * 3 for x in one], 1, 0), (None, one, 1, 0), (3, one, 2, 0)], SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in multi_index.near_duplicates(df).collect())
    assert got == [("2", 3, 2), ("3", 0, 3), ("4", 3, 2), ("4", 3, 2), ("None", 3, 2)]
    assert multi_index.near_duplicates(df.limit(0)).count() == 0
    assert multi_index.near_duplicates(spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(2)
    p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(5))
    cells = multi_index.multi_sequence(p, q, 0.9)
    mass = [p[i] * q[j] for i, j in cells]
    assert mass == sorted(mass, reverse=True) and sum(mass) >= 0.9 > sum(mass[:-1])
    every = sorted((p[i] * q[j] for i in range(6) for j in range(5)), reverse=True)
    assert np.allclose(mass, every[: len(mass)])


def test_blocks_pair_each_once(spark):
    a = spark.range(70).selectExpr("id % 2 AS key", "id")
    b = spark.range(33).selectExpr("id % 3 AS key", "id")
    rows = block_pairs(a, b, 8).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.key, r.block), ([], []))[r.side].append(r.id)
    pairs = [(x, y) for p, m in groups.values() for x in p for y in m]
    want = {(x, y) for x in range(70) for y in range(33) if x % 2 == y % 3}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def brute_top(rows, k):
    good = [(r[0], r[1]) for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 20 == 0:
            score = np.where(ids == i, -np.inf, x @ v)
            out[i] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score))[:k]]
    return out


def test_nearest(spark):
    rows = vectors(1500, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    out = prefix_forest.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    want = brute_top(rows, 20)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = {r[0]: np.array(r[1], dtype=np.float64) for r in rows if r[0] < 9000}
    for q, found in got.items():
        assert [x for x in found] == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        assert all(s == pytest.approx(float(by_id[i] @ by_id[q]), rel=1e-12) for i, s in found)


def test_nearest_small_and_empty(spark):
    rows = [(20, [1.0] * 16, 1, 0), (1, [1.0] * 16, 1, 0), (2, [1.0] * 16, 1, 0), (2, [1.0] * 16, 1, 0), (40, [-1.0] * 16, None, 0), *ODD]
    df = spark.createDataFrame(rows, SCHEMA)
    out = prefix_forest.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(20, 1, 1), (20, 2, 2), (20, 3, 40), (40, 1, 1), (40, 2, 2), (40, 3, 20)]
    assert prefix_forest.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0
    assert prefix_forest.nearest_neighbours(df, df.limit(0)).count() == 0


def test_other_lengths_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "BLOCK_ROWS", 300)
    monkeypatch.setattr(prefix_forest, "QUERY_ROWS", 20)
    rows = vectors(1500, 8) + [(10_000 + i, [float(i), 1.0], 1, 0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = prefix_forest.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    want = brute_top(rows, 20)
    short = [(r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 10_000]
    assert short == [(1, 9007, 2.0), (2, 10_001, 1.0), (3, 10_002, 1.0)]
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == 20 for q in want)


def test_ascent_is_the_bitwise_one():
    rng = np.random.default_rng(4)
    strings = rng.integers(0, 1 << prefix_forest.BITS, (400, prefix_forest.TREES))
    strings[:50] = strings[0]  # copies share every bit
    forest = prefix_forest.Forest(strings)
    asked = np.concatenate([strings[:5], rng.integers(0, 1 << prefix_forest.BITS, (20, prefix_forest.TREES))])
    for wanted in (1, 60, 900, 10**6):
        for q, found in zip(asked, forest.candidates(asked, wanted), strict=True):
            depth = [prefix_forest.BITS] * prefix_forest.TREES
            under = [{i for i in range(400) if strings[i, t] == q[t]} for t in range(prefix_forest.TREES)]
            while sum(map(len, under)) < wanted and any(depth):
                t = depth.index(max(depth))
                depth[t] -= 1
                shift = prefix_forest.BITS - depth[t]
                under[t] = {i for i in range(400) if strings[i, t] >> shift == q[t] >> shift}
            assert set(found.tolist()) == set().union(*under)


def test_nearest_among_copies(spark):
    """Clustered vectors, some with exact copies that every tree finds first: still 20 rows for each query."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 16))
    rows = [(i, (centres[i % 200] + rng.standard_normal(16) * 0.05).tolist(), 1, 0) for i in range(4000)]
    for c, i in enumerate((0, 20, 40)):
        rows += [(4000 + 20 * c + j, rows[i][1], 1, 0) for j in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in prefix_forest.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_top(rows, 20)
    assert got.keys() == want.keys() and all(len(set(v)) == len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_ascent_goes_on_for_different_rows():
    strings = np.repeat(np.arange(30, dtype=np.int64)[:, None], prefix_forest.TREES, axis=1) << 30
    strings[:10] = strings[0]
    forest = prefix_forest.Forest(strings)
    for least in (1, 10, 11, 25, 30, 99):
        (found,) = forest.candidates(strings[:1], 20.0, least)
        assert len(found) >= min(least, 30) and set(range(10)) <= set(found.tolist())


def test_nearest_on_the_given_vectors(spark):
    """Recall against brute force over a whole table of little structure (the best products are near 0.4)."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in prefix_forest.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    hits = 0
    for i in asked:
        score = np.where(ids == ids[i], -np.inf, x @ x[i])
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)

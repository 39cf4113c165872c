"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest).

Every tree turns a vector into a long string of hash bits: sides of hyperplanes between pairs of sampled vectors, cut at the
sample's median.  For inner products, vectors are lengthened by one component to equal norm first, which keeps the order.  A tree is a
sorted array of these strings.  A query descends in every tree to the longest prefix it shares with any vector, then ascends in all
trees together, one bit at a time (on the last level tree by tree), until the vectors under its prefixes number at least the
wanted candidates, and are at least ``k`` different ones besides itself; those, each once, are scored exactly.

On Spark the vectors are dealt evenly over blocks by a hash of their id, each with a forest of its own; the forest of the
table is their union.  A task holds one block of vectors and one of queries, whatever the table's size and however many
vectors have one hash string, and gives back one row a query.

How many candidates are wanted is measured: on a bounded sample, the smallest share of the vectors that
reaches the target recall against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ref
from .multi_index import valid_vector

TREES = 20
#: Bits of a hash string.
BITS = 48
FIT_ROWS = 8_000
FIT_QUERIES = 200
TARGET_RECALL = 0.93
#: Vectors and queries in a block, about.
BLOCK_ROWS, QUERY_ROWS = 8_192, 8_192


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows over the longest norm, with a last component that gives all of them norm one."""
    y = x / longest
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))[:, None]])


def hash_strings(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(rows, trees) integers whose bits, highest first, are the hash strings."""
    trees, bits = cuts.shape
    sides = (x @ planes.reshape(trees * bits, -1).T > cuts.reshape(-1)).reshape(len(x), trees, bits)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
    return sides @ weights


def fit_planes(x: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Planes across lines between random pairs of the sample, cut at its median; (trees, bits, width) and (trees, bits)."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(x), (2, TREES, BITS))
    planes = x[a] - x[b]
    flat = np.abs(planes).max(axis=2) == 0
    planes[flat] = rng.standard_normal((int(flat.sum()), x.shape[1]))
    cuts = np.median(x @ planes.reshape(TREES * BITS, -1).T, axis=0).reshape(TREES, BITS)
    return planes, cuts


class Forest:
    """One sorted array of hash strings a tree, over the rows of ``x``."""

    def __init__(self, strings: np.ndarray):
        self.rows = len(strings)
        self.order = np.argsort(strings.T, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(strings.T, self.order, axis=1)

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) bounds in the sorted arrays of what shares each query's prefix of its ``depth``."""
        shift = BITS - depth
        low = strings.T >> shift << shift
        high = low + (np.int64(1) << shift)
        bound = [(np.searchsorted(k, lo), np.searchsorted(k, hi)) for k, lo, hi in zip(self.keys, low, high, strict=True)]
        return np.array([a for a, _ in bound]), np.array([z for _, z in bound])

    def ascend(self, strings: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds at which the synchronous ascent stops: those with at least ``wanted`` vectors, summed over trees.

        Prefixes only widen on the way up, so the deepest level with enough is found by bisection; there the trees go
        up one after another, and the rest stay one bit deeper.
        """
        low, high = np.zeros(len(strings), dtype=np.int64), np.full(len(strings), BITS, dtype=np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, z = self.ranges(strings, middle)
            enough = (z - a).sum(axis=0) >= wanted
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        a, z = self.ranges(strings, low)
        deep_a, deep_z = self.ranges(strings, np.minimum(low + 1, BITS))
        more = (z - a) - (deep_z - deep_a)
        goes_up = (deep_z - deep_a).sum(axis=0) + np.cumsum(more, axis=0) - more < wanted
        return np.where(goes_up, a, deep_a), np.where(goes_up, z, deep_z)

    def candidates(self, strings: np.ndarray, wanted: float, least: int = 0):
        """Rows found for each query in turn, every row once, in rising order.

        The trees may find the same few rows (copies of the query, say): a query goes on up, wanting twice as many each time, until
        it has ``least`` different rows, or all there are.
        """
        low, high = self.ascend(strings, wanted)
        least = min(least, self.rows)
        for q in range(len(strings)):
            a, z, more = low[:, q], high[:, q], wanted
            while True:
                hit = np.zeros(self.rows, dtype=bool)
                for order, x, y in zip(self.order, a, z, strict=True):
                    hit[order[x:y]] = True
                found = np.flatnonzero(hit)
                if len(found) >= least:
                    break
                more = 2 * max(more, int((z - a).sum()))
                a, z = (side[:, 0] for side in self.ascend(strings[q : q + 1], more))
            yield found


def query_strings(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Hash strings of queries: their length does not matter to the order, so they get no last component."""
    return hash_strings(np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))]), planes, cuts)


def wanted_share(x: np.ndarray, longest: float, planes: np.ndarray, cuts: np.ndarray, k: int, target: float) -> float:
    """Candidates (summed over trees) as a share of the vectors, such that recall in the sample reaches ``target``."""
    n = len(x)
    if n <= 4 * k:
        return float(TREES)
    queries = np.random.default_rng(3).choice(n, size=min(FIT_QUERIES, n), replace=False)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    true = np.argpartition(-scores, k, axis=1)[:, :k]
    forest, asked = Forest(hash_strings(lengthened(x, longest), planes, cuts)), query_strings(x[queries], planes, cuts)
    low, high = np.log(k / n), np.log(TREES)
    for _ in range(10):
        middle = (low + high) / 2
        found = np.mean([np.isin(t, c, assume_unique=True).mean() for t, c in zip(true, forest.candidates(asked, np.exp(middle) * n), strict=True)])
        low, high = (low, middle) if found >= target else (middle, high)
    return float(np.exp(high))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target_recall: float = TARGET_RECALL) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` largest inner products found, in double precision, for every query.

    A query's own row (same id) is no candidate.  Ties go to the smaller id.  Rows with null ids, or vectors that are null,
    empty, zero or not finite, take no part; a query's candidates are the vectors of its length (each length has
    a forest and jobs of its own); repeated rows of one id count once (the smallest vector).  A query has fewer than ``k`` rows only
    where there are fewer candidates.  Extra columns are ignored, whatever their names.  Empty tables give an empty result.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(ref(id_col).cast("long").alias("id"), ref(vector_col).cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & valid_vector(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))

    data, asked = checkpointed(clean(vectors)), checkpointed(clean(queries))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    shapes = data.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).orderBy("width").collect()
    sizes = {r.width: r.n for r in asked.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = spark.createDataFrame([], "q long, part int, best array<struct<s: double, id: bigint>>")
    most = 1
    for s in shapes:
        if s.width in sizes:
            parts = -(-s.n // BLOCK_ROWS)
            most = max(most, parts)
            mine, theirs = data.where(F.size("v") == s.width), asked.where(F.size("v") == s.width)
            found = found.unionByName(_search(mine, theirs, s.longest, parts, -(-sizes[s.width] // QUERY_ROWS), k, target_recall))
    # lists of k meet in two steps, so that no group holds more than the root of the number of blocks
    fan = max(1, int(np.sqrt(most)))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    merged = found.groupBy("q", F.pmod("part", F.lit(fan)).alias("some")).agg(best).groupBy("q").agg(best)
    ranked = merged.select("q", F.posexplode("best").alias("at", "c"))
    return ranked.select(F.col("q").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("c.id").alias(id_col), (-F.col("c.s")).alias("score"))


def _search(data: DataFrame, asked: DataFrame, longest: float, parts: int, query_parts: int, k: int, target: float) -> DataFrame:
    """``(q, part, best)`` for vectors of one length: the best of each block for each query."""
    sample = np.array([r.v for r in data.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()])
    planes, cuts = fit_planes(lengthened(sample, longest))
    share = wanted_share(sample, longest, planes, cuts, k, target)
    shared = data.sparkSession.sparkContext.broadcast((planes, cuts))

    def dealt(df: DataFrame, mine: int, others: int, side: int) -> DataFrame:
        """Rows in their own part, once for each part of the other side."""
        own, other = F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        rows = df.select("id", "v", own.alias("own"), other.alias("other"))
        block, query_block = ("other", "own") if side == 0 else ("own", "other")
        return rows.select("id", "v", F.lit(side).alias("side"), F.col(block).alias("block"), F.col(query_block).alias("query_block"))

    def best_of_block(group: pa.Table) -> pa.Table:
        side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
        flat = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x, y, own, asking = flat[side == 1], flat[side == 0], ids[side == 1], ids[side == 0]
        rows: list[tuple] = []
        if len(x) and len(y):
            p, c = shared.value
            forest = Forest(hash_strings(lengthened(x, longest), p, c))
            for q, v, near in zip(asking, y, forest.candidates(query_strings(y, p, c), max(4.0 * k, share * len(x)), k + 1), strict=True):
                near = near[own[near] != q]
                score = x[near] @ v
                if len(near) > k:
                    # the matrix product rounds as its shape goes: all within that of the k-th best are scored again
                    edge = np.partition(score, -k)[-k]
                    near = near[score >= edge - 1e-9 * (1 + abs(edge))]
                exact = (x[near] * v).sum(axis=1)
                top = np.lexsort((own[near], -exact))[:k]
                if len(top):
                    rows.append((int(q), [{"s": -float(exact[t]), "id": int(own[near[t]])} for t in top]))
        part = pa.array([group.column("block")[0].as_py()] * len(rows), pa.int32())
        best = pa.array([b for _, b in rows], pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))
        return pa.table({"q": pa.array([q for q, _ in rows], pa.int64()), "part": part, "best": best})

    met = dealt(asked, query_parts, parts, 0).unionByName(dealt(data, parts, query_parts, 1))
    return met.groupBy("block", "query_block").applyInArrow(best_of_block, "q long, part int, best array<struct<s: double, id: bigint>>")

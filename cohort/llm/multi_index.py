"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own (k-means on a bounded sample); a vector's cell is the
pair of its nearest codewords, a place in the product grid.  A probe visits cells in the order of a multi-sequence
traversal: both halves list their codewords from likeliest to least likely to hold a neighbour at the
threshold's distance, and a heap walks the pairs of both lists by falling joint likelihood, until those visited sum to the
target recall.  Vectors in visited cells of the same label are compared exactly.

Exact copies are one class.  Cells meet their probes in blocks of bounded size (see ``blocks``), each a matrix
product; a block gives back, for each of its vectors, the number of links found and one edge to its local
component, never the pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs
from .common import checkpointed, ref
from .components import connected_components

THRESHOLD = 0.93
#: Cosines nearer to the threshold than this are computed pair by pair.
EDGE = 1e-9
TARGET_RECALL = 0.98
#: Codebooks are fitted on so many vectors, the first by a hash of their values.
FIT_ROWS = 20_000
#: Vectors of a label that a cell should hold on average; the grid grows with the table.
CELL_ROWS = 64
MAX_CODEWORDS = 1024
BLOCK_ROWS = 512


def valid_vector(vector) -> F.Column:
    """True for vectors that can be compared: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by the largest component first, so nothing overflows."""
    x = np.array(list(vectors), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed start; empty codewords keep their place."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])


def likelihoods(x: np.ndarray, c: np.ndarray, spread: float) -> np.ndarray:
    """How likely a neighbour's half, displaced by about ``spread`` in each direction, falls to each codeword.

    For codeword j it must cross the plane between the own codeword and j: a Gaussian tail of the distance to that plane.
    Rows are scaled to sum to one.
    """
    d = distances(x, c)
    own = d.argmin(1)
    apart = np.sqrt(distances(c, c))[own]
    gap = d - d[np.arange(len(x)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(apart > 0, gap / (2 * apart * spread), 0.0)
    tail = 0.5 * np.vectorize(math.erfc, otypes=[float])(np.minimum(z, 8.0) / math.sqrt(2))
    return tail / tail.sum(1, keepdims=True)


def multi_sequence(p: np.ndarray, q: np.ndarray, target: float) -> list[tuple[int, int]]:
    """Cells (i, j) by falling p[i] * q[j] until they sum to ``target``."""
    pi, qi = np.argsort(-p, kind="stable").tolist(), np.argsort(-q, kind="stable").tolist()
    ps, qs = p[pi].tolist(), q[qi].tolist()
    heap, pushed, out, mass = [(-ps[0] * qs[0], 0, 0)], {(0, 0)}, [], 0.0
    while heap and mass < target:
        w, a, b = heapq.heappop(heap)
        out.append((pi[a], qi[b]))
        mass -= w
        for n in ((a + 1, b), (a, b + 1)):
            if n[0] < len(ps) and n[1] < len(qs) and n not in pushed:
                pushed.add(n)
                heapq.heappush(heap, (-ps[n[0]] * qs[n[1]], *n))
    return out


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Comparable rows with equal label and vector as one class: ``(cls, label, v, n, least)``."""
    rows = vectors.select(ref(id_col).alias("id"), ref(vector_col).alias("v"), ref(label_col).alias("label"))
    good = rows.where(F.col("label").isNotNull() & valid_vector(F.col("v")))
    return good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Links join rows of equal label whose cosine is at least ``threshold``; every reported link is exact.  Rows with a
    null label or a vector that is null, empty, zero or not finite link with nothing.  Extra columns are ignored, ties have no
    order to break.  Vectors of different
    length do not link; each length has jobs of its own.  Repeated rows count as rows of their own; null ids link, but name no component.  An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    keyed = _classes(vectors, id_col, vector_col, label_col).withColumn("dim", F.size("v"))
    # numbers, not hashes: no two classes share a name, however many there are; the checkpoint keeps them as they are
    classes = checkpointed(keyed.withColumn("cls", F.monotonically_increasing_id()))
    shapes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).orderBy("dim").collect()
    found = [_links_of_width(classes.where(F.col("dim") == s.dim), s.n, s.labels, threshold, target_recall) for s in shapes if s.n > 1]
    nothing = spark.createDataFrame([], "cls long, links long, root long")
    links = nothing
    for f in found:
        links = links.unionByName(f)
    links = checkpointed(links)
    roots = connected_components(links.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    named = (
        classes.select("cls", "label", "v", "n", "least").join(counted, "cls", "left")
        .join(roots.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .withColumn("root", F.coalesce("component", "cls"))
    )
    least = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    per_class = checkpointed(
        named.join(least, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    )
    rows = vectors.select(ref(id_col).alias("id"), ref(vector_col).alias("v"), ref(label_col).alias("label"))
    out = rows.join(per_class, ["label", "v"], "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _links_of_width(classes: DataFrame, n: int, labels: int, threshold: float, target: float) -> DataFrame:
    """Links among classes of one vector length: ``(cls, links, root)`` rows, to be summed by class."""
    spark = classes.sparkSession
    sample = unit_rows(r.v for r in classes.select("cls", "v", F.xxhash64("label", "v").alias("h")).orderBy("h", "cls").limit(FIT_ROWS).collect())
    half = max(1, sample.shape[1] // 2)
    k = int(min(MAX_CODEWORDS, max(2, math.ceil(math.sqrt(n / max(1, labels) / CELL_ROWS)))))
    books = [codebook(sample[:, :half], k), codebook(sample[:, half:], k)] if sample.shape[1] > 1 else [codebook(sample, k), np.zeros((1, 0))]
    # a neighbour at the threshold is this far away, spread over all directions
    spread = math.sqrt(2 * (1 - threshold)) / math.sqrt(sample.shape[1])
    shared = spark.sparkContext.broadcast(books)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = shared.value
        for b in batches:
            x = unit_rows(b["v"])
            p = likelihoods(x[:, :half], first, spread)
            q = likelihoods(x[:, half:], second, spread) if len(second) > 1 else np.ones((len(x), 1))
            cells = [[i * len(second) + j for i, j in multi_sequence(p[r], q[r], target)] for r in range(len(x))]
            home = nearest(x[:, :half], first) * len(second) + (nearest(x[:, half:], second) if len(second) > 1 else 0)
            yield pd.DataFrame({"cls": b["cls"], "label": b["label"], "n": b["n"], "home": home, "cells": cells, "v": [r.tobytes() for r in x]})

    label_type = classes.schema["label"].dataType.simpleString()
    indexed = checkpointed(
        classes.select("cls", "label", "n", "v").mapInPandas(visits, f"cls long, label {label_type}, n long, home long, cells array<long>, v binary")
    )
    keep = [F.col("cls").alias("id"), "n", "home", "cells", "v"]
    visited = indexed.select("*", F.explode("cells").alias("cell"))
    probes = visited.select(F.struct("label", "cell").alias("key"), *keep)
    members = indexed.select(F.struct("label", F.col("home").alias("cell")).alias("key"), *keep)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        x, y = (np.frombuffer(b"".join(s["v"]), dtype=np.float64).reshape(len(s), -1) for s in (a, b))
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        score = x @ y.T
        # a matrix product's last bits depend on its shape; pairs at the threshold are scored alone, the same way in every block
        i, j = np.nonzero(np.abs(score - threshold) < EDGE)
        score[i, j] = (x[i] * y[j]).sum(axis=1)
        near = (score >= threshold) & (ia[:, None] != ib[None, :])
        if not near.any():
            return pd.DataFrame({"cls": [], "links": [], "root": []}).astype("int64")
        links_a = near @ b["n"].to_numpy()
        # the member counts the probe here unless it looks into the probe's cell itself
        home, seen = a["home"].to_numpy(), near.copy()
        for j in np.flatnonzero(near.any(axis=0)):
            seen[:, j] &= ~np.isin(home, b["cells"].iloc[j])
        links_b = a["n"].to_numpy() @ seen
        root_a, root_b = ia.copy(), ib.copy()
        while True:
            low_a = np.minimum(root_a, np.where(near, root_b[None, :], np.iinfo(np.int64).max).min(axis=1))
            low_b = np.minimum(root_b, np.where(near, low_a[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (low_a == root_a).all() and (low_b == root_b).all():
                break
            root_a, root_b = low_a, low_b
        ra, rb = near.any(axis=1), near.any(axis=0)
        return pd.DataFrame({
            "cls": np.concatenate([ia[ra], ib[rb]]), "links": np.concatenate([links_a[ra], links_b[rb]]).astype("int64"),
            "root": np.concatenate([root_a[ra], root_b[rb]]),
        })

    return block_pairs(probes, members, BLOCK_ROWS).groupBy("key", "block").applyInPandas(compare, "cls long, links long, root long")

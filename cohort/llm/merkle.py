"""Merkle manifest of a dataset: one root over all rows, and for each row a proof that it belongs to it.

A source's rows, by id, are the leaves of a tree of fan-out 16; the sources' roots are the leaves of the top tree.  Trees are cut
into aligned blocks of three levels (4,096 leaves).  A block is stored as one buffer in van Emde Boas order: the levels are
split at half height, the upper half comes first, then each lower subtree, and so on in each, so that a node's address follows from
depth and number alone, and a path from leaf to block root touches few stretches of the buffer.  The roots of a tree's blocks are
the leaves of its next blocks: rounds grow with the logarithm of the largest source to base 4,096.

Going up, a round groups leaves by (tree, place / 4,096), at most 4,096 rows, so that a source with most of the rows is many groups.
Going down, a round hands each block the siblings above its root.  Places are distributed ranks (``numbered``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialize, numbered
from .common import checkpoint_dir, ref

FAN_OUT = 16
#: Levels of edges in a block.
HEIGHT = 3
BLOCK = FAN_OUT**HEIGHT
SIZE = 32
#: Bytes of buffers, or leaves, that a task gathers before it hands them on.
HELD, LEAVES = 4 << 20, 1024
VALUES = "doc_id", "source", "lang", "n_chars", "text"
PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
PATH_TYPE = "array<struct<before:string,after:string>>"


@cache
def room(levels: int) -> int:
    """Nodes of a full subtree with so many levels of nodes."""
    return (FAN_OUT**levels - 1) // (FAN_OUT - 1)


def addresses(depth: int, numbers: np.ndarray, levels: int) -> np.ndarray:
    """Places in the buffer of a depth's nodes, in a van Emde Boas layout of ``levels`` levels of nodes."""
    if levels == 1:
        return np.zeros_like(numbers)
    upper = levels // 2
    if depth < upper:
        return addresses(depth, numbers, upper)
    below, width = levels - upper, FAN_OUT ** (depth - upper)
    return room(upper) + numbers // width * room(below) + addresses(depth - upper, numbers % width, below)


def levels_over(n: int) -> int:
    """Levels of edges from ``n`` leaves to one node."""
    levels = 0
    while FAN_OUT**levels < n:
        levels += 1
    return levels


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def widths(n: int, levels: int) -> list[int]:
    """Nodes at each depth of a block with ``n`` leaves, from the root down."""
    return [-(-n // FAN_OUT ** (levels - depth)) for depth in range(levels + 1)]


def build(leaves: list[bytes], levels: int) -> bytes:
    """The buffer of a block; what a last block lacks at the end is cut off."""
    counts = widths(len(leaves), levels)
    where = [addresses(d, np.arange(n), levels + 1) for d, n in enumerate(counts)]
    nodes = np.zeros((max(int(w[-1]) for w in where) + 1, SIZE), np.uint8)
    nodes[where[levels]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, SIZE)
    step = FAN_OUT * SIZE * 2
    for depth in range(levels - 1, -1, -1):
        text = nodes[where[depth + 1]].tobytes().hex()
        made = b"".join(hashlib.sha256(text[i * step : (i + 1) * step].encode("ascii")).digest() for i in range(counts[depth]))
        nodes[where[depth]] = np.frombuffer(made, np.uint8).reshape(-1, SIZE)
    return nodes.tobytes()


def siblings(buffer: bytes, n: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf, from the leaf up: the hex text of the digests left and right of it in its run."""
    nodes = np.frombuffer(buffer, np.uint8).reshape(-1, SIZE)
    counts = widths(n, levels)
    texts = [nodes[addresses(d, np.arange(c), levels + 1)].tobytes().hex() for d, c in enumerate(counts)]
    runs: list[list[tuple[str, str]]] = []
    for depth in range(levels, 0, -1):  # each node's pair is made once, however many leaves share it
        text, pairs = texts[depth], []
        for i in range(counts[depth]):
            start, end = i // FAN_OUT * FAN_OUT * 64, min((i // FAN_OUT + 1) * FAN_OUT, counts[depth]) * 64
            pairs.append((text[start : i * 64], text[i * 64 + 64 : end]))
        runs.append(pairs)
    return [[pairs[leaf // FAN_OUT**up] for up, pairs in enumerate(runs)] for leaf in range(n)]


def fold(value: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        value = digest_of(before + value + after)
    return value


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hex digest of values, each as its UTF-8 length, a colon and its text, or ``-`` where null."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _up(items: DataFrame) -> DataFrame:
    """Blocks ``(tree, block, n, extent, root, nodes, members)`` over ``items(tree, n, at, digest, member)``; ``n`` is the tree's extent."""
    grouped = (
        items.groupBy("tree", F.floor(F.col("at") / BLOCK).cast("long").alias("block"))
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", "member"))).alias("rows"))
        .select("tree", "block", "n", F.col("rows.digest").alias("digests"), F.col("rows.member").alias("members"))
    )
    names = ["tree", "block", "n", "extent", "root", "nodes", "members"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, extents, roots, nodes, held = 0, [], [], [], 0
            for row in range(batch.num_rows):
                digests, n = batch.column("digests")[row].as_py(), batch.column("n")[row].as_py()
                nodes.append(build(digests, HEIGHT if n > BLOCK else levels_over(n)))
                roots.append(nodes[-1][:SIZE])  # the root stands first in any such layout
                extents.append(len(digests))
                held += len(nodes[-1])
                if held > HELD or row == batch.num_rows - 1:
                    part = batch.slice(start, len(nodes))
                    made = [pa.array(extents, pa.int64()), pa.array(roots, pa.binary()), pa.array(nodes, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *made, part.column("members")], names)
                    start, extents, roots, nodes, held = row + 1, [], [], [], 0

    kind = grouped.schema["members"].dataType.simpleString()
    return grouped.mapInArrow(blocks, f"tree string, block long, n long, extent long, root binary, nodes binary, members {kind}")


def _grow(items: DataFrame, path: str, name: str) -> list[DataFrame]:
    """All rounds of blocks over ``items``, each written under ``path`` and read again."""
    spark, rounds = items.sparkSession, []
    while True:
        folder = f"{path}/{name}-{len(rounds)}"
        _up(items).write.parquet(folder)
        blocks = spark.read.parquet(folder)
        rounds.append(blocks)
        rest = blocks.where(F.col("n") > BLOCK)
        if rest.isEmpty():
            return rounds
        items = rest.select("tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("at"), F.col("root").alias("digest"), F.lit(0).alias("member"))


def _paths(blocks: DataFrame, above: DataFrame, member: str) -> DataFrame:
    """``(tree, block, at, member, path)`` of every leaf of ``blocks``: its siblings up to the top, given those ``above`` each block's root."""
    met = blocks.select("tree", "block", "n", "extent", "nodes", "members").join(above, ["tree", "block"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, block, n, extent, nodes, up = (batch.column(c)[row].as_py() for c in ("tree", "block", "n", "extent", "nodes", "path"))
                outer = [(p["before"], p["after"]) for p in up]
                found = siblings(nodes, extent, HEIGHT if n > BLOCK else levels_over(n))
                members = batch.column("members").slice(row, 1).flatten()
                for lo in range(0, extent, LEAVES):  # a path has some thousand characters
                    part = range(lo, min(lo + LEAVES, extent))
                    paths = pa.array([[{"before": b, "after": a} for b, a in [*found[i], *outer]] for i in part], PATH)
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(part)), pa.array([block * BLOCK + i for i in part]), members.slice(lo, len(part)), paths], ["tree", "at", "member", "path"])

    return met.mapInArrow(spread, f"tree string, at long, member {member}, path {PATH_TYPE}")



def _down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """``(tree, block, path)`` above the blocks of the first round, from ``top(tree, path)`` above each tree's root."""
    above = None
    for r in range(len(rounds) - 1, -1, -1):
        # a tree whose only block is in this round hangs on its path in the top tree
        last = rounds[r].where(F.col("n") <= BLOCK).select("tree", "block").join(top, "tree").select("tree", "block", "path")
        above = last if above is None else last.unionByName(_paths(rounds[r + 1], above, "int").select("tree", F.col("at").alias("block"), "path"))
        above = materialize(above) if r else above
    return above


def manifest(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", tree_col: str = "source", value_cols: Sequence[str] = VALUES,
    tampered: Column | None = None, tampered_values: Sequence[Column] = (),
) -> DataFrame:
    """A row ``(id_col, leaf, subroot, root, proof, folded_root, verified)`` for each of ``docs``; blocks are written under ``path``.

    ``leaf`` is the digest of the value columns; ``proof`` that of all siblings, from the leaf to the root.  ``folded_root`` is
    computed from the siblings and the leaf, or, where ``tampered`` holds, from the leaf of ``tampered_values`` instead.

    Null sources form the first tree, null ids come first in theirs.  Equal ids are ordered by leaf; equal rows have equal leaves,
    each its own place and proof.  An empty table gives no rows and no blocks.  Texts of any length are digested whole, in the JVM.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_digest(tampered_values))
    source = ref(tree_col).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))  # null before all texts, texts in byte order
    leaves = materialize(docs.select(tree.alias("tree"), ref(id_col).alias("id"), F.unhex(leaf_digest([ref(c) for c in value_cols])).alias("digest"), F.unhex(changed).alias("changed")))
    id_type = leaves.schema["id"].dataType.simpleString()
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    items = numbered(leaves, ["tree"], ["id", "digest"], "at").join(sizes, "tree")
    rounds = _grow(items.select("tree", "n", "at", "digest", F.struct("id", "changed").alias("member")), path, "rows")
    # the top tree: a leaf for each source
    roots = rounds[0].where(F.col("n") <= BLOCK).select("tree", "root")
    for more in rounds[1:]:
        roots = roots.unionByName(more.where(F.col("n") <= BLOCK).select("tree", "root"))
    placed = materialize(numbered(roots, [], ["tree"], "at"))
    top_items = placed.select(F.lit("").alias("tree"), F.lit(placed.count()).cast("long").alias("n"), "at", F.col("root").alias("digest"), F.col("tree").alias("member"))
    tops = _grow(top_items, path, "sources")
    start = spark.createDataFrame([("", [])], f"tree string, path {PATH_TYPE}")
    root = tops[-1].where(F.col("n") <= BLOCK).agg(F.lower(F.hex(F.max("root")))).first()[0]  # the only block of the last round; null for an empty table
    subroots = roots.select("tree", F.lower(F.hex("root")).alias("subroot"))
    above = _down(tops, start)
    paths = _paths(tops[0], above, "string").select(F.col("member").alias("tree"), "path")
    above_rows = _down(rounds, materialize(paths)).join(subroots, "tree").withColumn("root", F.lit(root).cast("string"))
    return _proofs(rounds[0], above_rows, id_type).withColumnRenamed("id", id_col)


def _proofs(blocks: DataFrame, above: DataFrame, id_type: str) -> DataFrame:
    """The rows of ``manifest``: each block's leaves with their siblings, digested and folded."""
    met = blocks.select("tree", "block", "n", "extent", "nodes", "members").join(above, ["tree", "block"])

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[tuple[str, str, str, str, str, bool]] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            arrays = [pa.concat_arrays(ids), *(pa.array(c) for c in columns)]
            ids.clear(), rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"])

        for batch in batches:
            for row in range(batch.num_rows):
                n, extent, nodes, up, subroot, root = (batch.column(c)[row].as_py() for c in ("n", "extent", "nodes", "path", "subroot", "root"))
                levels = HEIGHT if n > BLOCK else levels_over(n)
                outer = [(p["before"], p["after"]) for p in up]
                outer_text = "".join(b + a for b, a in outer)
                leaves = np.frombuffer(nodes, np.uint8).reshape(-1, SIZE)[addresses(levels, np.arange(extent), levels + 1)].tobytes().hex()
                members = batch.column("members").slice(row, 1).flatten()
                ids.append(members.field("id"))
                for i, (changed, path) in enumerate(zip(members.field("changed").to_pylist(), siblings(nodes, extent, levels), strict=True)):
                    leaf = leaves[i * 64 : i * 64 + 64]
                    proof = digest_of("".join(b + a for b, a in path) + outer_text)
                    folded = fold(leaf if changed is None else changed.hex(), [*path, *outer])
                    rows.append((leaf, subroot, root, proof, folded, folded == root))
                if len(rows) >= LEAVES:
                    yield out()
        if rows:
            yield out()

    return met.mapInArrow(proofs, f"id {id_type}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")

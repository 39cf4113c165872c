import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.llm import merkle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i // 16 * 16
        run = nodes[start : start + 16]
        out.append(("".join(run[: i - start]), "".join(run[i - start + 1 :])))
        i //= 16
    return out


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = mine, levels_of([leaf_of(r) for r in mine])
    top = levels_of([trees[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        mine, levels = trees[s]
        for i, r in enumerate(mine):
            path = path_of(levels, i) + path_of(top, k)
            value = levels[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                value = leaf_of((*r[:4], None if r[4] is None else r[4].translate(str.maketrans(UPPER, LOWER))))
            for before, after in path:
                value = sha(before + value + after)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], sha("".join(b + a for b, a in path)), value, value == top[-1][0]))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "at": F.lit(2), "digest": F.lit("x")})
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", UPPER, LOWER)]
    return merkle.manifest(docs, tampered=tampered, tampered_values=values)


def some(rng, i, source):
    return i, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Abc " * rng.randrange(5), None, "é", "x", "", "Z" * 100_000])


@pytest.mark.parametrize("levels", range(1, 6))
def test_layout(levels):
    whole = [merkle.addresses(d, np.arange(16**d), levels) for d in range(levels)]
    assert whole[0][0] == 0 and sorted(np.concatenate(whole).tolist()) == list(range(merkle.room(levels)))
    if levels == 4:  # halves: two levels above, then 256 subtrees of two levels, each in one stretch
        assert sorted(np.concatenate(whole[:2]).tolist()) == list(range(17))
        children = whole[3].reshape(256, 16)
        assert (children == whole[2][:, None] + 1 + np.arange(16)).all()


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_block(n):
    rng = random.Random(n)
    leaves = [rng.randbytes(32) for _ in range(n)]
    levels = merkle.levels_over(n)
    want = levels_of([x.hex() for x in leaves])
    buffer = merkle.build(leaves, levels)
    assert buffer[:32].hex() == want[-1][0]
    found = merkle.siblings(buffer, n, levels)
    for i in {0, n // 2, n - 1}:
        assert found[i] == path_of(want, i) and merkle.fold(leaves[i].hex(), found[i]) == want[-1][0]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [some(rng, rng.choice([None, *range(300)]), rng.choice(["a", "b", "ü", None, "", "z", "Z"])) for _ in range(500)]
    rows += rows[:30]
    assert sorted(map(tuple, run(spark, rows).collect()), key=str) == sorted(brute(rows), key=str)
    one = [some(rng, 1, "a")]
    assert list(map(tuple, run(spark, one).collect())) == brute(one)
    assert run(spark, []).collect() == []


def test_many_rounds(spark, monkeypatch):
    """Blocks of 16 leaves: trees of four rounds, a source with most rows, many sources with one row."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rng = random.Random(2)
    rows = [some(rng, i, f"s{i}") for i in range(40)] + [(i, "hot", "en", i, f"Text {i}") for i in range(5000)]
    found = run(spark, rows).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))
    assert 0 < sum(not r.verified for r in found) < len(found)


def test_blocks_are_stored(spark, tmp_path):
    rows = [(i, "a", None, None, "t") for i in range(300)]
    path = f"file://{tmp_path}/manifest"
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    root = merkle.manifest(docs, path).first().root
    (block,) = spark.read.parquet(f"{path}/rows-0").collect()
    assert block.extent == 300 and len(block.nodes) < 32 * merkle.room(4)  # what a last block lacks is not stored
    assert spark.read.parquet(f"{path}/sources-0").first().root.hex() == root == levels_of([leaf_of(r) for r in rows])[-1][0]

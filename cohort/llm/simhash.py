"""SimHash near-duplicates by Golay-code fuzzy keys.

A text's words (A-Z lower-cased, split at ``\\x20 \\x09-\\x0D``) give word shingles, each hashed with XXH64
(seed 42); a fingerprint bit is 1 if it is set in over half of the hashes.  Texts with fewer words than a
shingle give one shingle of all their words; texts without words (null, empty, blank) have fingerprint 0,
which links like any other.

Two fingerprints link at two or fewer differing bits.  To find them, a fingerprint is cut in three segments.
Two errors leave one segment untouched (pigeonhole), and the 23 bits that follow it hold at most two errors.
The perfect (23, 12) Golay code decodes every 23-bit string to one codeword within three errors, so two strings at
distance two or less have a string between them, one step from both: the codeword indices to which a string
and its 23 neighbours decode (one or six of them) always include a common one.  Keys are (segment, its exact
bits, codeword index): about 16 a fingerprint, 33 bits each.  Distinct fingerprints join on them and are verified.

Buckets of more than ``BUCKET`` distinct fingerprints are not paired.  Their fingerprints meet at midpoints
instead: every string within one bit of a fingerprint is a key (65 of them), all fingerprints at one midpoint
differ in two bits or less, and each links to the smallest there.  That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import checkpointed, fresh, ref
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
BUCKET = 32
MAX_BITS = 2  # what the segments and the Golay keys are built for

# The binary Golay code of length 23: generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def _syndrome_table() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each single bit, error pattern of weight <= 3 for each of the 2048 syndromes)."""
    bit = []
    for i in range(23):
        s = 1 << i
        for d in range(22, 10, -1):
            if s >> d & 1:
                s ^= _GENERATOR << (d - 11)
        bit.append(s)
    error = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        error[bit[i]] = 1 << i
        for j in range(i):
            error[bit[i] ^ bit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[bit[i] ^ bit[j] ^ bit[k]] = 1 << i | 1 << j | 1 << k
    return np.array(bit, dtype=np.int64), error


BIT_SYNDROME, ERROR_OF = _syndrome_table()


def golay_indices(strings: np.ndarray) -> np.ndarray:
    """For 23-bit strings: the codeword indices of each string and of its 23 neighbours, shape (n, 24)."""
    syndrome = np.zeros(len(strings), dtype=np.int64)
    for i in range(23):
        syndrome ^= (strings >> i & 1) * BIT_SYNDROME[i]
    flips = np.concatenate([[0], 1 << np.arange(23)])
    moved = syndrome[:, None] ^ np.concatenate([[0], BIT_SYNDROME])[None, :]
    return (strings[:, None] ^ flips[None, :] ^ ERROR_OF[moved]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> list[np.ndarray]:
    """Distinct keys of each fingerprint (int64 in, one int64 array each out)."""
    fp = fingerprints.astype(np.uint64)
    rows = []
    for which, (start, width) in enumerate(((0, 22), (22, 21), (43, 21))):
        turned = (fp >> np.uint64(start)) | (fp << np.uint64(64 - start) if start else np.uint64(0))
        exact = (turned & np.uint64((1 << width) - 1)).astype(np.int64)
        rest = (turned >> np.uint64(width) & np.uint64((1 << 23) - 1)).astype(np.int64)
        rows.append((which << 34 | exact << 12)[:, None] | golay_indices(rest))
    keys = np.sort(np.concatenate(rows, axis=1), axis=1)
    first = np.ones(keys.shape, dtype=bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return [k[f] for k, f in zip(keys, first, strict=True)]


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of one whole text."""
    # bytes.lower() and bytes.split() are exactly A-Z and \x20 \x09-\x0D
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles: Iterator[bytes] = iter((b" ".join(w),))
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest, n, ones, part = xxhash.xxh64_digest, 0, np.zeros(64, dtype=np.int64), []
    for s in shingles:
        part.append(digest(s, seed))
        if len(part) == 16384:
            n, part = n + _count(part, ones), []
    n += _count(part, ones) if part else 0
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _count(part: list[bytes], ones: np.ndarray) -> int:
    bits = np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(-1, 8), axis=1)
    ones += bits.sum(axis=0, dtype=np.int32)
    return len(part)


def _fingerprint_udf(words: int, seed: int):
    @F.pandas_udf(LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words, seed) for t in texts], dtype="int64")

    return fingerprint


def with_fingerprint(docs: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` plus its fingerprint as a long in column ``out``."""
    return docs.withColumn(out, _fingerprint_udf(words, seed)(ref(text)))


def _explode_keys(prints: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fp": b["fp"], "ks": fuzzy_keys(b["fp"].to_numpy())})

    return prints.mapInPandas(keys, "fp long, ks array<long>").select("fp", F.explode("ks").alias("k"))


def link_fingerprints(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct ``prints(fp)`` -> ``edges(a, b)`` whose components are those of all links at distance <= 2.

    Every pair in a small bucket is verified; in large buckets each fingerprint gets an edge to the smallest
    at each of its midpoints, which connects the same fingerprints as all of their links.
    """
    keys = _explode_keys(prints)
    sizes = checkpointed(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = checkpointed(keys.join(sizes, "k"))
    small = shared.where(F.col("n") <= bucket).select("k", "fp")
    near = (
        small.select("k", F.col("fp").alias("a")).join(small.select("k", F.col("fp").alias("b")), "k")
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    midpoints = crowded.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("z"))
    least = checkpointed(midpoints.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("z", "b"))
    star = midpoints.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.unionByName(star)


def _marked_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp, root, component_id)`` a row; root is the smallest fingerprint of the component."""
    marked = checkpointed(
        with_fingerprint(docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")), "text", "fp").select("id", "fp")
    )
    prints = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = connected_components(link_fingerprints(prints.select("fp")))
    rooted = prints.join(roots.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least_id"
    )
    named = checkpointed(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    per_print = checkpointed(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id"))
    return marked.join(per_print, "fp").select("id", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint long, component_id)`` for every row; component_id is the smallest id reachable by links.

    Null ids take part but name no component (a component without any id has component_id null); repeated rows
    each get their row.  Extra columns are ignored.  An empty table gives an empty result.
    """
    found = _marked_components(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    All columns stay.  Of several rows with the smallest id (or, in a group without ids, of all its rows) that with
    the smallest fingerprint, then text, stays.
    """
    marked = checkpointed(_marked_components(docs, id_col, text_col))
    heads = checkpointed(
        marked.where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min("component_id").alias("head"), F.min("fp").alias("head_fp"), F.count(F.lit(1)).alias("n"))
    )
    fp, head, head_fp, rank = fresh(docs, "fp_", "head_", "head_fp_", "rank_")
    wanted = heads.select(F.col("head").alias(head), F.col("head_fp").alias(head_fp))
    same_id = ref(id_col).eqNullSafe(ref(head))
    if marked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # an id names its row, so texts need not be fingerprinted again
        return docs.join(wanted, same_id, "left_semi")
    kept = with_fingerprint(docs, text_col, fp).join(wanted, same_id & (ref(fp) == ref(head_fp)), "left_semi")
    if not heads.where("n > 1").isEmpty():
        repeats = Window.partitionBy(ref(id_col), ref(fp)).orderBy(ref(text_col))
        kept = kept.withColumn(rank, F.row_number().over(repeats)).where(ref(rank) == 1)
    return kept.select(*[ref(c) for c in docs.columns])

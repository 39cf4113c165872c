"""Block joins: all pairs of two keyed sides, cut into blocks of bounded size.

For work that is a matrix product a key (probers x members).  Rows of a hot key are spread over blocks by a hash of
their id; every block of one side meets every block of the other in a task of its own, so no task gathers a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def block_pairs(probes: DataFrame, members: DataFrame, rows: int) -> DataFrame:
    """Two tables ``(key, id, ...)`` of one schema -> their union with ``side`` (0 probes, 1 members) and ``block``.

    Group by ``(key, block)``: each group holds about ``rows`` of either side at most, and each pair of a probe and a
    member of the same key is together in exactly one group.  Keys on one side only are dropped.
    """

    def sizes(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(n))

    parts = checkpointed(sizes(probes, "n_p").join(sizes(members, "n_m"), "key"))
    own = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")

    def dealt(df: DataFrame, mine: str, other: str, side: int) -> DataFrame:
        cols = df.columns
        spread = df.join(parts.select("key", F.col(mine).alias("own"), F.col(other).alias("other")), "key")
        spread = spread.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
        pair = (own * F.col("other") + F.col("o")) if side == 0 else (F.col("o") * F.col("own") + own)
        return spread.select(*cols, F.lit(side).cast("byte").alias("side"), pair.alias("block"))

    return dealt(probes, "n_p", "n_m", 0).unionByName(dealt(members, "n_m", "n_p", 1))

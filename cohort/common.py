"""Names, checkpoints and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, for temporary columns next to its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of this machine only where there is no other (``local``)."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohort-"))
    return named or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared folder: every later read sees the same rows, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows in a bucket, about.
BUCKET_ROWS = 1_000_000


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``bucketed_and_counted`` without the count."""
    return bucketed_and_counted(df, key, buckets)[0]


def bucketed_and_counted(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder in buckets of ``key`` and read it again; and the rows that the write has counted.

    As after ``materialize``, the rows are fixed and outlive executors.  Joins and aggregates on the key need no shuffle of
    them, and the planner knows their size, so it broadcasts them where they are small.  The name in the catalog, without which
    Spark writes no buckets, is gone when this returns; the files stay.

    Spark 4.1 takes a union of bucketed scans to be dealt by bucket, and then reads them without their buckets: an aggregate on top
    does not bring equal keys together.  That shortcut is turned off for the session.
    """
    spark, name = df.sparkSession, f"cohort_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    table = f"spark_catalog.default.{name}"
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved, so it does not need the name any more
    spark.sql(f"DROP TABLE {table}")
    return out, seen.get["rows"]


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` plus ``out``, each row's place from 0 within its group by ``order``, materialized.

    Rows are dealt by ranges of (group, order) and counted; a row's place is the sum of the counts before its range, its place in
    the range, and less the first place of its group.  No window: a group with most of the rows lies in many ranges, and equal
    rows, too.  Null groups and keys come first.  One number a range goes through the driver.
    """
    at, range_, first, start = fresh(df, "at_", "range_", "first_", "start_")
    marked = df.withColumn(at, F.monotonically_increasing_id())  # keeps equal rows apart, so that they can be dealt to many ranges
    keys = [ref(c) for c in (*group, *order, at)]
    dealt = materialize(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(range_, F.shiftright(ref(at), 33)).withColumn(at, ref(at).bitwiseAND((1 << 33) - 1))
    starts, total = [], 0
    for r in dealt.groupBy(range_).count().orderBy(range_).collect():
        starts.append((r[0], total))
        total += r[1]
    begins = df.sparkSession.createDataFrame(starts, f"`{range_}` long, `{start}` long")
    placed = dealt.join(F.broadcast(begins), range_).withColumn(at, ref(at) + ref(start)).drop(range_, start)
    if not group:
        return placed.withColumnRenamed(at, out)
    heads = placed.groupBy(*[ref(c).alias(f"{first}{i}") for i, c in enumerate(group)]).agg(F.min(at).alias(first))
    same = [ref(c).eqNullSafe(ref(f"{first}{i}")) for i, c in enumerate(group)]
    return placed.join(heads, same).withColumn(at, ref(at) - ref(first)).withColumnRenamed(at, out).select(*[ref(c) for c in df.columns], ref(out))


def key_text(c: Column, kind: T.DataType) -> Column:
    """The one text of a key or constant, whatever its type: whole numbers without a fraction, no zeros at a fraction's end, bytes as hex."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, T.DecimalType) and kind.scale:
        return F.regexp_replace(c.cast("string"), r"\.0*$|(\.\d*?)0+$", "$1")
    return F.lower(F.hex(c)) if isinstance(kind, T.BinaryType) else c.cast("string")


def as_type(c: Column, want: T.DataType, have: T.DataType) -> Column:
    """``c`` compared as ``want``, null where it is no such value: keys of two types meet if their texts are the same.

    So ``'7'``, ``7``, ``7.0`` and a decimal ``7.00`` meet, and ``'007'`` meets only ``'007'``; joins stay on the parent's own type.
    """
    if want == have:
        return c
    cast = c.try_cast(want) if not isinstance(have, T.BinaryType) else key_text(c, have).try_cast(want)
    if isinstance(want, T.StringType):
        return key_text(c, have)
    if isinstance(want, T.IntegralType) and isinstance(have, T.IntegralType):
        return cast
    return F.when(key_text(cast, want) == key_text(c, have), cast)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def own_identity(table: str, key: Column) -> Column:
    """``table:key``, the identity of a row that is its own entity."""
    return F.concat(F.lit(table + ":"), key.cast("string"))

"""Scans: whole, projected, filtered, distinct and sampled."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import ref


def parquet_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _constant(value: object, url: str) -> str:
    """A key as a SQL constant of the database behind ``url``."""
    if isinstance(value, int | Decimal) and not isinstance(value, bool):
        return str(value)
    if not isinstance(value, str):
        raise ValueError(f"ranges need a key of whole numbers, decimals or text, not {type(value).__name__}")
    doubled = value.replace("'", "''")
    return "'" + (doubled.replace("\\", "\\\\") if url.startswith(("jdbc:mysql", "jdbc:mariadb")) else doubled) + "'"


def _at(url: str, offset: int) -> str:
    if url.startswith(("jdbc:mysql", "jdbc:mariadb", "jdbc:sqlite")):
        return f"LIMIT 1 OFFSET {offset}"
    return f"OFFSET {offset} ROWS FETCH NEXT 1 ROWS ONLY"


def key_ranges(spark: SparkSession, url: str, table: str, key: str, partitions: int = 8, **options: str) -> list[str]:
    """Predicates that cut a live table into at most ``partitions`` ranges of a key, of equally many rows each.

    The database walks its index of the key, a step of rows at a time, and only the borders come here; so gaps and crowds in the
    key change nothing, and text is cut in the database's own order, whatever its collation.  Borders ascend strictly and ranges are
    half-open: each row is in exactly one, those written since included.  Rows of one value stay together, so name a unique
    key.  Null keys are in the first range; an empty table has one range.
    """
    if partitions < 1:
        raise ValueError("a table is read in one range or more")
    mark = "`" if url.startswith(("jdbc:mysql", "jdbc:mariadb")) else '"'
    name = mark + key.replace(mark, mark * 2) + mark

    def first(query: str):
        return spark.read.format("jdbc").options(url=url, query=query, **options).load().first()

    step = max(1, -(-first(f"SELECT COUNT({name}) AS n FROM {table}")[0] // partitions))
    borders: list[str] = []
    while len(borders) < partitions - 1:
        past, offset = (f"> {borders[-1]}", step - 1) if borders else ("IS NOT NULL", step)
        found = first(f"SELECT {name} AS k FROM {table} WHERE {name} {past} ORDER BY {name} {_at(url, offset)}")
        if found is None:
            break
        borders.append(_constant(found[0], url))
    if not borders:
        return ["1 = 1"]
    between = [f"{name} >= {low} AND {name} < {high}" for low, high in itertools.pairwise(borders)]
    return [f"{name} < {borders[0]} OR {name} IS NULL", *between, f"{name} >= {borders[-1]}"]


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A live table; with a key, read in ranges of it of equally many rows (``key_ranges``), a task and a connection each."""
    if key is None:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return spark.read.jdbc(url, table, predicates=key_ranges(spark, url, table, key, partitions, **options), properties=options)


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The smallest distinct non-null values, up to a cap."""
    c = ref(column)
    return df.where(c.isNotNull()).select(c.alias(column)).distinct().orderBy(ref(column)).limit(limit)


def sample_values(df: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    """Non-null values of up to ``limit`` rows, the first by a hash of the key; repeats stay."""
    return df.where(ref(column).isNotNull()).orderBy(F.sha2(ref(key).cast("string"), 256), ref(key)).limit(limit).select(ref(column))

"""Small helpers shared by the operators: session set-up, checkpoints, column plumbing."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shared_folder

#: White space of all word counts and shingles: a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows in a batch that Spark hands to Python: whole texts are long, and a worker holds a batch two or three times.
BATCH_ROWS = 2_000


#: Spark keeps its Python workers: what a task has freed goes back to the system, not to a pool for the next one.
FREEING = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (no install needed), in bounded batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in FREEING.items():
        env.setdefault(name, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is named, in local mode."""
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder: later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, for temporary columns next to its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def ref(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")

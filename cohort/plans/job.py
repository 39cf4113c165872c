"""A subset job from tables to files, with its record."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame

from ..catalog import Catalog, SubsetSpec
from ..sources.sinks import RunRecord, write_parquet, write_sql
from .subset import Subset, subset


def run_job(
    tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, folder: str, runs_path: str,
    now: datetime | None = None, seed: str = "", dialect: str | None = None,
) -> Subset:
    """Cut, anonymize and write, as Parquet or as a SQL script of a dialect; the run's states go to the table at ``runs_path``.

    Rows are counted by the write itself.  A job that fails anywhere leaves a failed run with its error, and raises it.
    """
    spark = next(iter(tables.values())).sparkSession
    with RunRecord(spark, runs_path) as record:
        out = subset(tables, catalog, spec, now, seed)
        record.warnings += out.warnings
        if dialect is None:
            record.counts |= write_parquet(out.tables, folder)
        else:
            seen, counted = observed(out.tables)
            write_sql(counted, catalog, folder, dialect)
            record.counts |= {n: o.get["rows"] for n, o in seen.items()}
        return out


def observed(tables: Mapping[str, DataFrame]):
    """The tables with an observation each of the rows that pass."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = {n: Observation(f"rows of {n}") for n in tables}
    return seen, {n: df.observe(seen[n], F.count(F.lit(1)).alias("rows")) for n, df in tables.items()}

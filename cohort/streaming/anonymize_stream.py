"""All strategies but the unique guard look at one row, so a stream is anonymized by the batch projection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import FieldStrategy
from ..operators.anonymize import anonymize


def anonymize_stream(stream: DataFrame, table: str, key: str, strategies: Sequence[FieldStrategy], now: datetime | None = None) -> DataFrame:
    """The anonymized stream; faked values equal those of a batch over the same rows."""
    return anonymize(stream, table, key, strategies, now or datetime.now(UTC))


def run_once(stream: DataFrame, table: str, key: str, strategies: Sequence[FieldStrategy], out: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, to Parquet, exactly once; the next run goes on from the checkpoint."""
    ready = anonymize_stream(stream, table, key, strategies)
    return ready.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

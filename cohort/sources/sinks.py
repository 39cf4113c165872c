"""Writing results: Parquet, or SQL text of batched INSERT statements in three dialects."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, ForeignKey
from ..common import ref

BATCH_ROWS = 500
DIALECTS = ("mysql", "postgres", "sqlite")
# Settings under which the text loads as it was written, and those that restore what was there.
SESSION = {
    "mysql": ("SET NAMES utf8mb4;", "SET @COHORT_TIME_ZONE = @@SESSION.time_zone;", "SET @COHORT_SQL_MODE = @@SESSION.sql_mode;", "SET SESSION time_zone = '+00:00';", "SET SESSION sql_mode = 'NO_AUTO_VALUE_ON_ZERO';"),
    "postgres": ("SET client_encoding = 'UTF8';", "SET standard_conforming_strings = on;", "SET TIME ZONE 'UTC';"),
    "sqlite": (),
}
RESTORE = {
    "mysql": ("SET SESSION time_zone = @COHORT_TIME_ZONE;", "SET SESSION sql_mode = @COHORT_SQL_MODE;"),
    "postgres": ("RESET TIME ZONE;", "RESET standard_conforming_strings;", "RESET client_encoding;"),
    "sqlite": (),
}
# Statements that switch foreign keys off and on, and empty a table.
FOREIGN_KEYS_OFF = {"mysql": "SET FOREIGN_KEY_CHECKS = 0;", "postgres": "SET session_replication_role = replica;", "sqlite": "PRAGMA foreign_keys = OFF;"}
FOREIGN_KEYS_ON = {"mysql": "SET FOREIGN_KEY_CHECKS = 1;", "postgres": "SET session_replication_role = origin;", "sqlite": "PRAGMA foreign_keys = ON;"}
TRUNCATE = {"mysql": "TRUNCATE TABLE {};", "postgres": "TRUNCATE TABLE {} CASCADE;", "sqlite": "DELETE FROM {};"}


def quoted(name: str, dialect: str) -> str:
    mark = "`" if dialect == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def text_literal(text: Column, dialect: str) -> Column:
    """A string constant of the dialect: quotes doubled, or escaped by backslash where that is its rule."""
    doubled = F.replace(text, F.lit("'"), F.lit("''"))
    if dialect == "mysql":
        escaped = text
        for raw, spelled in (("\\", "\\\\"), ("\0", "\\0"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\t", "\\t"), ("\x1a", "\\Z"), ('"', '\\"'), ("'", "\\'")):
            escaped = F.replace(escaped, F.lit(raw), F.lit(spelled))
        return F.concat(F.lit("'"), escaped, F.lit("'"))
    if dialect == "postgres":
        plain = F.concat(F.lit("'"), doubled, F.lit("'"))
        slashed = F.concat(F.lit(" E'"), F.replace(doubled, F.lit("\\"), F.lit("\\\\")), F.lit("'"))
        return F.when(text.contains("\\"), slashed).otherwise(plain)
    as_blob = F.concat(F.lit("CAST(X'"), F.lower(F.hex(F.encode(text, "UTF-8"))), F.lit("' AS TEXT)"))
    return F.when(text.contains("\0"), as_blob).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def literal(c: Column, kind: T.DataType, dialect: str) -> Column:
    """A value as a SQL constant, chosen by its type; null is NULL."""
    if isinstance(kind, T.BooleanType):
        yes, no = {"postgres": ("TRUE", "FALSE"), "mysql": ("true", "false")}.get(dialect, ("1", "0"))
        out = F.when(c, yes).otherwise(no)
    elif isinstance(kind, T.DoubleType | T.FloatType):
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        name = F.when(F.isnan(c), "NaN").when(c > 0, "Infinity").otherwise("-Infinity")
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        number = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
        spelled = {"postgres": F.concat(F.lit("'"), name, F.lit("'")), "mysql": name}.get(dialect, F.lit("NULL"))
        out = F.when(odd, spelled).otherwise(number)
    elif isinstance(kind, T.NumericType):
        out = c.cast("string")
    elif isinstance(kind, T.BinaryType):
        digits = F.lower(F.hex(c))
        out = {
            "mysql": F.concat(F.lit("X'"), digits, F.lit("'")),
            "postgres": F.concat(F.lit(" E'\\\\x"), digits, F.lit("'")),
        }.get(dialect, F.concat(F.lit("X'"), digits, F.lit("'")))
    elif isinstance(kind, T.ArrayType) and dialect == "postgres":
        out = text_literal(_postgres_array(c, kind), dialect)
    elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        out = text_literal(F.to_json(c), dialect)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        out = text_literal(_moment(c, kind), dialect)
    else:
        out = text_literal(c.cast("string"), dialect)
    return F.coalesce(out, F.lit("NULL"))


def _moment(c: Column, kind: T.DataType) -> Column:
    """A time's text, with what it has of a second's fraction; instants in UTC, to which the script sets the session."""
    if isinstance(kind, T.TimestampType):
        c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return c.cast("string")


def _postgres_array(c: Column, kind: T.ArrayType) -> Column:
    """``{"a","b",NULL}``, nested arrays inside."""

    def element(x: Column) -> Column:
        if isinstance(kind.elementType, T.ArrayType):
            return F.coalesce(_postgres_array(x, kind.elementType), F.lit("NULL"))
        if isinstance(kind.elementType, T.BinaryType):
            text = F.concat(F.lit("\\x"), F.lower(F.hex(x)))
        elif isinstance(kind.elementType, T.StructType | T.MapType):
            text = F.to_json(x)
        elif isinstance(kind.elementType, T.TimestampType | T.TimestampNTZType):
            text = _moment(x, kind.elementType)
        else:
            text = x.cast("string")
        spelled = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.coalesce(F.concat(F.lit('"'), spelled, F.lit('"')), F.lit("NULL"))

    return F.concat(F.lit("{"), F.array_join(F.transform(c, element), ","), F.lit("}"))


def value_rows(df: DataFrame, dialect: str, generated: Sequence[str] = ()) -> DataFrame:
    """``(row)``: each row as a parenthesized list of constants, generated columns left out."""
    columns = [c for c in df.columns if c not in generated]
    values = [literal(ref(c), df.schema[c].dataType, dialect) for c in columns]
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")")).alias("row"))


def insert_statements(df: DataFrame, table: str, dialect: str, batch: int = BATCH_ROWS, generated: Sequence[str] = ()) -> DataFrame:
    """``(statement)``: INSERTs of up to ``batch`` rows, batched within each partition without a shuffle."""
    columns = ", ".join(quoted(c, dialect) for c in df.columns if c not in generated)
    modifier = " OVERRIDING SYSTEM VALUE" if dialect == "postgres" else ""
    head = f"INSERT INTO {quoted(table, dialect)} ({columns}){modifier} VALUES\n"

    def put(batches):
        import pyarrow as pa

        rows: list[str] = []
        for b in batches:
            for r in b.column(0).to_pylist():
                rows.append(r)
                if len(rows) == batch:
                    yield pa.RecordBatch.from_pydict({"statement": [head + ",\n".join(rows) + ";"]})
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pydict({"statement": [head + ",\n".join(rows) + ";"]})

    return value_rows(df, dialect, generated).mapInArrow(put, "statement string")


def sequence_state(tables: Mapping[str, DataFrame], catalog: Catalog) -> DataFrame | None:
    """``(table, column, value, is_called)`` for sequence columns: the highest value, or 1 not yet used."""
    parts = None
    for t in catalog.tables.values():
        for c in t.sequences:
            if t.name in tables:
                top = F.max(ref(c)).cast("long")
                one = tables[t.name].agg(F.coalesce(top, F.lit(1)).cast("long").alias("value"), top.isNotNull().alias("is_called"))
                one = one.select(F.lit(t.name).alias("table"), F.lit(c).alias("column"), "value", "is_called")
                parts = one if parts is None else parts.unionByName(one)
    return parts


def load_order(names: Sequence[str], foreign_keys: Sequence[ForeignKey]) -> list[str]:
    """Parents before children; tables of a cycle follow by name."""
    waits = {n: {f.parent for f in foreign_keys if f.table == n and f.parent != n and f.parent in names} for n in names}
    out: list[str] = []
    while waits:
        free = sorted(n for n, w in waits.items() if not w - set(out)) or [min(waits)]
        out += free
        for n in free:
            del waits[n]
    return out


def write_sql(tables: Mapping[str, DataFrame], catalog: Catalog, folder: str, dialect: str, batch: int = BATCH_ROWS) -> list[str]:
    """Write one re-runnable script as numbered steps, ``folder/step=NNNN-name/part-*``; returns the steps in load order.

    The header sets the session, switches foreign keys off and empties the tables, children first; a step a table follows, parents
    first; the footer sets sequences and restores the session.  All part files in the order of their paths are the script, as they
    are or put together (``cat``); rows are written by the tasks that have them, none through one task.  It is one job under Spark's
    commit protocol, so a write that fails leaves no step behind.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    if not tables:
        return []
    order = load_order(list(tables), catalog.foreign_keys)
    spark = tables[order[0]].sparkSession
    header = [*SESSION[dialect], FOREIGN_KEYS_OFF[dialect], *[TRUNCATE[dialect].format(quoted(n, dialect)) for n in reversed(order)]]
    footer = [FOREIGN_KEYS_ON[dialect], *RESTORE[dialect]]
    if dialect == "postgres" and (state := sequence_state(tables, catalog)) is not None:
        at = {(r.table, r.column): r for r in state.collect()}  # one row a sequence
        footer = [f"SELECT pg_catalog.setval({_sequence(t, c)}, {r.value}, {str(r.is_called).lower()});" for (t, c), r in at.items()] + footer
    steps = [f"{0:04d}-header", *(f"{i:04d}-{re.sub(r'[^A-Za-z0-9_]', '_', n)}" for i, n in enumerate(order, 1)), f"{len(order) + 1:04d}-footer"]

    def step(name: str, statements: DataFrame) -> DataFrame:
        return statements.select(F.lit(name).alias("step"), F.col("statement").alias("value"))

    def fixed(lines: Sequence[str]) -> DataFrame:
        return spark.createDataFrame([("\n".join(lines),)], "statement string").coalesce(1)

    parts = [step(steps[0], fixed(header))]
    for i, n in enumerate(order, 1):
        generated = catalog.tables[n].generated if n in catalog.tables else ()
        parts.append(step(steps[i], insert_statements(tables[n], n, dialect, batch, generated)))
    parts.append(step(steps[-1], fixed(footer)))
    # a task's rows are of one step, so they need no sort by step before they are written
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, str(len(steps)))
    try:
        reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("step").text(folder)
    finally:
        spark.conf.unset(writers) if before is None else spark.conf.set(writers, before)
    return steps


def _sequence(table: str, column: str) -> str:
    """The call that finds the sequence of a column; both names as text constants."""
    doubled = [quoted(table, "postgres").replace("'", "''"), column.replace("'", "''")]
    return "pg_get_serial_sequence('{}', '{}')".format(*doubled)


def write_parquet(tables: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Write each table, and count its rows in the same job."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"rows of {name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        counts[name] = seen.get["rows"]
    return counts


RUN = "run_id string, at timestamp_ntz, state string, row_counts map<string,bigint>, warnings array<string>, error string"


class RunRecord:
    """A run's states, appended to a table as they come: ``started``, then ``complete`` with counts and warnings, or ``failed`` with the error.

    Used as a context: what leaves it is recorded, whatever the job did.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run_id = spark, path, uuid.uuid4().hex
        self.counts: dict[str, int] = {}
        self.warnings: list[str] = []

    def _append(self, state: str, error: str | None = None) -> None:
        row = (self.run_id, datetime.now(UTC).replace(tzinfo=None), state, dict(self.counts), list(self.warnings), error)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(self.path)

    def __enter__(self) -> RunRecord:
        self._append("started")
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is None:
            self._append("complete")
        else:
            self._append("failed", f"{kind.__name__}: {error}"[:2000])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, started, finished, state, row_counts, warnings, error)``: one row a run, by its last state; ``finished`` is null while it goes on."""
    done = F.col("state") != "started"
    last = F.max_by(F.struct("state", "row_counts", "warnings", "error"), F.struct(done, "at")).alias("last")
    found = spark.read.schema(RUN).parquet(path).groupBy("run_id").agg(F.min("at").alias("started"), F.max(F.when(done, F.col("at"))).alias("finished"), last)
    return found.select("run_id", "started", "finished", "last.*")

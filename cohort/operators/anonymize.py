"""Rewriting values: one projection per table, built on source columns."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import FieldStrategy, IdentitySource, LocaleSource, SpecError, Strategy
from ..common import BUCKET_ROWS, bucketed, column_type, fresh, is_number, is_time, materialize, numbered, own_identity, ref
from ..functions.generators import GENERATORS, generate
from ..functions.jsonpath import overlay, read_path
from ..functions.locale import locale_of
from ..functions.predicates import all_of, as_text
from ..functions.scramble import scramble_before, scramble_first, scramble_last
from ..functions.seeds import fraction, seed

#: Salts that the guard of unique columns tries for a row, and how many of them at once at most.
SALTS, SALTS_AT_ONCE = 1_000, 256


def jitter(c: Column, kind: T.DataType, percent: float, key: Column) -> Column:
    """A number moved by up to ``percent`` of itself; whole values stay whole (half up), what is no number stays."""
    n = c.cast("double") if is_number(kind) else F.trim(c.cast("string")).try_cast("double")
    moved = n * (1 + (fraction(seed(key)) * 2 - 1) * (percent / 100.0))
    y = F.when(n == F.floor(n), F.floor(moved + 0.5).cast("double")).otherwise(moved)
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    if is_number(kind):
        return F.when(usable, y.cast(kind)).otherwise(c)
    return F.when(usable, as_text(y, T.DoubleType())).otherwise(c)


def obfuscate(c: Column, kind: T.DataType, s: Strategy, column: str) -> Column:
    """Scrambled text; numbers are scrambled through their text and stay text; other types are left alone."""
    if not (isinstance(kind, T.StringType) or is_number(kind)):
        return c
    text = as_text(c, kind)
    if s.side == "before":
        return scramble_before(text, column, s.delimiter)
    return scramble_first(text, column, s.count) if s.side == "first" else scramble_last(text, column, s.count)


def rewritten(df: DataFrame, column: str, s: Strategy, identity: Column, row_key: Column, locale: Column, attempt: Column | None = None) -> Column:
    """The value that one strategy gives, for rows that are to be anonymized."""
    c, kind = ref(column), column_type(df, column)
    if s.kind == "preserve":
        return c
    if s.kind == "redact":
        return F.lit(None).cast(kind)
    if s.kind == "jitter":
        return jitter(c, kind, s.percent, F.concat(row_key, F.lit(":" + column)))
    if s.kind == "obfuscate":
        return obfuscate(c, kind, s, column)
    if s.kind == "template":
        known = [b for b in s.bindings if b.action != "fake" or b.generator in GENERATORS]
        return overlay(c.cast("string"), known, F.concat(identity, F.lit(":" + column)), locale, identity)
    if s.generator not in GENERATORS:
        raise SpecError(f"unknown generator {s.generator!r}")
    key = F.concat(identity, F.lit(":" + s.generator))
    if attempt is not None:
        key = F.concat(key, F.when(attempt > 0, F.concat(F.lit(":dup"), attempt.cast("string"))).otherwise(F.lit("")))
    fake = generate(s.generator, key, locale, identity, as_text(c, kind), attempt)
    return F.when(c.isNotNull(), fake.try_cast(kind) if is_time(kind) else fake)


def anonymize(
    df: DataFrame, table: str, key: str, strategies: Sequence[FieldStrategy], now: datetime,
    flag: Column | None = None, identity: Column | None = None, country: Column | None = None, unique: Sequence[str] = (),
    notes: list[str] | None = None,
) -> DataFrame:
    """``df`` with its strategies applied to rows where ``flag`` holds; columns without one pass, in their order.

    An exception is tested on source values, as are all expressions: no strategy sees another's output.  Strategies for
    columns that the table lacks are skipped.  Faked values of ``unique`` columns are kept apart among anonymized rows, as far as
    their generator has values; ``notes`` gets a warning where it has too few.
    """
    flag = F.lit(True) if flag is None else flag
    row_key = own_identity(table, ref(key))
    identity = row_key if identity is None else F.coalesce(identity, row_key)
    locale = locale_of(F.lit(None).cast("string") if country is None else country)
    mine = {s.column: s for s in strategies if s.table == table and s.column in df.columns}
    guarded = [c for c in unique if c in mine and _fakes(mine[c])]

    def value(s: FieldStrategy, attempt: Column | None = None) -> Column:
        main = rewritten(df, s.column, s.strategy, identity, row_key, locale, attempt)
        if s.exception is None:
            return main
        other = rewritten(df, s.column, s.exception.strategy, identity, row_key, locale, attempt)
        test = all_of(df, s.exception.where, s.exception.match, key, now)
        other, main = _alike(other, main, df, s)
        return F.when(test, other).otherwise(main)

    columns, apart = df.columns, {}
    for c in guarded:
        s = mine[c]
        takes_part = flag
        if s.exception is not None:
            test = F.coalesce(all_of(df, s.exception.where, s.exception.match, key, now), F.lit(False))
            fake_there, fake_here = s.exception.strategy.kind == "fake", s.strategy.kind == "fake"
            takes_part = flag & F.when(test, F.lit(fake_there)).otherwise(F.lit(fake_here))
        values, left = keep_apart(df, key, takes_part & ref(c).isNotNull(), lambda attempt, s=s: value(s, attempt))
        pk, chosen = fresh(df, "pk_", "apart_")
        df = df.join(values.select(F.col("pk").alias(pk), F.col("value").alias(chosen)), ref(key) == ref(pk), "left").drop(pk)
        apart[c] = chosen
        if left:
            text = f"{table}.{c}: {left} rows share a value with others after {SALTS} tries each: the generator has too few"
            warnings.warn(text, stacklevel=2)
            if notes is not None:
                notes.append(text)
    out = []
    for c in columns:
        if c not in mine:
            out.append(ref(c))
            continue
        new, old = value(mine[c]), ref(c)
        if _text_output(df, mine[c]):
            new, old = new.cast("string"), as_text(old, column_type(df, c))
        if c in apart:
            new = F.coalesce(ref(apart[c]), new)
        out.append(F.when(flag, new).otherwise(old).alias(c))
    return df.select(*out)


def _fakes(s: FieldStrategy) -> bool:
    return "fake" in (s.strategy.kind, s.exception.strategy.kind if s.exception else "")


def _text_output(df: DataFrame, s: FieldStrategy) -> bool:
    """Strategies that turn a column of another type into text."""
    kinds = {s.strategy.kind} | ({s.exception.strategy.kind} if s.exception else set())
    kind = column_type(df, s.column)
    return ("fake" in kinds and not is_time(kind)) or "template" in kinds or ("obfuscate" in kinds and is_number(kind))


def _alike(a: Column, b: Column, df: DataFrame, s: FieldStrategy) -> tuple[Column, Column]:
    return (a.cast("string"), b.cast("string")) if _text_output(df, s) else (a, b)


def keep_apart(df: DataFrame, key: str, flag: Column, value) -> tuple[DataFrame, int]:
    """``(pk, value)`` for rows with ``flag``: faked values, no two alike; and how many rows had to share one.

    Of rows with the same plain value, that with the smallest key has it.  The others, by their place in that order, start at salts
    1, 2, 3, ... and go on from there, round through all ``SALTS``; of rows that try a free value as their next, the smallest key
    has it.  Rows for which all are taken keep the last salt's.  Places are distributed ranks and values meet in partial ``min``
    aggregates, so a value that most rows have makes no large task.  Values given out are written once, bucketed by value.
    """
    rows = df.where(flag)
    plain = rows.select(ref(key).alias("pk"), value(F.lit(0)).cast("string").alias("value")).where("pk IS NOT NULL")
    buckets = -(-rows.count() // BUCKET_ROWS) or 1
    ranked = bucketed(numbered(plain, ["value"], ["pk"], "rank"), "value", buckets)
    done = [ranked.where("rank = 0").select("pk", "value")]
    turn, start = fresh(rows, "turn_", "start_")
    late = ranked.where("rank > 0").select(F.col("pk").alias(start + "pk"), ((F.col("rank") - 1) % SALTS).alias(start))
    rest = materialize(rows.join(late, ref(key) == ref(start + "pk")).drop(start + "pk"))
    tried, size = 0, 1
    while tried < SALTS and not rest.isEmpty():
        last = min(tried + size, SALTS) - 1
        trying = rest.withColumn(turn, F.explode(F.sequence(F.lit(tried), F.lit(last))))
        salt = ((ref(start) + ref(turn)) % SALTS + 1).cast("int")
        free = trying.select(ref(key).alias("pk"), ref(turn).alias("turn"), value(salt).cast("string").alias("value"))
        for part in done:
            free = free.join(part.select("value"), "value", "left_anti")
        free, won = materialize(free), []
        while not free.isEmpty():
            nearest = free.groupBy("pk").agg(F.min(F.struct("turn", "value"))["value"].alias("value"))
            won.append(bucketed(nearest.groupBy("value").agg(F.min("pk").alias("pk")).select("pk", "value"), "value", buckets))
            free = materialize(free.join(won[-1].select("value"), "value", "left_anti").join(won[-1].select("pk"), "pk", "left_anti"))
        for part in won:
            (mine,) = fresh(rest, "won_")
            rest = rest.join(part.select(F.col("pk").alias(mine)), ref(key) == ref(mine), "left_anti")
        rest, done = materialize(rest) if won else rest, done + won
        tried, size = last + 1, min(2 * size, SALTS_AT_ONCE)
    left = rest.count()
    if left:
        done.append(rest.select(ref(key).alias("pk"), value(F.lit(SALTS)).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, done), left


def country_of(df: DataFrame, source: LocaleSource | None) -> Column:
    """A row's own country value; null without a source."""
    if source is None or source.column not in df.columns:
        return F.lit(None).cast("string")
    return read_path(ref(source.column).cast("string"), source.path) if source.path else ref(source.column).cast("string")


def entity_countries(tables: Mapping[str, DataFrame], sources: Sequence[LocaleSource], keys: Mapping[str, str | None]) -> DataFrame | None:
    """``(entity, country)`` of every row, kept or not, of the tables that know a country."""
    parts = None
    for s in sources:
        if s.table not in tables or keys.get(s.table) is None:
            continue
        df = tables[s.table]
        rows = df.select(own_identity(s.table, ref(keys[s.table])).alias("entity"), country_of(df, s).alias("entity_country"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def declared_identity(df: DataFrame, source: IdentitySource | None) -> Column:
    """The entity that a declared column names, null without one."""
    if source is None or source.column not in df.columns:
        return F.lit(None).cast("string")
    return own_identity(source.entity, ref(source.column))

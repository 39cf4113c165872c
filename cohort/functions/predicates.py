"""Conditions as ``Column`` expressions.

Comparisons follow the column's type; text columns compare as numbers where both sides are numbers.  ``neq``,
``notContains`` and ``notIn`` keep nulls unless told otherwise; no other operator does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import UNITS, WIDENED, Condition, Rule, SpecError
from ..common import column_type, fresh, is_number, is_time, key_text, ref

#: Longer lists are joined instead of listed in the plan.
LISTED_VALUES = 1_000


def cutoff(n: float, unit: str, now: datetime) -> datetime:
    """``now`` less n units, in UTC, to the second; a day that the month lacks rolls into the next month."""
    if unit not in UNITS:
        raise SpecError(f"unknown unit {unit!r}")
    n, now = int(n), now.astimezone(UTC).replace(microsecond=0, tzinfo=None)
    if unit in ("day", "week"):
        return now - timedelta(days=n * (7 if unit == "week" else 1))
    months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
    return now.replace(year=months // 12, month=months % 12 + 1, day=1) + timedelta(days=now.day - 1)


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value's text: whole floating numbers without a fraction, times to the second."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return key_text(c, kind)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def _instant(text: str) -> str:
    return text.replace("T", " ")[:19]


def readable(value: Any, kind: T.DataType) -> str | None:
    """A constant's text as a value of a column's type, None if the type has no such value.

    Numbers are the same however they are spelt (``10``, ``10.0``, ``'10.00'``, ``1e1``); one with more digits than the column
    holds is none of its values.
    """
    if value is None:
        return None
    if is_time(kind):
        return _instant(str(value))
    if not is_number(kind):
        return _spell(value)
    try:
        n = Decimal(_spell(value).strip())
    except InvalidOperation:
        return None
    if isinstance(value, bool) or isinstance(kind, T.DoubleType | T.FloatType):
        return str(value) if not isinstance(value, bool) else None
    if not n.is_finite():
        return None
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    return format(n, "f") if n == 0 or n.normalize().as_tuple().exponent >= -scale else None


def constant(value: Any, kind: T.DataType) -> Column:
    """A constant of the column's own type, so that the filter reaches the scan; null if it cannot be read so."""
    text = readable(value, kind)
    if text is not None and isinstance(kind, T.IntegralType):
        text = text.partition(".")[0]
    typed = is_time(kind) or is_number(kind) or isinstance(kind, T.BooleanType)
    return F.lit(text).try_cast(kind) if typed else F.lit(text)


def _compared(c: Column, kind: T.DataType) -> Column:
    """A column as its constants are compared with it."""
    return c if is_time(kind) or is_number(kind) or isinstance(kind, T.BooleanType) else as_text(c, kind)


def _spell(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _number(value: Any) -> float | None:
    try:
        n = float(value)
    except (TypeError, ValueError):
        return None
    return n if n == n and abs(n) != float("inf") else None


def _compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    def apply(a: Column, b: Column) -> Column:
        return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op]

    if is_time(kind):
        return apply(c, F.lit(_instant(str(value))).try_cast(kind))
    n = _number(value)
    if is_number(kind):
        if n is not None:
            return apply(c, F.lit(value if not isinstance(value, str) else n))
        return apply(as_text(c, kind), F.lit(_instant(str(value))))
    text = apply(F.substring(F.replace(as_text(c, kind), F.lit("T"), F.lit(" ")), 1, 19), F.lit(_instant(str(value))))
    if n is None:
        return text
    as_number = F.trim(c.cast("string")).try_cast("double")
    return F.when(as_number.isNotNull() & ~F.isnan(as_number) & (F.abs(as_number) != float("inf")), apply(as_number, F.lit(n))).otherwise(text)


def java_pattern(pattern: str) -> str:
    """A trailing ``$`` means the very end of the value, not before a last line end."""
    return pattern[:-1] + r"\z" if re.search(r"(?<!\\)(\\\\)*\$$", pattern) else pattern


def one(df: DataFrame, condition: Condition, key: str | None, now: datetime) -> Column:
    """The ``Column`` of one condition; true, false, or (for null values) false."""
    name = condition.column or key
    if name is None:
        raise SpecError("the condition tests the primary key, but the table has no single-column key")
    if name not in df.columns:
        raise SpecError(f"no column {name!r}")
    c, kind, op, value = ref(name), column_type(df, name), condition.op, condition.value
    if op == "isNull":
        return c.isNull()
    if op == "notNull":
        return c.isNotNull()
    low, target = F.lower(as_text(c, kind)), _spell(value if value is not None else "").lower()
    if op == "neq":
        # a constant that cannot be read differs from every value
        different = ~_compared(c, kind).eqNullSafe(constant(value, kind))
        return different | c.isNull() if condition.include_nulls else different & c.isNotNull()
    if op == "eq":
        found = _compared(c, kind) == constant(value, kind)
    elif op in ("lt", "lte", "gt", "gte"):
        found = _compare(c, kind, op, value)
    elif op in ("contains", "notContains"):
        found = low.contains(target)
    elif op == "startsWith":
        found = low.startswith(target)
    elif op == "endsWith":
        found = low.endswith(target)
    elif op in ("in", "notIn"):
        found = _listed(c, kind, value)
    elif op in ("withinLast", "olderThan"):
        n, unit = (value["n"], value["unit"]) if isinstance(value, dict) else value
        at = cutoff(n, unit, now)
        moment = c if is_time(kind) else F.replace(c.cast("string"), F.lit("T"), F.lit(" ")).substr(1, 19)
        limit = F.lit(at).cast(kind) if is_time(kind) else F.lit(at.strftime("%Y-%m-%d %H:%M:%S"))
        found = moment >= limit if op == "withinLast" else moment < limit
    else:
        found = as_text(c, kind).rlike(java_pattern(str(value)))
    if op in ("notContains", "notIn"):
        found = ~found
    if op in WIDENED and condition.include_nulls:
        return F.coalesce(found, F.lit(True))
    return found


def _listed(c: Column, kind: T.DataType, values: Any) -> Column:
    """One of a list's values; null stays null, and values that cannot be read as the column's match nothing."""
    known = [v for v in values if readable(v, kind) is not None] if isinstance(values, (list, tuple)) else []
    if not known:
        return F.when(c.isNotNull(), F.lit(False))
    return _compared(c, kind).isin(*[constant(v, kind) for v in known])


def all_of(df: DataFrame, conditions: Sequence[Condition], match: str, key: str | None, now: datetime) -> Column:
    """Conditions joined by AND (``all``) or OR (``any``); none at all is true."""
    if not conditions:
        return F.lit(True)
    parts = [one(df, c, key, now) for c in conditions]
    return reduce(lambda a, b: a | b, parts) if match == "any" else reduce(lambda a, b: a & b, parts)


def check_raw(raw: str) -> str:
    """A bare predicate: no statement, no ``WHERE``, no semicolon."""
    if not raw.strip() or ";" in raw or re.match(r"\s*(select|with|where)\b", raw, re.IGNORECASE):
        raise SpecError(f"not a bare predicate: {raw!r}")
    return f"({raw})"


def matching(df: DataFrame, rule: Rule, key: str | None, now: datetime) -> DataFrame:
    """Rows of ``df`` that meet a rule's filter.  A raw predicate may use subqueries over temp views.

    A list of over ``LISTED_VALUES`` is joined, so the plan stays small: under ``all`` an ``in`` keeps rows by a left-semi join; elsewhere
    rows are marked.  Its values are read as those of short lists are, so both ways keep the same rows.
    """
    if rule.raw is not None:
        return df.filter(check_raw(rule.raw))
    rest, columns = [], df.columns
    for c in rule.where:
        name = c.column or key
        if c.op not in ("in", "notIn") or not isinstance(c.value, (list, tuple)) or len(c.value) <= LISTED_VALUES or name not in df.columns:
            rest.append(one(df, c, key, now))
            continue
        kind, (value, mark) = column_type(df, name), fresh(df, "listed_", "mark_")
        texts = sorted({t for v in c.value if (t := readable(v, kind)) is not None})
        listed = df.sparkSession.createDataFrame([(t,) for t in texts], "value string").select(_typed("value", kind).alias(value)).distinct()
        same = _compared(ref(name), kind) == ref(value)
        if c.op == "in" and rule.match == "all":
            df = df.join(listed, same, "left_semi")
            continue
        df = df.join(listed.withColumn(mark, F.lit(True)), same, "left")
        found = F.when(ref(name).isNotNull(), ref(mark).isNotNull())
        found = ~found if c.op == "notIn" else found
        rest.append(F.coalesce(found, F.lit(True)) if c.op in WIDENED and c.include_nulls else found)
    if not rest:
        return df
    return df.filter(reduce((lambda a, b: a | b) if rule.match == "any" else (lambda a, b: a & b), rest)).select(*[ref(c) for c in columns])


def _typed(name: str, kind: T.DataType) -> Column:
    """Texts from ``readable`` as values to compare with, as ``constant`` reads one."""
    if isinstance(kind, T.IntegralType):
        return F.substring_index(name, ".", 1).try_cast(kind)
    return ref(name).try_cast(kind) if is_time(kind) or is_number(kind) or isinstance(kind, T.BooleanType) else ref(name)

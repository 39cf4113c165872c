"""Class-preserving scrambling of part of a text.

A digit becomes a digit, a-z and A-Z stay in their class, every other character stays.  The seed is the column and
the value, so equal values scramble alike and joins on the column survive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seeds import seed


def _run(text: Column, key: Column, start: Column, end: Column) -> Column:
    """``text`` with code points start to end - 1 (from 0) scrambled."""

    def change(ch: Column, i: Column) -> Column:
        s = seed(F.concat(key, F.lit(":"), i.cast("string")))

        def shift(low: str, n: int) -> Column:
            return F.char(s % n + ord(low))

        swapped = F.when(ch.between("0", "9"), shift("0", 10)).when(ch.between("a", "z"), shift("a", 26)).when(ch.between("A", "Z"), shift("A", 26)).otherwise(ch)
        return F.when((i >= start) & (i < end) & (F.octet_length(ch) == 1), swapped).otherwise(ch)

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), change), ""))


def scramble_first(text: Column, column: str, n: int) -> Column:
    return _run(text, F.concat(F.lit(column + ":"), text), F.lit(0), F.lit(n))


def scramble_last(text: Column, column: str, n: int) -> Column:
    return _run(text, F.concat(F.lit(column + ":"), text), F.char_length(text) - n, F.char_length(text))


def scramble_before(text: Column, column: str, delimiter: str) -> Column:
    """All before the last delimiter; the whole text if it has none."""
    key = F.concat(F.lit(column + ":"), text)
    if not delimiter:
        return _run(text, key, F.lit(0), F.char_length(text))
    tail = F.substring_index(text, delimiter, -1)
    head = F.char_length(text) - F.char_length(tail) - len(delimiter)
    return _run(text, key, F.lit(0), F.when(F.instr(text, delimiter) == 0, F.char_length(text)).otherwise(head))

"""Deterministic pseudo-random numbers from text keys, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_SPAN = 1 << 48


def seed(key: Column) -> Column:
    """The first 48 bits of the key's SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long")


def derived(key: Column, part: str) -> Column:
    """A seed of its own for one part of a generated value."""
    return seed(F.concat(key, F.lit("#" + part)))


def pick(values: Sequence[str], s: Column) -> Column:
    """One of the values."""
    return F.element_at(F.array(*map(F.lit, values)), (s % len(values) + 1).cast("int"))


def between(lo: int, hi: int, s: Column) -> Column:
    """A whole number from lo to hi."""
    return s % (hi - lo + 1) + lo


def fraction(s: Column) -> Column:
    """From 0 up to 1."""
    return s.cast("double") / float(SEED_SPAN)


def digits(n: int, key: Column, part: str) -> Column:
    """n decimal digits as text, 12 from each seed."""
    chunks = [F.lpad((derived(key, f"{part}{i}") % 10**12).cast("string"), 12, "0") for i in range(-(-n // 12))]
    return F.substring(F.concat(*chunks), 1, n)

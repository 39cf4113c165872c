"""Country values to locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCALES = ("GB", "US", "NL", "DE", "FR", "ES", "IT", "EN")
# Names and codes that stand for a locale.
ALIASES = {
    "UK": "GB",
    "UNITED KINGDOM": "GB",
    "GREAT BRITAIN": "GB",
    "ENGLAND": "GB",
    "SCOTLAND": "GB",
    "WALES": "GB",
    "USA": "US",
    "UNITED STATES": "US",
    "UNITED STATES OF AMERICA": "US",
    "NETHERLANDS": "NL",
    "HOLLAND": "NL",
    "GERMANY": "DE",
    "DEUTSCHLAND": "DE",
    "FRANCE": "FR",
    "SPAIN": "ES",
    "ESPANA": "ES",
    "ITALY": "IT",
    "ITALIA": "IT",
}


def locale_of(country: Column) -> Column:
    """One of ``LOCALES``; EN for null, blank and unknown countries."""
    known = {**{c: c for c in LOCALES}, **ALIASES}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    name = F.upper(F.regexp_replace(country.cast("string"), r"^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(table, name), F.lit("EN"))

"""The subset job: rules, cascade, backfill, flag rules, link tables, emission."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, SubsetSpec
from ..common import fresh, materialize, ref
from ..operators.anonymize import anonymize, country_of, declared_identity, entity_countries
from ..operators.links import detect_links, link_rows
from ..operators.policy import borne_out, check_policies, null_dangling
from ..operators.select import Kept, flag_rules, seed_rows
from ..operators.traverse import Backfill, backfill, cascade


@dataclass
class Subset:
    """The output tables, the kept rows behind them, and what the run reports."""

    tables: dict[str, DataFrame]
    kept: Kept
    backfilled: Backfill
    flagged: DataFrame | None
    tested_for_null: dict[str, list[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def row_counts(self) -> DataFrame:
        """``(table, rows)``."""
        parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in self.tables.items()]
        return reduce(DataFrame.unionByName, parts)

    def largest_first(self) -> DataFrame:
        """``(place, table, rows)`` of the tables with rows, the largest first, then by name; places from 1."""
        by_size = Window.orderBy(F.desc("rows"), "table")  # a row a table
        return self.row_counts().where("rows > 0").select(F.row_number().over(by_size).alias("place"), "table", "rows").orderBy("place")

    def totals(self) -> DataFrame:
        """One row ``(tables_with_rows, rows)``."""
        return self.row_counts().agg(F.count_if(F.col("rows") > 0).alias("tables_with_rows"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def select_rows(tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, now: datetime, seed: str = "", measure: bool = False) -> tuple[Kept, Backfill, DataFrame | None, dict, list[str]]:
    """Kept rows of a job, before anything is emitted; ``measure`` checks the ``null`` policies against the data."""
    policies, warnings = check_policies(catalog, spec)
    if measure and policies:
        policies, more = borne_out(tables, catalog, spec, policies)
        warnings += more
    kept, more = seed_rows(tables, catalog, spec, now, seed)
    warnings += more + cascade(kept, tables, catalog, spec)
    report = backfill(kept, tables, catalog, spec, policies)
    flagged, more = flag_rules(kept, tables, catalog, spec, now)
    return kept, report, flagged, policies, warnings + report.warnings + more


def subset(tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, now: datetime | None = None, seed: str = "", measure: bool = False) -> Subset:
    """Cut and anonymize.  Every table but excluded ones comes out: whole, as a subset, or (structure) without rows."""
    now = now or datetime.now(UTC)
    kept, report, flagged, policies, warnings = select_rows(tables, catalog, spec, now, seed, measure)
    links, more = detect_links(catalog, spec)
    warnings += more
    by_name = {link.table: link for link in links}
    countries = entity_countries(tables, spec.locales, {n: catalog.key(n) for n in tables})
    countries = None if countries is None else materialize(countries)
    out: dict[str, DataFrame] = {}
    tested: dict[str, list[str]] = {}
    for name, df in tables.items():
        cls = spec.class_of(name)
        if cls == "excluded":
            continue
        if cls == "structure":
            out[name] = df.limit(0)
            continue
        if name in by_name:
            rows, more = link_rows(by_name[name], df, kept, catalog, spec)
            warnings += more
        elif cls == "reference":
            rows = df
        else:
            rows = emit(df, name, kept, catalog, spec, countries, now, warnings)
        out[name], columns = null_dangling(rows, name, policies, kept, catalog, spec)
        if columns:
            tested[name] = columns
    return Subset(out, kept, report, flagged, tested, warnings)


def emit(df: DataFrame, name: str, kept: Kept, catalog: Catalog, spec: SubsetSpec, countries: DataFrame | None, now: datetime, notes: list[str] | None = None) -> DataFrame:
    """A table's kept rows, those flagged anonymized; a table with nothing kept has no rows."""
    key, rows = catalog.key(name), kept.rows.get(name)
    if key is None or rows is None:
        return df.limit(0)
    strategies = [s for s in spec.strategies if s.table == name]
    pk, flag, identity, entity, known, known_country, who_col, country = fresh(df, "pk_", "flag_", "identity_", "entity_", "known_", "known_country_", "who_", "country_")
    if not strategies:
        return df.join(rows.select(F.col("pk").alias(pk)), ref(key) == ref(pk), "left_semi")
    flags = rows.select(F.col("pk").alias(pk), F.col("anonymize").alias(flag), F.col("identity").alias(identity))
    source = next((s for s in spec.identities if s.table == name), None)
    who = F.coalesce(declared_identity(df, source), ref(identity), F.concat(F.lit(f"{name}:"), ref(key).cast("string")))
    joined = df.join(flags, ref(key) == ref(pk)).withColumn(who_col, who)
    own = country_of(df, next((s for s in spec.locales if s.table == name), None))
    if countries is not None:
        # what is known about the entity wins, even if it is null
        named = countries.select(F.col("entity").alias(entity), F.col("entity_country").alias(known_country), F.lit(True).alias(known))
        joined = joined.join(named, ref(who_col) == ref(entity), "left")
        own = F.when(ref(known), ref(known_country)).otherwise(own)
    joined = joined.withColumn(country, own)
    done = anonymize(joined, name, key, strategies, now, ref(flag), ref(who_col), ref(country), catalog.tables[name].unique, notes)
    return done.select(*[ref(c) for c in df.columns])


def nulled_counts(result: Subset, tables: Mapping[str, DataFrame], catalog: Catalog) -> DataFrame | None:
    """``(column, nulled)``: values that a ``null`` policy took out, by table.column."""
    parts = []
    for name, columns in result.tested_for_null.items():
        key = catalog.key(name)
        if key is None:
            continue
        pk, *had = fresh(result.tables[name], "pk_", *(f"had_{i}" for i in range(len(columns))))
        before = tables[name].select(ref(key).alias(pk), *[ref(c).isNotNull().alias(h) for c, h in zip(columns, had, strict=True)])
        after = result.tables[name].select(ref(key), *[ref(c) for c in columns]).join(before, ref(key) == ref(pk))
        for c, h in zip(columns, had, strict=True):
            n = after.agg(F.count_if(ref(h) & ref(c).isNull()).alias("nulled"))
            parts.append(n.select(F.lit(f"{name}.{c}").alias("column"), "nulled"))
    return reduce(DataFrame.unionByName, parts) if parts else None

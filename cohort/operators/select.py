"""Seed rows: rules with their takes, merged per table; previews; flag-only rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Rule, SpecError, SubsetSpec, Take
from ..common import BUCKET_ROWS, bucketed, column_type, materialize, ref
from ..functions.predicates import matching


@dataclass
class Kept:
    """Kept rows per table as ``(pk, anonymize, identity)``, and the tables of which a rule keeps every row."""

    rows: dict[str, DataFrame] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)
    #: Buckets of each table's kept rows.
    buckets: dict[str, int] = field(default_factory=dict)

    def buckets_of(self, table: str, df: DataFrame) -> int:
        """Buckets for the kept rows of ``df``, by its number of rows: the same in all rounds, so that rounds are co-located."""
        if table not in self.buckets:
            self.buckets[table] = -(-df.count() // BUCKET_ROWS) or 1
        return self.buckets[table]


def take(df: DataFrame, how: Take, key: str, seed: str = "") -> DataFrame:
    """The rows that a take leaves, after all filtering; a negative count is 0.

    ``sample`` orders by a hash of seed and key: uniform, repeatable, and a bounded top-n instead of a sort.  ``top``
    orders text columns as numbers first; nulls come first ascending and last descending; ties go to the smaller key.
    """
    n = max(0, how.n)
    if how.kind == "sample":
        return df.orderBy(F.sha2(F.concat(F.lit(seed), ref(key).cast("string")), 256), ref(key)).limit(n)
    if how.kind == "top":
        c = ref(how.column)
        by = [c]
        if isinstance(column_type(df, how.column), T.StringType):
            by = [F.trim(c).try_cast("double"), c]
        order = [x.desc_nulls_last() if how.descending else x.asc_nulls_first() for x in by]
        if len(order) == 2:  # text that is no number sorts after numbers, null at its own end
            order.insert(0, c.isNull().asc() if how.descending else c.isNull().desc())
        return df.orderBy(*order, ref(key)).limit(n)
    return df.limit(0) if how.kind == "none" else df


def rule_rows(df: DataFrame, rule: Rule, key: str, now: datetime, seed: str = "") -> DataFrame:
    """``(pk, anonymize)`` of the rows that one rule keeps."""
    return take(matching(df, rule, key, now), rule.take, key, seed).select(ref(key).alias("pk"), F.lit(rule.anonymize).alias("anonymize"))


def _merged(parts: Sequence[DataFrame]) -> DataFrame:
    """Union in which a row that any part preserves is preserved."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pk").agg(F.bool_and("anonymize").alias("anonymize"))


def seed_rows(tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, now: datetime, seed: str = "") -> tuple[Kept, list[str]]:
    """Kept rows of all rules but flag-only ones, and warnings about rules that do nothing."""
    kept, warnings = Kept(), []
    by_table: dict[str, list[Rule]] = {}
    for rule in spec.rules:
        if rule.table not in tables:
            raise SpecError(f"a rule names unknown table {rule.table!r}")
        if spec.role_of(rule.table) != "subset":
            warnings.append(f"the rule on {rule.table} is ignored: the table is {spec.class_of(rule.table)}")
        elif rule.take.kind != "none":
            by_table.setdefault(rule.table, []).append(rule)
    for table, rules in by_table.items():
        key = catalog.key(table)
        if key is None:
            raise SpecError(f"{table} has no single-column key, so rules cannot select its rows")
        rows = _merged([rule_rows(tables[table], r, key, now, seed) for r in rules])
        kept.rows[table] = bucketed(rows.select("pk", "anonymize", F.lit(None).cast("string").alias("identity")), "pk", kept.buckets_of(table, tables[table]))
        if any(r.keeps_all for r in rules):
            kept.whole.add(table)
    return kept, warnings


def preview(df: DataFrame, rule: Rule, key: str | None, now: datetime) -> DataFrame:
    """One row ``(matched, keeping)``: rows that a rule's filter meets, and how many its take would keep."""
    matched = matching(df, rule, key, now).agg(F.count(F.lit(1)).alias("matched"))
    keeping = {"all": F.col("matched"), "none": F.lit(0).cast("long")}.get(rule.take.kind, F.least(F.col("matched"), F.lit(max(0, rule.take.n)).cast("long")))
    return matched.select("matched", keeping.alias("keeping"))


def flag_rules(kept: Kept, tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, now: datetime) -> tuple[DataFrame | None, list[str]]:
    """Apply flag-only rules to kept rows: flags fall where a rule preserves, nothing is added, nothing spreads.

    Changes ``kept`` in place and returns ``(table, changed)`` counts.
    """
    changed, warnings = None, []
    for rule in spec.rules:
        if rule.take.kind != "none" or spec.role_of(rule.table) != "subset":
            continue
        rows = kept.rows.get(rule.table)
        if rows is None or rows.isEmpty():
            warnings.append(f"flag-only rule on {rule.table} did nothing: none of its rows are kept")
            continue
        hits = matching(tables[rule.table], rule, catalog.key(rule.table), now).select(ref(catalog.key(rule.table)).alias("pk"), F.lit(rule.anonymize).alias("flag"))
        flag = F.col("anonymize") & F.coalesce("flag", F.lit(True))
        joined = materialize(rows.join(hits.distinct(), "pk", "left").select("pk", "identity", "anonymize", flag.alias("new")))
        kept.rows[rule.table] = joined.select("pk", F.col("new").alias("anonymize"), "identity")
        count = joined.agg(F.count_if(F.col("anonymize") != F.col("new")).alias("changed")).select(F.lit(rule.table).alias("table"), "changed")
        changed = count if changed is None else changed.unionByName(count)
    if changed is not None:
        changed = changed.groupBy("table").agg(F.sum("changed").alias("changed"))
    return changed, warnings

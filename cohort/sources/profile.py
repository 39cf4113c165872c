"""Jobs that check what a catalog declares, and find what it should: keys, references, personal data, polymorphic pairs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Edge, ForeignKey, MorphRelation, SubsetSpec
from ..common import ref
from ..operators.links import WORD, stands_for
from ..operators.traverse import measured
from .scans import distinct_values

#: A type column holds a handful of values; a report of those that are not mapped shows so many.
MAX_TYPE_VALUES = 50

# What column names that hold personal data look like.
PERSONAL_NAME = r"(?i)(e[-_]?mail|phone|mobile|ip(_address)?|first_?name|last_?name|full_?name|surname|address|postcode|zip|dob|birth|ssn|national_insurance|passport|user_agent)"
SHORT_NAMES = r"ip|zip|dob|ssn"
PERSONAL_VALUES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9][0-9 ()-]{7,}[0-9]",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}

SIGNS = {"email": "@", "phone": "+", "ip": "."}


def profile_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, column, rows, nulls, distinct_values, is_unique)`` of each atomic column.

    A column's values are grouped on their own, with partial counts: no row is expanded once a column, and a columnar source
    reads each column once.
    """
    parts = []
    for name, df in tables.items():
        for f in df.schema:
            if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
                continue
            groups = df.groupBy(ref(f.name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            facts = F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values")
            parts.append(groups.agg(*facts).select(F.lit(name).alias("table"), F.lit(f.name).alias("column"), "rows", "nulls", "distinct_values"))
    return reduce(DataFrame.unionByName, parts).withColumn("is_unique", F.col("distinct_values") == F.col("rows"))


def addressable(tables: Mapping[str, DataFrame], catalog: Catalog) -> DataFrame:
    """``(table, declared_key, rows, distinct_keys, addressable)``: does a declared single-column key really name each row?"""
    parts = []
    for t in catalog.tables.values():
        if t.name not in tables:
            continue
        key = F.struct(*[ref(c) for c in t.pk]) if t.pk else F.lit(None).cast("string")
        whole = F.count_if(reduce(lambda a, b: a & b, [ref(c).isNotNull() for c in t.pk], F.lit(bool(t.pk))))
        one = tables[t.name].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"), whole.alias("w"))
        sound = (F.col("w") == F.col("rows")) & (F.col("distinct_keys") == F.col("rows"))
        parts.append(one.select(F.lit(t.name).alias("table"), F.lit(", ".join(t.pk)).alias("declared_key"), "rows", "distinct_keys", (sound & F.lit(len(t.pk) == 1)).alias("addressable")))
    return reduce(DataFrame.unionByName, parts)


def edge_facts(tables: Mapping[str, DataFrame], edges: Sequence[ForeignKey]) -> DataFrame:
    """``(edge, parent, refs, nulls, orphans)`` of each foreign key, measured."""
    found = measured([Edge(f.table, f.column, f.parent, f.parent_column) for f in edges], tables, {})
    return found.select("edge", "parent", "refs", "nulls", "orphans")


def edge_summary(tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec) -> DataFrame:
    """``(target, edges, always_followed, turned_off, refs)`` by target table, most-linked first."""
    rows = []
    for name in dict.fromkeys(f.table for f in catalog.foreign_keys):
        # one scan a table for all its references
        facts = [
            F.struct(F.lit(f.parent).alias("target"), F.lit(spec.policies.get((name, f.column)) == "null").alias("off"), F.lit(f.nullable).alias("nullable"), F.count(ref(f.column)).alias("refs"))
            for f in catalog.foreign_keys if f.table == name
        ]
        rows.append(tables[name].agg(F.array(*facts).alias("facts")).select(F.explode("facts").alias("f")).select("f.*"))
    found = reduce(DataFrame.unionByName, rows)
    return (
        found.groupBy("target")
        .agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("nullable")).alias("always_followed"), F.count_if("off").alias("turned_off"), F.sum("refs").alias("refs"))
        .orderBy(F.desc("edges"), "target")
    )


def looks_personal(column: Column) -> Column:
    """Does a column name look like personal data?  Short names count as whole parts only; times about a value do not."""
    every = F.regexp_extract_all(column, F.lit(PERSONAL_NAME), F.lit(1))
    only_short = F.forall(every, lambda m: m.rlike(rf"(?i)^({SHORT_NAMES})$"))
    alone = column.rlike(rf"(?i)(^|[_-])({SHORT_NAMES})([_-]|$)")
    return ~column.rlike(r"(?i)_(at|on)$") & (F.size(every) > 0) & (~only_short | alone)


def personal_scan(spark: SparkSession, tables: Mapping[str, DataFrame], spec: SubsetSpec) -> DataFrame:
    """``(table, column, by_name, email, phone, ip)`` of columns without a strategy that look personal by name or by value.

    Transactional tables only; values of text columns are counted by one aggregation a table.
    """
    handled = {(s.table, s.column) for s in spec.strategies}
    parts = []
    for name, df in tables.items():
        if spec.class_of(name) != "transactional":
            continue
        columns = [f.name for f in df.schema if (name, f.name) not in handled]
        texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
        if not columns:
            continue

        def hits(c: str, kind: str, texts: set[str] = texts) -> Column:
            if c not in texts:
                return F.count_if(F.lit(False))
            # a sign that every match has is looked for first: expressions are slow on long texts without one
            return F.count_if(ref(c).contains(SIGNS[kind]) & ref(c).rlike(PERSONAL_VALUES[kind]))

        facts = [F.struct(F.lit(c).alias("column"), *[hits(c, k).alias(k) for k in PERSONAL_VALUES]) for c in columns]
        parts.append(df.agg(F.array(*facts).alias("facts")).select(F.lit(name).alias("table"), F.explode("facts").alias("f")).select("table", "f.*"))
    if not parts:
        return spark.createDataFrame([], "table string, column string, by_name boolean, email long, phone long, ip long")
    found = reduce(DataFrame.unionByName, parts).withColumn("by_name", looks_personal(F.col("column")))
    return found.where("by_name OR email > 0 OR phone > 0 OR ip > 0").select("table", "column", "by_name", *PERSONAL_VALUES)


def detect_morphs(spark: SparkSession, tables: Mapping[str, DataFrame], catalog: Catalog) -> DataFrame:
    """``(table, type_column, id_column, type_value, guessed_table)``: column pairs X_type and X_id without a foreign key.

    One row a type value, however many, or one with null for an empty column.  The names that tables answer to are a small
    table, which the values' last parts, in snake case, are joined with.
    """
    keys = {(f.table, f.column) for f in catalog.foreign_keys}
    pairs, values = [], []
    for name, df in tables.items():
        for c in df.columns:
            base = c.removesuffix("_type")
            if base != c and f"{base}_id" in df.columns and (name, f"{base}_id") not in keys:
                values.append(df.select(F.lit(len(pairs)).alias("pair"), ref(c).cast("string").alias("type_value")).where("type_value IS NOT NULL").distinct())
                pairs.append((len(pairs), name, c, f"{base}_id"))
    if not pairs:
        return spark.createDataFrame([], "table string, type_column string, id_column string, type_value string, guessed_table string")
    nearest: dict[str, tuple[int, str]] = {}
    for t in tables:
        for word, distance in stands_for(t).items():
            if word not in nearest or distance < nearest[word][0]:
                nearest[word] = distance, t
    names = spark.createDataFrame([(w, t) for w, (_, t) in nearest.items() if w], "word string, guessed_table string")
    part = F.element_at(F.split("type_value", r"[\\/]"), -1)
    word = F.lower(F.array_join(F.regexp_extract_all(part, F.lit(WORD.pattern), F.lit(0)), "_"))
    found = spark.createDataFrame(pairs, "pair int, table string, type_column string, id_column string").join(reduce(DataFrame.unionByName, values), "pair", "left")
    return found.withColumn("word", word).join(F.broadcast(names), "word", "left").select("table", "type_column", "id_column", "type_value", "guessed_table")


def unmapped_types(tables: Mapping[str, DataFrame], relations: Sequence[MorphRelation], limit: int = MAX_TYPE_VALUES) -> DataFrame:
    """``(relation, type_value)``: type values present but not mapped, of relations with a switch on."""
    parts = []
    for m in relations:
        if not (m.cascade_down or m.backfill_up) or m.table not in tables:
            continue
        seen = distinct_values(tables[m.table], m.type_column, limit).select(ref(m.type_column).cast("string").alias("type_value"))
        mapped = [v for v, _ in m.type_map]
        missing = seen.where((F.col("type_value") != "") & ~F.col("type_value").isin(*mapped)) if mapped else seen.where("type_value <> ''")
        parts.append(missing.select(F.lit(f"{m.table}.{m.type_column}").alias("relation"), "type_value"))
    return reduce(DataFrame.unionByName, parts)


def integrity_audit(tables: Mapping[str, DataFrame], edges: Sequence[Edge], keys: Mapping[str, str]) -> DataFrame:
    """``(edge, rows_dangling, orphans)`` over an output: rows that refer to nothing, and distinct values so referred to."""
    return measured(edges, tables, keys).select("edge", "rows_dangling", "orphans")

"""Keys and references that no catalog declares, found in the data: sketches sieve column pairs, exact joins decide."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, ForeignKey
from ..common import key_text, materialize, ref
from ..operators.links import ID_SUFFIX, snake_case, stands_for
from .profile import profile_keys

#: Base-2 logarithm of a sketch's size: an estimate is off by 0.8 % (one standard deviation).
SKETCH_BITS = 14
#: Estimates within this share of each other may stand for equal counts: more than six standard deviations.
SLACK = 0.06


def _family(kind: T.DataType) -> str | None:
    """What a column can be compared with; no name for types that are no keys (fractions, times, nested values)."""
    if isinstance(kind, T.IntegralType | T.DecimalType):
        return "number"
    return "text" if isinstance(kind, T.StringType) else None


def column_sketches(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, column, family, rows, refs, least, most, sketch)`` of each column that may be a key or a reference.

    One scan a table, no shuffle of its rows: a sketch has 16 KB, however many values a column holds.  ``least`` and ``most``
    are the bounds of the values' texts.  Columns without a value are left out.
    """
    parts = []
    for name, df in tables.items():
        facts = []
        for f in df.schema:
            if (family := _family(f.dataType)) is None:
                continue
            text = key_text(ref(f.name), f.dataType)
            facts.append(F.struct(
                F.lit(f.name).alias("column"), F.lit(family).alias("family"), F.count(F.lit(1)).alias("rows"), F.count(text).alias("refs"),
                F.min(text).alias("least"), F.max(text).alias("most"), F.hll_sketch_agg(text, F.lit(SKETCH_BITS)).alias("sketch"),
            ))
        if facts:
            parts.append(df.agg(F.array(*facts).alias("facts")).select(F.lit(name).alias("table"), F.explode("facts").alias("f")).select("table", "f.*"))
    if not parts:
        raise ValueError("no table has a column of whole numbers or text")
    return reduce(DataFrame.unionByName, parts).where("refs > 0")


def _about(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1.0), SLACK * b)


def candidate_pairs(sketches: DataFrame) -> DataFrame:
    """``(table, column, parent, parent_column)`` where the sketches allow each value of the column to be a key of the parent.

    A parent column holds about as many values as rows, and no null.  Values that it includes lie within its bounds, and add
    nothing to its sketch.  A row a pair of columns: this grows with the schema, not with the data.
    """
    child = sketches.withColumn("size", F.hll_sketch_estimate("sketch"))
    parent = child.where((F.col("refs") == F.col("rows")) & _about(F.col("size"), F.col("rows")))
    met = child.alias("c").join(parent.alias("p"), "family")
    both = F.hll_sketch_estimate(F.hll_union("c.sketch", "p.sketch"))
    return met.where(
        ((F.col("c.table") != F.col("p.table")) | (F.col("c.column") != F.col("p.column")))
        & (F.col("c.least") >= F.col("p.least")) & (F.col("c.most") <= F.col("p.most")) & _about(both, F.col("p.size"))
    ).select("c.table", "c.column", F.col("p.table").alias("parent"), F.col("p.column").alias("parent_column"))


def named_after(column: str, parent: str, parent_column: str) -> bool:
    """Does a column's name say that it refers to the parent: the key's own name (but for a table's prefix), or ``<parent>_id``?"""
    name, key = snake_case(column), snake_case(parent_column)
    if name.endswith(ID_SUFFIX) and any(name == f"{word}{ID_SUFFIX}" or name.endswith(f"_{word}{ID_SUFFIX}") for word in stands_for(parent)):
        return True
    plain = {key, key.partition("_")[2]} - {"", "id"}
    return name in plain or name.partition("_")[2] in plain


def discover_references(tables: Mapping[str, DataFrame], catalog: Catalog | None = None) -> DataFrame:
    """``(table, column, parent, parent_column, refs, distinct_refs, nulls, by_name)`` of all references that the data hold.

    A parent column is a key in fact: no null, no value twice.  Each value of the column is one of its values; columns without
    a value refer to nothing.  Columns of whole numbers meet such columns, and text meets text.  Inclusion alone proves no
    reference (a column of small numbers lies in any key from 1): ``by_name`` says whether the names agree.  Pairs that
    ``catalog`` declares are left out.

    Sketches of one scan a table leave few pairs; what they leave is decided exactly, all pairs in one join of the columns' distinct
    values.  Only names and counts of columns come to the driver.
    """
    spark = next(iter(tables.values())).sparkSession
    declared = {(f.table, f.column, f.parent, f.parent_column) for f in (catalog.foreign_keys if catalog else ())}
    sketches = materialize(column_sketches(tables))
    pairs = [p for p in map(tuple, candidate_pairs(sketches).collect()) if p not in declared]
    keys: dict[str, list[str]] = {}
    for _, _, parent, column in pairs:
        if column not in keys.setdefault(parent, []):
            keys[parent].append(column)
    exact = profile_keys({t: tables[t].select(*[ref(c) for c in cs]) for t, cs in keys.items()}).where("is_unique").collect() if keys else []
    unique = {(r["table"], r["column"]) for r in exact}
    pairs = sorted(p for p in pairs if p[2:] in unique)
    if not pairs:
        return spark.createDataFrame([], "table string, column string, parent string, parent_column string, refs long, distinct_refs long, nulls long, by_name boolean")

    def texts(at: tuple[str, str]) -> Column:
        return key_text(ref(at[1]), tables[at[0]].schema[at[1]].dataType).alias("text")

    children, parents = list(dict.fromkeys(p[:2] for p in pairs)), list(dict.fromkeys(p[2:] for p in pairs))
    # a column's values are made distinct once, before they go to each parent that it may refer to
    distinct = reduce(DataFrame.unionByName, [tables[t].select(F.lit(i).alias("child"), texts((t, c))).where("text IS NOT NULL").distinct() for i, (t, c) in enumerate(children)])
    there = reduce(DataFrame.unionByName, [tables[t].select(F.lit(i).alias("key"), texts((t, c)), F.lit(True).alias("there")) for i, (t, c) in enumerate(parents)])
    rows = [(children.index(p[:2]), parents.index(p[2:]), *p, named_after(p[1], p[2], p[3])) for p in pairs]
    named = spark.createDataFrame(rows, "child int, key int, table string, column string, parent string, parent_column string, by_name boolean")
    met = distinct.join(F.broadcast(named.select("child", "key")), "child").join(there, ["key", "text"], "left")
    whole = met.groupBy("child", "key").agg(F.count(F.lit(1)).alias("distinct_refs"), F.count("there").alias("met")).where("met = distinct_refs")
    counts = sketches.select("table", "column", "refs", (F.col("rows") - F.col("refs")).alias("nulls"))
    return named.join(whole, ["child", "key"]).join(counts, ["table", "column"]).select("table", "column", "parent", "parent_column", "refs", "distinct_refs", "nulls", "by_name")


def with_discovered(tables: Mapping[str, DataFrame], catalog: Catalog) -> Catalog:
    """``catalog`` and the references that data and names agree on; a column with nulls counts as nullable.

    References to a column other than its table's declared key, and columns that the catalog has a reference for, are left alone.
    Of several parents that agree, all are taken: a column may refer to each.
    """
    have = {(f.table, f.column) for f in catalog.foreign_keys}
    more = [
        ForeignKey(r["table"], r["column"], r["parent"], r["parent_column"], nullable=r["nulls"] > 0)
        for r in discover_references(tables, catalog).where("by_name").collect()
        if (r["table"], r["column"]) not in have and catalog.key(r["parent"]) == r["parent_column"]
    ]
    return replace(catalog, foreign_keys=(*catalog.foreign_keys, *more))

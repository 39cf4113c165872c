"""Backfill policies and nulling of dangling references."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Edge, ForeignKey, SubsetSpec
from ..common import as_type, column_type, fresh, ref
from .select import Kept
from .traverse import measured

#: Share of a column's distinct references that must be there for it to count as a reference.
MIN_INCLUDED = 0.9


#: What a ``null`` policy needs of the foreign keys on its column, and what is said where it is missing.
NEEDS: tuple[tuple[str, Callable[[list[ForeignKey], Catalog], bool]], ...] = (
    ("refers to no table", lambda fks, _: bool(fks)),
    ("is not declared nullable", lambda fks, _: all(f.nullable for f in fks)),
    ("refers to another column than a primary key", lambda fks, catalog: all(f.parent_column == catalog.key(f.parent) for f in fks)),
)


def check_policies(catalog: Catalog, spec: SubsetSpec) -> tuple[dict[tuple[str, str], str], list[str]]:
    """The ``null`` policies that the catalog allows, and why references of others are followed as usual."""
    on: dict[tuple[str, str], list[ForeignKey]] = {at: [] for at, policy in spec.policies.items() if policy == "null" and spec.class_of(at[0]) != "excluded"}
    for f in catalog.foreign_keys:
        if (f.table, f.column) in on:
            on[f.table, f.column].append(f)
    missing = {at: [said for said, holds in NEEDS if not holds(fks, catalog)] for at, fks in on.items()}
    return {at: "null" for at in on if not missing[at]}, [f"{'.'.join(at)} {said[0]}, so it is followed as usual" for at, said in missing.items() if said]


def measured_policies(tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec) -> DataFrame:
    """``(edge, policy, reason)`` of each foreign key under a ``null`` policy: ``null`` where the data bear it out, else ``follow``.

    Nulling needs a column that holds nulls, a parent column that is a key (no nulls, no value twice), and references of which
    ``MIN_INCLUDED`` are there.  The first fact that fails is the reason.  All edges are measured together, each parent key once.
    """
    fks = [f for f in catalog.foreign_keys if spec.policies.get((f.table, f.column)) == "null" and f.table in tables and f.parent in tables]
    if not fks:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "edge string, policy string, reason string")
    facts = measured([Edge(f.table, f.column, f.parent, f.parent_column) for f in fks], tables, {})
    # equal labels stand for one column with several parents: every one of them has to bear it out
    keys = []
    for parent, column in dict.fromkeys((f.parent, f.parent_column) for f in fks):
        groups = tables[parent].groupBy(ref(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        sound = groups.agg((F.count_if(F.col("v").isNull() | (F.col("n") > 1)) == 0).alias("is_key"))
        keys.append(sound.select(F.lit(f"{parent}.{column}").alias("key"), "is_key"))
    spark = facts.sparkSession
    refers = spark.createDataFrame([(f.label, f.parent, f"{f.parent}.{f.parent_column}") for f in fks], "edge string, parent string, key string")
    met = facts.join(refers, ["edge", "parent"]).join(reduce(DataFrame.unionByName, keys), "key")
    included = F.col("orphans") <= (1 - MIN_INCLUDED) * F.col("distinct_refs")
    reason = (
        F.when(F.col("nulls") == 0, "holds no null").when(~F.col("is_key"), "the parent column is no key").when(~included, "most of its references are not there")
    )
    found = met.select("edge", reason.alias("reason")).groupBy("edge").agg(F.min("reason").alias("reason"))
    return found.select("edge", F.when(F.col("reason").isNull(), "null").otherwise("follow").alias("policy"), "reason")


def borne_out(tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, policies: Mapping[tuple[str, str], str]) -> tuple[dict[tuple[str, str], str], list[str]]:
    """The declared policies that the data bear out too, and why others do not hold."""
    good, warnings = dict(policies), []
    for r in measured_policies(tables, catalog, spec).where("policy = 'follow'").collect():  # a row a policy
        table, _, column = r.edge.partition(".")
        if good.pop((table, column), None):
            warnings.append(f"{r.edge}: {r.reason}, so it is followed as usual")
    return good, warnings


def null_dangling(df: DataFrame, table: str, policies: Mapping[tuple[str, str], str], kept: Kept, catalog: Catalog, spec: SubsetSpec) -> tuple[DataFrame, list[str]]:
    """Null the references under a ``null`` policy that point outside of the output; returns the columns tested, too.

    A value stays only if every parent that the column refers to keeps it.  Parents copied or kept whole never miss a
    value; parents that are not in the output miss all.
    """
    tested = []
    for (t, column), policy in policies.items():
        if t != table or policy != "null" or column not in df.columns:
            continue
        parents = [f.parent for f in catalog.foreign_keys if (f.table, f.column) == (table, column)]
        if any(spec.role_of(p) == "omitted" for p in parents):
            df = df.withColumn(column, F.lit(None).cast(column_type(df, column)))
            tested.append(column)
            continue
        parents = [p for p in parents if spec.role_of(p) == "subset" and p not in kept.whole]
        for p in parents:
            rows = kept.rows.get(p)
            if rows is None:
                df = df.withColumn(column, F.lit(None).cast(column_type(df, column)))
                continue
            (mark,) = fresh(df, "kept_")
            marks = rows.select(F.col("pk").alias(mark))
            key = as_type(ref(column), column_type(rows, "pk"), column_type(df, column))
            columns = df.columns
            df = df.join(marks, key == ref(mark), "left").select(
                *[F.when(ref(mark).isNotNull(), ref(c)).alias(c) if c == column else ref(c) for c in columns]
            )
        if parents:
            tested.append(column)
    return df, tested

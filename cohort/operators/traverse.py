"""Fixpoints along references: downward cascade and upward backfill.

Both are semi-naive loops over a frontier.  A round joins the frontier with every edge that leaves it, and writes what is new or
changed; rounds are bounded by the longest chain (plus flags that fall).  Kept rows never leave the cluster.

A kept set is a log of such deltas, bucketed by key: what a round writes follows what it finds, not what was found before, and
nothing written is shuffled again, since arriving rows are dealt as the buckets are.  A small delta (the planner knows its size from its
files) is broadcast, so a round with few new rows only scans the references.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Edge, SubsetSpec
from ..common import as_type, bucketed_and_counted, column_type, fresh, key_text, own_identity, ref
from .select import Kept

KEPT = "pk", "anonymize", "identity"


def edges_of(catalog: Catalog, spec: SubsetSpec, direction: str) -> list[Edge]:
    """Foreign keys in catalog order, then one edge for each mapped type of the relations switched on for ``down`` or ``up``."""
    out = [Edge(f.table, f.column, f.parent, f.parent_column) for f in catalog.foreign_keys]
    for m in spec.morphs:
        if m.cascade_down if direction == "down" else m.backfill_up:
            out += [Edge(m.table, m.id_column, target, None, m.type_column, value) for value, target in m.mapped()]
    return out


def children_of(edge: Edge, child: DataFrame, child_key: str, parent_rows: DataFrame, parent_key: str) -> DataFrame:
    """Rows of the child that refer to ``parent_rows(pk, ...)``: its key as ``child_pk`` beside the parent's columns.

    The reference is read as the parent key's type, so keys of different types meet.
    """
    if edge.type_column is not None:
        child = child.where(ref(edge.type_column).cast("string") == edge.type_value)
    fk = as_type(ref(edge.column), column_type(parent_rows, parent_key), column_type(child, edge.column))
    refs = child.select(ref(child_key).alias("child_pk"), fk.alias("ref_"))
    return refs.join(parent_rows, refs["ref_"] == parent_rows[parent_key]).drop("ref_")


def references_of(edge: Edge, child: DataFrame, child_key: str | None, rows: DataFrame | None, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-null values ``ref``, of the parent key's type, by which the child's rows (all, or those in ``rows(pk)``) refer to the parent."""
    if edge.type_column is not None:
        child = child.where(ref(edge.type_column).cast("string") == edge.type_value)
    if rows is not None:
        (pk,) = fresh(child, "pk_")
        child = child.join(rows.select(F.col("pk").alias(pk)), ref(child_key) == ref(pk), "left_semi")
    fk = as_type(ref(edge.column), column_type(parent, parent_key), column_type(child, edge.column))
    return child.where(ref(edge.column).isNotNull()).select(fk.alias("ref")).distinct()


@dataclass
class DeltaLog:
    """A table's kept rows as deltas ``(pk, anonymize, identity)``, first to last, each bucketed by ``pk``.

    A row may stand in many deltas: it is preserved if any says so, and has the first identity that any gives.  Two deltas are
    merged when the later has grown to half of the earlier, so a row is written again only as often as the log doubles, and
    there are few deltas to look into.
    """

    buckets: int
    levels: list[tuple[DataFrame, int]] = field(default_factory=list)
    #: Rows written, merges included.
    written: int = 0

    @classmethod
    def of(cls, rows: DataFrame | None, buckets: int) -> DeltaLog:
        log = cls(buckets)
        if rows is not None:
            log.levels.append((rows, rows.count()))
        return log

    def known(self, rows: DataFrame) -> DataFrame:
        """``rows(pk, ...)`` with what is known of each: ``anonymize`` (null for rows that are not kept) and ``identity``."""
        flags, names = [], []
        for i, (df, _) in enumerate(self.levels):
            rows = rows.join(df.select("pk", F.col("anonymize").alias(f"flag_{i}"), F.col("identity").alias(f"name_{i}")), "pk", "left")
            flags.append(f"flag_{i}")
            names.append(f"name_{i}")
        least = reduce(lambda a, b: F.coalesce(a & b, a, b), map(F.col, flags))  # of those that are there
        return rows.withColumns({"anonymize": least, "identity": F.coalesce(*names)}).drop(*flags, *names)

    def unknown(self, rows: DataFrame) -> DataFrame:
        """``rows(pk, ...)`` that are not kept."""
        return reduce(lambda left, level: left.join(level[0].select("pk"), "pk", "left_anti"), self.levels, rows)

    def _merge_last(self) -> None:
        (first, _), (last, _) = self.levels[-2:]
        other = last.select("pk", F.col("anonymize").alias("flag_"), F.col("identity").alias("name_"))
        flag = F.coalesce("anonymize", F.lit(True)) & F.coalesce("flag_", F.lit(True))
        both = first.select(*KEPT).join(other, "pk", "full").select("pk", flag.alias("anonymize"), F.coalesce("identity", "name_").alias("identity"))
        self.levels[-2:] = [bucketed_and_counted(both, "pk", self.buckets)]
        self.written += self.levels[-1][1]

    def append(self, delta: DataFrame) -> DataFrame | None:
        """Write a delta, which may have more columns; gives it back as written, None if it is empty."""
        delta, n = bucketed_and_counted(delta, "pk", self.buckets)
        if not n:
            return None
        self.levels.append((delta, n))
        self.written += n
        while len(self.levels) > 1 and 2 * self.levels[-1][1] >= self.levels[-2][1]:
            self._merge_last()
        return delta

    def current(self) -> DataFrame:
        """``(pk, anonymize, identity)``, written as one."""
        while len(self.levels) > 1:
            self._merge_last()
        return self.levels[0][0].select(*KEPT)


def _logs(kept: Kept, tables: Mapping[str, DataFrame]) -> dict[str, DeltaLog]:
    return {t: DeltaLog.of(rows, kept.buckets_of(t, tables[t])) for t, rows in kept.rows.items()}


def cascade(kept: Kept, tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, logs: dict[str, DeltaLog] | None = None) -> list[str]:
    """Pull in the children of kept rows, theirs, and so on; changes ``kept`` in place and returns warnings.

    A row is preserved if any way from a preserved row leads to it.  Its identity is that of the entity it was first
    reached from (smallest round, edge, identity), never another row of its own table.  Rows without a key are not kept.
    ``logs``, if given, gets what was written.
    """
    warnings, edges = [], []
    for e in edges_of(catalog, spec, "down"):
        if e.child not in tables or e.parent not in tables or spec.role_of(e.child) != "subset":
            continue
        if catalog.key(e.child) is None:
            continue  # link tables are matched on their endpoints, others reported by detect_links
        if catalog.key(e.parent) is None or (e.parent_column not in (None, catalog.key(e.parent))):
            warnings.append(f"{e.label} does not refer to the primary key of {e.parent}: not followed down")
            continue
        edges.append(e)
    logs = {} if logs is None else logs
    logs.update(_logs(kept, tables))
    frontier = dict(kept.rows)
    while frontier:
        arriving: dict[str, list[DataFrame]] = {}
        for ordinal, e in enumerate(edges):
            if e.parent not in frontier:
                continue
            inherited = F.coalesce("identity", own_identity(e.parent, F.col("pk")))
            parents = frontier[e.parent].select("pk", "anonymize", inherited.alias("who"))
            found = children_of(e, tables[e.child], catalog.key(e.child), parents, "pk").where("child_pk IS NOT NULL")
            other = F.when(~F.col("who").startswith(f"{e.child}:"), F.struct(F.lit(ordinal).alias("o"), F.col("who").alias("who")))
            arriving.setdefault(e.child, []).append(found.select("child_pk", "anonymize", other.alias("by")))
        frontier = {}
        for child, parts in arriving.items():
            new = reduce(DataFrame.unionByName, parts).groupBy(F.col("child_pk").alias("pk")).agg(
                F.bool_and("anonymize").alias("flag"), F.min("by")["who"].alias("who")
            )
            log = logs.setdefault(child, DeltaLog(kept.buckets_of(child, tables[child])))
            if not log.levels:
                delta = new.select("pk", F.col("flag").alias("anonymize"), F.col("who").alias("identity"), F.lit(True).alias("changed"))
            else:
                flag = F.coalesce("anonymize", F.lit(True)) & F.coalesce("flag", F.lit(True))
                changed = F.col("anonymize").isNull() | (F.col("anonymize") != flag)
                named = F.col("identity").isNull() & F.col("who").isNotNull()
                delta = log.known(new).where(changed | named).select("pk", flag.alias("anonymize"), F.coalesce("identity", "who").alias("identity"), changed.alias("changed"))
            delta = log.append(delta)
            if delta is not None:
                frontier[child] = delta.where("changed").select(*KEPT)
    kept.rows.update({t: log.current() for t, log in logs.items() if log.levels})
    return warnings


@dataclass
class Backfill:
    """What the upward pass did: rows added (with the edge that asked first), skipped edges, warnings."""

    added: DataFrame | None = None
    skipped: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def by_edge(self) -> DataFrame | None:
        """``(table, edge, added)`` counts."""
        return None if self.added is None else self.added.groupBy("table", "edge").agg(F.count(F.lit(1)).alias("added"))


def backfill(kept: Kept, tables: Mapping[str, DataFrame], catalog: Catalog, spec: SubsetSpec, policies: Mapping[tuple[str, str], str] | None = None) -> Backfill:
    """Add the rows that kept rows refer to, and what those refer to, upward only; changes ``kept`` in place.

    Rows added are to be anonymized and are entities of their own; rows already kept stay as they are.  Edges under a
    ``null`` policy, into complete tables, and into tables kept whole are not followed; edges that cannot be are reported.
    """
    report = Backfill()
    policies = spec.policies if policies is None else policies
    edges, warned = [], set()
    for ordinal, e in enumerate(edges_of(catalog, spec, "up")):
        if e.child not in tables or spec.role_of(e.child) == "omitted":
            continue
        if spec.role_of(e.child) == "subset" and catalog.key(e.child) is None:
            continue  # link tables never pull parents in
        if e.type_column is None and policies.get((e.child, e.column)) == "null":
            report.skipped.append(e.label)
        elif e.parent not in tables or spec.role_of(e.parent) == "omitted":
            edges.append((ordinal, e, "omitted"))
        elif spec.role_of(e.parent) == "subset" and e.parent not in kept.whole:
            key = catalog.key(e.parent)
            if key is None or e.parent_column not in (None, key):
                edges.append((ordinal, e, "unaddressable"))
            else:
                edges.append((ordinal, e, "pull"))
    logs = _logs(kept, tables)
    # None stands for every row of a table
    frontier: dict[str, DataFrame | None] = {}
    for _, e, _ in edges:
        if spec.role_of(e.child) == "complete" or e.child in kept.whole:
            frontier[e.child] = None
        elif e.child in kept.rows:
            frontier[e.child] = kept.rows[e.child]
    round_ = 0
    while frontier:
        asked: dict[str, list[DataFrame]] = {}
        for ordinal, e, how in edges:
            if e.child not in frontier:
                continue
            if how != "pull":
                if e.label not in warned and not _plain_references(e, tables[e.child], catalog.key(e.child), frontier[e.child]).isEmpty():
                    warned.add(e.label)
                    why = "is not in the output, so these references dangle" if how == "omitted" else "is not referred to by its primary key: not backfilled"
                    report.warnings.append(f"{e.label}: {e.parent} {why}")
                continue
            parent, key = tables[e.parent], catalog.key(e.parent)
            refs = references_of(e, tables[e.child], catalog.key(e.child), frontier[e.child], parent, key)
            asked.setdefault(e.parent, []).append(refs.select("ref", F.struct(F.lit(ordinal).alias("o"), F.lit(e.label).alias("edge")).alias("by")))
        frontier = {}
        for table, parts in asked.items():
            wanted = reduce(DataFrame.unionByName, parts).groupBy("ref").agg(F.min("by")["edge"].alias("edge"))
            keys = tables[table].select(ref(catalog.key(table)).alias("pk"))
            new = keys.join(wanted, keys["pk"] == wanted["ref"]).groupBy("pk").agg(F.min("edge").alias("edge"))
            log = logs.setdefault(table, DeltaLog(kept.buckets_of(table, tables[table])))
            new = log.unknown(new)
            as_kept = F.lit(True).alias("anonymize"), F.lit(None).cast("string").alias("identity"), F.lit(round_).alias("round")
            delta = log.append(new.select("pk", *as_kept, "edge"))
            if delta is None:
                continue
            frontier[table] = delta.select(*KEPT)
            added = delta.select(F.lit(table).alias("table"), "edge", F.col("pk").cast("string").alias("pk"), "round")
            report.added = added if report.added is None else report.added.unionByName(added)
        round_ += 1
    kept.rows.update({t: log.current() for t, log in logs.items() if log.levels})
    return report


def _plain_references(edge: Edge, child: DataFrame, key: str | None, rows: DataFrame | None) -> DataFrame:
    if edge.type_column is not None:
        child = child.where(ref(edge.type_column).cast("string") == edge.type_value)
    if rows is not None:
        (pk,) = fresh(child, "pk_")
        child = child.join(rows.select(F.col("pk").alias(pk)), ref(key) == ref(pk), "left_semi")
    return child.where(ref(edge.column).isNotNull()).select(ref(edge.column)).limit(1)


def measured(edges: Sequence[Edge], tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """``(edge, parent, refs, nulls, distinct_refs, orphans, rows_dangling)`` of each edge.

    ``refs`` and ``nulls`` count rows with and without a reference, ``orphans`` distinct references without a row, and
    ``rows_dangling`` the rows that hold them.  A child table is scanned once, its references stacked to (edge, text); all distinct
    references meet all parents' keys in one join, by the keys' texts.
    """
    targets = list(dict.fromkeys((e.parent, e.parent_column or keys[e.parent]) for e in edges))
    by_child: dict[str, list[tuple[int, Edge]]] = {}
    for i, e in enumerate(edges):
        by_child.setdefault(e.child, []).append((i, e))
    stacked = []
    for child, mine in by_child.items():
        df = tables[child]
        facts = []
        for i, e in mine:
            target = targets.index((e.parent, e.parent_column or keys[e.parent]))
            one = F.struct(F.lit(i).alias("i"), F.lit(target).alias("target"), key_text(ref(e.column), column_type(df, e.column)).alias("text"))
            facts.append(one if e.type_column is None else F.when(ref(e.type_column).cast("string") == e.type_value, one))
        stacked.append(df.select(F.explode(F.array(*facts)).alias("r")).where("r IS NOT NULL").select("r.*").groupBy("i", "target", "text").agg(F.count(F.lit(1)).alias("n")))
    refs = reduce(DataFrame.unionByName, stacked)
    there = [tables[p].select(F.lit(t).alias("target"), key_text(ref(c), column_type(tables[p], c)).alias("text")).where("text IS NOT NULL").distinct() for t, (p, c) in enumerate(targets)]
    met = refs.join(reduce(DataFrame.unionByName, there).withColumn("there", F.lit(True)), ["target", "text"], "left")
    none, lost = F.col("text").isNull(), F.col("text").isNotNull() & F.col("there").isNull()
    counts = met.groupBy("i").agg(
        F.sum(F.when(~none, F.col("n"))).alias("refs"), F.sum(F.when(none, F.col("n"))).alias("nulls"), F.count("text").alias("distinct_refs"),
        F.count_if(lost).alias("orphans"), F.sum(F.when(lost, F.col("n"))).alias("rows_dangling"),
    )
    named = met.sparkSession.createDataFrame([(i, e.label, e.parent) for i, e in enumerate(edges)], "i int, edge string, parent string")
    zero = F.lit(0).cast("long")
    return named.join(counts, "i", "left").select(
        "edge", "parent", *[F.coalesce(c, zero).alias(c) for c in ("refs", "nulls", "distinct_refs", "orphans", "rows_dangling")]
    )


def orphans(edges: Sequence[Edge], tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """``(edge, orphans)``: distinct non-null references without a row, for each edge."""
    return measured(edges, tables, keys).select("edge", "orphans")

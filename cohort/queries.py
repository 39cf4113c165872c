"""Queries over the given tables, one or more for each operator, with the same results in DuckDB's SQL.

Columns that the tables lack (nulls, e-mail addresses, a second parent, a polymorphic pair) are derived by expressions that both
engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql_generators as G
from .catalog import (
    Binding, Catalog, Condition, Edge, FieldException, FieldStrategy, ForeignKey, IdentitySource, LocaleSource, MorphRelation, Rule, Strategy,
    SubsetSpec, Table, Take,
)
from .common import own_identity, ref
from .functions.generators import GENERATORS, generate
from .functions.jsonpath import discover, read_path
from .functions.locale import locale_of
from .functions.predicates import matching
from .operators.anonymize import anonymize
from .operators.links import detect_links, link_rows, morph_match, row_filter
from .operators.policy import check_policies, measured_policies, null_dangling
from .operators.select import Kept, flag_rules, preview, rule_rows, seed_rows
from .operators.traverse import backfill, cascade, edges_of, orphans
from .plans.subset import nulled_counts, select_rows, subset
from .sources import profile
from .sources.inclusion import discover_references
from .sources.scans import distinct_values, sample_values
from .sources.sinks import insert_statements, sequence_state, value_rows

NOW = datetime.fromisoformat("1998-08-01T00:00:00+00:00")

CATALOG = Catalog(
    {
        t.name: t
        for t in (
            Table("region", ("r_regionkey",)),
            Table("nation", ("n_nationkey",)),
            Table("customer", ("c_custkey",), sequences=("c_custkey",)),
            Table("supplier", ("s_suppkey",)),
            Table("part", ("p_partkey",)),
            Table("orders", ("o_orderkey",), sequences=("o_orderkey",)),
            Table("lineitem"),
            Table("events", ("event_id",)),
        )
    },
    (
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("orders", "o_custkey", "customer", "c_custkey", nullable=True),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ForeignKey("events", "user_id", "customer", "c_custkey", nullable=True),
    ),
)

#: Columns added to the tables, in SQL that both engines read.
CUSTOMER_X = (
    "concat('u', c_custkey, '@', CASE c_mktsegment WHEN 'BUILDING' THEN 'acme.com' ELSE 'mail.example' END) AS email",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS nick",
    "CASE c_nationkey % 4 WHEN 0 THEN 'NL' WHEN 1 THEN ' United Kingdom ' WHEN 2 THEN 'de' ELSE '' END AS country",
    "CASE WHEN c_custkey < 10 THEN NULL ELSE CAST(floor(c_custkey / 10) AS BIGINT) END AS parent_id",
    "CAST(floor(c_acctbal) AS BIGINT) AS balance",
    "CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)) END AS score",
)
ORDERS_X = (
    "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS buyer",
    "CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS broken",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    "CAST(o_custkey AS VARCHAR(20)) AS cust_text",
    "CAST(floor(o_totalprice) AS BIGINT) AS price",
)
EVENTS_X = (
    "CASE event_type WHEN 'purchase' THEN 'Order' WHEN 'view' THEN 'Customer' ELSE 'Ghost' END AS owner_type",
    "user_id AS owner_id",
    "concat('{\"user\":{\"name\":\"n', event_id, '\",\"mail\":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('\"m', user_id, '@x.example\"') END,"
    " '},\"k\":', event_id % 100, CASE WHEN event_id % 2 = 0 THEN ',\"tags\":[1,2]' ELSE '' END, '}') AS payload",
)
C = f"(SELECT *, {', '.join(CUSTOMER_X)} FROM customer)"
O = f"(SELECT *, {', '.join(ORDERS_X)} FROM orders)"  # noqa: E741
E = f"(SELECT *, {', '.join(EVENTS_X)} FROM events)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    extra = {"customer": CUSTOMER_X, "orders": ORDERS_X, "events": EVENTS_X}
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").selectExpr("*", *extra.get(n, ())) for n in names or CATALOG.tables}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def kept_table(kept: Kept) -> DataFrame:
    """All kept rows as ``(table, pk, anonymize, identity)``."""
    return union([df.select(F.lit(t).alias("table"), F.col("pk").cast("string").alias("pk"), "anonymize", "identity") for t, df in sorted(kept.rows.items())])


# ---- scans -----------------------------------------------------------------------------------------------------------


@query("scan_columns", "SELECT p_partkey, p_brand FROM part")
def _(spark, sf):
    return read(spark, sf, "part")["part"].select("p_partkey", "p_brand")


@query("scan_distinct", f"SELECT DISTINCT priority FROM {O} WHERE priority IS NOT NULL ORDER BY 1 LIMIT 3")
def _(spark, sf):
    return distinct_values(read(spark, sf, "orders")["orders"], "priority", 3)


@query("scan_sample", f"SELECT priority FROM {O} WHERE priority IS NOT NULL ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50")
def _(spark, sf):
    return sample_values(read(spark, sf, "orders")["orders"], "priority", "o_orderkey", 50)


@query("row_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def _(spark, sf):
    t = read(spark, sf, "orders", "customer", "lineitem")
    rich = t["customer"].where("c_acctbal > 5000").select(F.col("c_custkey").alias("pk"))
    large = t["lineitem"].where("l_quantity > 40").select(F.col("l_orderkey").alias("pk"))
    return row_filter(t["orders"], {"o_custkey": rich, "o_orderkey": large}).select("o_orderkey")


@query("row_filter_morph", f"SELECT event_id FROM {E} e WHERE owner_type = 'Order' OR (owner_type = 'Customer' AND owner_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))")
def _(spark, sf):
    t = read(spark, sf, "events", "customer")
    rich = t["customer"].where("c_acctbal > 5000").select(F.col("c_custkey").alias("pk"))
    return morph_match(t["events"], "owner_type", "owner_id", [("Order", None), ("Customer", rich)]).select("event_id")


# ---- predicates ------------------------------------------------------------------------------------------------------

AMOUNT = "CAST(floor(o_totalprice / 1000) AS DECIMAL(12, 2))"
PREDICATES = {
    "eq": (Condition("buyer", "eq", "43"), "buyer = 43"),
    "eq_text": (Condition("cust_text", "eq", 43), "cust_text = '43'"),
    "neq": (Condition("buyer", "neq", 43), "buyer <> 43 OR buyer IS NULL"),
    "neq_strict": (Condition("buyer", "neq", 43, include_nulls=False), "buyer <> 43"),
    "lt": (Condition("buyer", "lt", 100), "buyer < 100"),
    "lte": (Condition("o_totalprice", "lte", 20000.5), "o_totalprice <= 20000.5"),
    "gt": (Condition("cust_text", "gt", "90"), "CAST(cust_text AS DOUBLE) > 90"),
    "gte": (Condition("o_orderdate", "gte", "1997-01-01T00:00:00Z"), "o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'"),
    "contains": (Condition("priority", "contains", "-U"), "contains(lower(priority), '-u')"),
    "not_contains": (Condition("priority", "notContains", "u"), "NOT contains(lower(priority), 'u') OR priority IS NULL"),
    "starts_with": (Condition("priority", "startsWith", "1-u"), "starts_with(lower(priority), '1-u')"),
    "ends_with": (Condition("priority", "endsWith", "Low"), "lower(priority) LIKE '%low'"),
    "is_null": (Condition("buyer", "isNull"), "buyer IS NULL"),
    "not_null": (Condition("buyer", "notNull"), "buyer IS NOT NULL"),
    "in": (Condition("buyer", "in", (1, "2", 3)), "buyer IN (1, 2, 3)"),
    "in_empty": (Condition("buyer", "in", ()), "FALSE"),
    "not_in": (Condition("buyer", "notIn", (1, 2, 3)), "buyer NOT IN (1, 2, 3) OR buyer IS NULL"),
    "within_last": (Condition("o_orderdate", "withinLast", {"n": 6, "unit": "month"}), "o_orderdate >= TIMESTAMP '1998-02-01 00:00:00'"),
    "older_than": (Condition("o_orderdate", "olderThan", {"n": 3, "unit": "year"}), "o_orderdate < TIMESTAMP '1995-08-01 00:00:00'"),
    "matches": (Condition("priority", "matches", "^[12]-.*[A-Z]$"), "regexp_matches(priority, '^[12]-.*[A-Z]$')"),
    "pk": (Condition(None, "lt", 20), "o_orderkey < 20"),
    "eq_float": (Condition("buyer", "eq", 43.0), "buyer = 43"),
    "neq_float": (Condition("buyer", "neq", 43.0), "buyer <> 43 OR buyer IS NULL"),
    "eq_text_float": (Condition("cust_text", "eq", 43.0), "cust_text = '43'"),
    "in_float": (Condition("buyer", "in", (1.0, "2.00", 3.5, "x", 43.0)), "buyer IN (1, 2, 43)"),
    "not_in_float": (Condition("buyer", "notIn", (1.0, 2.5, "4e1"), include_nulls=False), "buyer NOT IN (1, 40)"),
    "eq_decimal": (Condition("amount", "eq", 150.0), "amount = 150"),
    "in_decimal": (Condition("amount", "in", ("3", 4.0, "5.50", 150.005)), "amount IN (3, 4, 5.5)"),
}


def _predicate(condition: Condition):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = read(spark, sf_dir, "orders")["orders"].withColumn("amount", F.expr(AMOUNT))
        return matching(orders, Rule("orders", (condition,)), "o_orderkey", NOW).select("o_orderkey")

    return run


for _name, (_condition, _sql) in PREDICATES.items():
    query(f"pred_{_name}", f"SELECT o_orderkey FROM (SELECT *, {AMOUNT} AS amount FROM {O}) WHERE {_sql}")(_predicate(_condition))

#: Over a thousand values, in several spellings; some are no value of the column.
MANY = (*range(0, 4000, 2), *(f"{n}.0" for n in range(1, 400, 4)), 7.0, 9.5, "x")
MANY_SQL = "(SELECT range * 2 FROM range(2000) UNION ALL SELECT 1 + 4 * range FROM range(100) UNION ALL SELECT 7)"
LISTS = {
    "in_long_decimal": (Rule("orders", (Condition("amount", "in", MANY),)), f"amount IN {MANY_SQL}"),
    "in_long_text": (Rule("orders", (Condition("cust_text", "in", tuple(v for v in MANY if not isinstance(v, str))),)), "CAST(cust_text AS BIGINT) IN (SELECT range * 2 FROM range(2000) UNION ALL SELECT 7)"),
    "in_long_any": (Rule("orders", (Condition("buyer", "in", MANY), Condition("o_orderstatus", "eq", "P")), "any"), f"buyer IN {MANY_SQL} OR o_orderstatus = 'P'"),
    "not_in_long": (Rule("orders", (Condition("buyer", "notIn", MANY), Condition("o_orderstatus", "eq", "O"))), f"(buyer NOT IN {MANY_SQL} OR buyer IS NULL) AND o_orderstatus = 'O'"),
}


def _ruled(rule: Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching(read(spark, sf_dir, "orders")["orders"].withColumn("amount", F.expr(AMOUNT)), rule, "o_orderkey", NOW).select("o_orderkey")

    return run


for _name, (_rule, _sql) in LISTS.items():
    query(f"pred_{_name}", f"SELECT o_orderkey FROM (SELECT *, {AMOUNT} AS amount FROM {O}) WHERE {_sql}")(_ruled(_rule))


@query("pred_all", f"SELECT o_orderkey FROM {O} WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND buyer IS NOT NULL")
def _(spark, sf):
    rule = Rule("orders", (Condition("o_orderstatus", "eq", "F"), Condition("o_totalprice", "gt", 1000), Condition("buyer", "notNull")))
    return matching(read(spark, sf, "orders")["orders"], rule, "o_orderkey", NOW).select("o_orderkey")


@query("pred_any", f"SELECT o_orderkey FROM {O} WHERE o_orderstatus = 'F' OR buyer < 10")
def _(spark, sf):
    rule = Rule("orders", (Condition("o_orderstatus", "eq", "F"), Condition("buyer", "lt", 10)), "any")
    return matching(read(spark, sf, "orders")["orders"], rule, "o_orderkey", NOW).select("o_orderkey")


@query("pred_in_long", f"SELECT o_orderkey FROM {O} WHERE price IN (SELECT range * 111 FROM range(6000)) AND o_orderstatus = 'O'")
def _(spark, sf):
    rule = Rule("orders", (Condition("price", "in", tuple(range(0, 666000, 111))), Condition("o_orderstatus", "eq", "O")))
    return matching(read(spark, sf, "orders")["orders"], rule, "o_orderkey", NOW).select("o_orderkey")


@query("pred_raw", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def _(spark, sf):
    t = read(spark, sf, "customer", "orders")
    t["orders"].createOrReplaceTempView("cohort_raw_orders")
    rule = Rule("customer", raw="EXISTS (SELECT 1 FROM cohort_raw_orders o WHERE o.o_custkey = c_custkey AND o.o_totalprice > 300000)")
    return matching(t["customer"], rule, "c_custkey", NOW).select("c_custkey")


# ---- takes, previews, merges -----------------------------------------------------------------------------------------


@query("take_sample", "SELECT o_orderkey AS pk, TRUE AS anonymize FROM orders WHERE o_orderstatus = 'O' ORDER BY sha256(concat('s1', o_orderkey)), o_orderkey LIMIT 100")
def _(spark, sf):
    rule = Rule("orders", (Condition("o_orderstatus", "eq", "O"),), take=Take("sample", 100))
    return rule_rows(read(spark, sf, "orders")["orders"], rule, "o_orderkey", NOW, "s1")


@query("take_top", f"SELECT o_orderkey AS pk, FALSE AS anonymize FROM {O} ORDER BY priority DESC NULLS LAST, o_orderkey LIMIT 25")
def _(spark, sf):
    return rule_rows(read(spark, sf, "orders")["orders"], Rule("orders", take=Take("top", 25, "priority"), anonymize=False), "o_orderkey", NOW)


@query("take_top_ascending", f"SELECT o_orderkey AS pk, TRUE AS anonymize FROM {O} ORDER BY buyer ASC NULLS FIRST, o_orderkey LIMIT 3000")
def _(spark, sf):
    return rule_rows(read(spark, sf, "orders")["orders"], Rule("orders", take=Take("top", 3000, "buyer", False)), "o_orderkey", NOW)


@query("take_top_numeric_text", f"SELECT c_custkey AS pk, TRUE AS anonymize FROM {C} ORDER BY TRY_CAST(score AS DOUBLE) DESC NULLS LAST, score DESC, c_custkey LIMIT 40")
def _(spark, sf):
    return rule_rows(read(spark, sf, "customer")["customer"], Rule("customer", take=Take("top", 40, "score")), "c_custkey", NOW)


@query("take_negative", "SELECT o_orderkey AS pk, TRUE AS anonymize FROM orders WHERE FALSE")
def _(spark, sf):
    return rule_rows(read(spark, sf, "orders")["orders"], Rule("orders", take=Take("sample", -3)), "o_orderkey", NOW)


@query("preview_rule", "SELECT count(*) AS matched, least(count(*), 250) AS keeping FROM customer WHERE c_acctbal > 0")
def _(spark, sf):
    rule = Rule("customer", (Condition("c_acctbal", "gt", 0),), take=Take("top", 250, "c_acctbal"))
    return preview(read(spark, sf, "customer")["customer"], rule, "c_custkey", NOW)


SEEDS = (
    Rule("customer", (Condition("c_mktsegment", "eq", "BUILDING"),), take=Take("top", 30, "c_acctbal")),
    Rule("customer", (Condition("email", "endsWith", "@ACME.com"), Condition("c_acctbal", "lt", 500)), anonymize=False),
)
SEED_SQL = f"""
    SELECT pk, bool_and(anonymize) AS anonymize FROM (
        (SELECT c_custkey AS pk, TRUE AS anonymize FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30)
        UNION ALL (SELECT c_custkey, FALSE FROM {C} WHERE email LIKE '%@acme.com' AND c_acctbal < 500)
    ) GROUP BY pk
"""


@query("select_merge", SEED_SQL)
def _(spark, sf):
    t = read(spark, sf, "customer")
    return seed_rows(t, CATALOG, SubsetSpec(rules=SEEDS), NOW)[0].rows["customer"].select("pk", "anonymize")


# ---- traversal -------------------------------------------------------------------------------------------------------

DOWN = SubsetSpec({"lineitem": "excluded"}, SEEDS)


def _cascaded(t: dict[str, DataFrame], spec: SubsetSpec, catalog: Catalog = CATALOG) -> Kept:
    kept, _ = seed_rows(t, catalog, spec, NOW)
    cascade(kept, t, catalog, spec)
    return kept


CASCADE_SQL = f"""
    WITH seeds AS ({SEED_SQL})
    SELECT 'customer' AS "table", CAST(pk AS VARCHAR) AS pk, anonymize, CAST(NULL AS VARCHAR) AS identity FROM seeds
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), anonymize, 'customer:' || pk FROM orders JOIN seeds ON o_custkey = pk
    UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), anonymize, 'customer:' || pk FROM events JOIN seeds ON user_id = pk
"""


@query("cascade_down", CASCADE_SQL)
def _(spark, sf):
    return kept_table(_cascaded(read(spark, sf, "customer", "orders", "events"), DOWN))


BUILDING = Rule("customer", (Condition("c_mktsegment", "eq", "BUILDING"),))
BUILDING_SQL = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@query("cascade_preserve", """
    WITH c AS (SELECT c_custkey AS k, NOT (c_acctbal > 5000) AS anonymize FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT 'customer' AS "table", CAST(k AS VARCHAR) AS pk, anonymize, CAST(NULL AS VARCHAR) AS identity FROM c
    UNION ALL
    SELECT 'orders', CAST(o_orderkey AS VARCHAR), coalesce(c.anonymize, TRUE), 'customer:' || c.k
    FROM orders LEFT JOIN c ON o_custkey = c.k WHERE c.k IS NOT NULL OR o_totalprice > 200000
""")  # fmt: skip
def _(spark, sf):
    rules = (
        BUILDING,
        Rule("customer", raw="c_mktsegment = 'BUILDING' AND c_acctbal > 5000", anonymize=False),
        Rule("orders", (Condition("o_totalprice", "gt", 200000),)),
    )
    return kept_table(_cascaded(read(spark, sf, "customer", "orders"), SubsetSpec(rules=rules)))


@query("cascade_self_reference", f"""
    WITH RECURSIVE up AS (
        SELECT c_custkey FROM {C} WHERE c_mktsegment = 'BUILDING'
        UNION SELECT c.c_custkey FROM {C} c JOIN up ON c.parent_id = up.c_custkey
    ) SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS pk, TRUE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM up
""")  # fmt: skip
def _(spark, sf):
    catalog = Catalog({"customer": CATALOG.tables["customer"]}, (ForeignKey("customer", "parent_id", "customer", "c_custkey", True),))
    return kept_table(_cascaded(read(spark, sf, "customer"), SubsetSpec(rules=(BUILDING,)), catalog))


@query("cascade_typed_differently", f"SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS pk, TRUE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM {BUILDING_SQL} UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), TRUE, 'customer:' || o_custkey FROM orders WHERE o_custkey IN {BUILDING_SQL}")
def _(spark, sf):
    catalog = Catalog({n: CATALOG.tables[n] for n in ("customer", "orders")}, (ForeignKey("orders", "cust_text", "customer", "c_custkey"),))
    return kept_table(_cascaded(read(spark, sf, "customer", "orders"), SubsetSpec(rules=(BUILDING,)), catalog))


#: Every second key is padded, so its text is another one.
PADDED = "CASE WHEN o_orderkey % 2 = 0 THEN concat('00', o_custkey) ELSE CAST(o_custkey AS VARCHAR(20)) END"


@query("cascade_padded_text", f"SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS pk, TRUE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM {BUILDING_SQL} UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), TRUE, 'customer:' || o_custkey FROM orders WHERE o_custkey IN {BUILDING_SQL} AND o_orderkey % 2 <> 0")
def _(spark, sf):
    """A text refers to a number by the number's own text: ``007`` is not 7."""
    t = read(spark, sf, "customer", "orders")
    t["orders"] = t["orders"].withColumn("padded", F.expr(PADDED))
    catalog = Catalog({n: CATALOG.tables[n] for n in ("customer", "orders")}, (ForeignKey("orders", "padded", "customer", "c_custkey"),))
    return kept_table(_cascaded(t, SubsetSpec(rules=(BUILDING,)), catalog))


NEWEST = Rule("orders", (Condition("o_orderstatus", "eq", "F"), Condition("o_totalprice", "gt", 1000)), take=Take("top", 20, "o_orderdate"), anonymize=False)
NEWEST_SQL = "(SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20)"
UP = SubsetSpec({"lineitem": "excluded", "events": "excluded"}, (NEWEST,))
BACKFILL_SQL = f"""
    WITH o AS {NEWEST_SQL}, c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
    n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)),
    r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))
"""


def _backfilled(t: dict[str, DataFrame], spec: SubsetSpec, catalog: Catalog = CATALOG):
    kept, _ = seed_rows(t, catalog, spec, NOW)
    return kept, backfill(kept, t, catalog, spec)


@query("backfill_typed_differently", f"SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS pk FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {NEWEST_SQL})")
def _(spark, sf):
    """References that are floating or decimal numbers, to whole numbers."""
    t = read(spark, sf, "customer", "orders")
    t["orders"] = t["orders"].withColumns({"d": F.col("o_custkey").cast("double"), "n": F.col("o_custkey").cast("decimal(20,3)"), "half": F.col("o_custkey") + 0.5})
    fks = tuple(ForeignKey("orders", c, "customer", "c_custkey") for c in ("d", "n", "half"))
    kept = _backfilled(t, UP, Catalog({n: CATALOG.tables[n] for n in ("customer", "orders")}, fks))[0]
    return kept_table(kept).where(F.col("table") == "customer").select("table", "pk")


@query("backfill_up", BACKFILL_SQL + """
    SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS pk, FALSE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM o
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), TRUE, NULL FROM c
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), TRUE, NULL FROM n
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), TRUE, NULL FROM r
""")  # fmt: skip
def _(spark, sf):
    return kept_table(_backfilled(read(spark, sf, "orders", "customer", "nation", "region"), UP)[0])


@query("backfill_by_edge", BACKFILL_SQL + """
    SELECT 'customer' AS "table", 'orders.o_custkey' AS edge, count(*) AS added FROM c
    UNION ALL SELECT 'nation', 'customer.c_nationkey', count(*) FROM n
    UNION ALL SELECT 'region', 'nation.n_regionkey', count(*) FROM r
""")  # fmt: skip
def _(spark, sf):
    return _backfilled(read(spark, sf, "orders", "customer", "nation", "region"), UP)[1].by_edge()


@query("backfill_two_edges", f"""
    WITH o AS {NEWEST_SQL}, clerk AS (SELECT DISTINCT CAST(floor(o_custkey / 2) AS BIGINT) AS k FROM o)
    SELECT 'customer' AS "table", CASE WHEN c_custkey IN (SELECT o_custkey FROM o) THEN 'orders.o_custkey' ELSE 'orders.clerk' END AS edge, count(*) AS added
    FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o) OR c_custkey IN (SELECT k FROM clerk) GROUP BY ALL
""")  # fmt: skip
def _(spark, sf):
    t = read(spark, sf, "orders", "customer")
    t["orders"] = t["orders"].withColumn("clerk", F.floor(F.col("o_custkey") / 2).cast("long"))
    fks = (ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("orders", "clerk", "customer", "c_custkey"))
    catalog = Catalog({n: CATALOG.tables[n] for n in t}, fks)
    return _backfilled(t, UP, catalog)[1].by_edge()


@query("backfill_from_complete", "SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS pk, TRUE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _(spark, sf):
    t = read(spark, sf, "events", "customer")
    return kept_table(_backfilled(t, SubsetSpec({"events": "reference"}))[0])


@query("orphan_report", f"SELECT 'orders.broken' AS edge, count(DISTINCT broken) AS orphans FROM {O} WHERE broken NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'orders.o_custkey', 0")
def _(spark, sf):
    t = read(spark, sf, "orders", "customer")
    return orphans([Edge("orders", "broken", "customer"), Edge("orders", "o_custkey", "customer")], t, {"customer": "c_custkey"})


OWNERS = MorphRelation("events", "owner_type", "owner_id", (("Order", "orders"), ("Customer", "customer")), cascade_down=True)
NO_USER = Catalog(CATALOG.tables, tuple(f for f in CATALOG.foreign_keys if f.table not in ("events", "lineitem")))


@query("morph_down", f"""
    SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS pk, TRUE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM {BUILDING_SQL}
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), TRUE, 'customer:' || o_custkey FROM orders WHERE o_custkey IN {BUILDING_SQL}
    UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), TRUE, 'customer:' || owner_id FROM {E} WHERE owner_type = 'Customer' AND owner_id IN {BUILDING_SQL}
    UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), TRUE, 'customer:' || o_custkey FROM {E} JOIN orders ON owner_id = o_orderkey WHERE owner_type = 'Order' AND o_custkey IN {BUILDING_SQL}
""")  # fmt: skip
def _(spark, sf):
    return kept_table(_cascaded(read(spark, sf, "customer", "orders", "events"), SubsetSpec(rules=(BUILDING,), morphs=(OWNERS,)), NO_USER))


@query("morph_up", f"""
    WITH e AS (SELECT * FROM {E} WHERE event_type IN ('purchase', 'view')), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT owner_id FROM e WHERE owner_type = 'Order')),
    c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT owner_id FROM e WHERE owner_type = 'Customer') OR c_custkey IN (SELECT o_custkey FROM o))
    SELECT 'events' AS "table", CAST(event_id AS VARCHAR) AS pk, TRUE AS anonymize, CAST(NULL AS VARCHAR) AS identity FROM e
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), TRUE, NULL FROM o
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), TRUE, NULL FROM c
""")  # fmt: skip
def _(spark, sf):
    spec = SubsetSpec(rules=(Rule("events", (Condition("event_type", "in", ("purchase", "view")),)),), morphs=(OWNERS,))
    return kept_table(_backfilled(read(spark, sf, "events", "orders", "customer"), spec, NO_USER)[0])


@query("morph_unmapped", f"SELECT DISTINCT 'events.owner_type' AS relation, owner_type AS type_value FROM {E} WHERE owner_type NOT IN ('Order', 'Customer')")
def _(spark, sf):
    return profile.unmapped_types(read(spark, sf, "events"), [OWNERS])


# ---- flags, links, nulls ---------------------------------------------------------------------------------------------

FLAG = Rule("orders", (Condition("o_orderpriority", "eq", "1-URGENT"),), take=Take("none"), anonymize=False)
FLAG_SPEC = SubsetSpec({"lineitem": "excluded", "events": "excluded"}, (BUILDING, FLAG))


@query("flag_rules", f"SELECT o_orderkey AS pk, o_orderpriority <> '1-URGENT' AS anonymize, 'customer:' || o_custkey AS identity FROM orders WHERE o_custkey IN {BUILDING_SQL}")
def _(spark, sf):
    t = read(spark, sf, "customer", "orders")
    kept = _cascaded(t, FLAG_SPEC)
    flag_rules(kept, t, CATALOG, FLAG_SPEC, NOW)
    return kept.rows["orders"]


@query("flags_changed", f"SELECT 'orders' AS \"table\", count(*) AS changed FROM orders WHERE o_custkey IN {BUILDING_SQL} AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    t = read(spark, sf, "customer", "orders")
    return flag_rules(_cascaded(t, FLAG_SPEC), t, CATALOG, FLAG_SPEC, NOW)[0]


LINK_SPEC = SubsetSpec({"supplier": "reference"}, (Rule("orders", (Condition("o_orderpriority", "eq", "1-URGENT"),)), Rule("part", (Condition("p_size", "lt", 25),))))


@query("link_match", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def _(spark, sf):
    t = read(spark, sf, "orders", "part", "supplier", "lineitem")
    kept, _ = seed_rows(t, CATALOG, LINK_SPEC, NOW)
    link = next(x for x in detect_links(CATALOG, LINK_SPEC)[0] if x.table == "lineitem")
    return link_rows(link, t["lineitem"], kept, CATALOG, LINK_SPEC)[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("link_inferred", "SELECT order_id, part_id FROM (SELECT l_orderkey AS order_id, l_partkey AS part_id FROM lineitem) WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    t = read(spark, sf, "orders", "lineitem")
    t["order_part"] = t["lineitem"].select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"))
    catalog = Catalog({"orders": CATALOG.tables["orders"], "order_part": Table("order_part", ("order_id", "part_id"))})
    kept, _ = seed_rows(t, catalog, LINK_SPEC_ORDERS, NOW)
    return link_rows(detect_links(catalog, LINK_SPEC_ORDERS)[0][0], t["order_part"], kept, catalog, LINK_SPEC_ORDERS)[0]


LINK_SPEC_ORDERS = SubsetSpec(rules=LINK_SPEC.rules[:1])


@query("link_to_excluded", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE FALSE")
def _(spark, sf):
    t = read(spark, sf, "orders", "part", "lineitem")
    spec = SubsetSpec({"part": "excluded"}, LINK_SPEC_ORDERS.rules)
    kept, _ = seed_rows(t, CATALOG, spec, NOW)
    link = next(x for x in detect_links(CATALOG, spec)[0] if x.table == "lineitem")
    return link_rows(link, t["lineitem"], kept, CATALOG, spec)[0].select("l_orderkey", "l_linenumber")


@query("link_morph", f"SELECT event_id FROM {E} WHERE owner_type = 'Order' AND owner_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    t = read(spark, sf, "orders", "customer", "events")
    catalog = Catalog({**{n: CATALOG.tables[n] for n in ("orders", "customer")}, "events": Table("events", ("owner_type", "owner_id"))})
    spec = SubsetSpec({"customer": "excluded"}, LINK_SPEC_ORDERS.rules, morphs=(OWNERS,))
    kept, _ = seed_rows(t, catalog, spec, NOW)
    return link_rows(detect_links(catalog, spec)[0][0], t["events"], kept, catalog, spec)[0].select("event_id")


NULL_SPEC = SubsetSpec({"lineitem": "excluded", "events": "excluded"}, (Rule("orders", (Condition("o_orderstatus", "eq", "F"),)), BUILDING), policies={("orders", "o_custkey"): "null"})


@query("null_edges", f"SELECT o_orderkey, CASE WHEN o_custkey IN {BUILDING_SQL} THEN o_custkey END AS o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey IN {BUILDING_SQL}")
def _(spark, sf):
    return subset(read(spark, sf, "orders", "customer", "nation", "region"), CATALOG, NULL_SPEC, NOW).tables["orders"].select("o_orderkey", "o_custkey")


@query("nulled_counts", "SELECT 'orders.o_custkey' AS \"column\", count(*) AS nulled FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    t = read(spark, sf, "orders", "customer", "nation", "region")
    return nulled_counts(subset(t, CATALOG, NULL_SPEC, NOW), t, CATALOG)


@query("null_two_parents", f"SELECT o_orderkey, CASE WHEN o_custkey IN {BUILDING_SQL} AND o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN o_custkey END AS o_custkey FROM orders")
def _(spark, sf):
    t = read(spark, sf, "orders", "customer", "supplier")
    fks = (ForeignKey("orders", "o_custkey", "customer", "c_custkey", True), ForeignKey("orders", "o_custkey", "supplier", "s_suppkey", True))
    catalog = Catalog({n: CATALOG.tables[n] for n in t}, fks)
    spec = SubsetSpec(rules=(BUILDING, Rule("supplier", (Condition("s_acctbal", "gt", 0),))), policies={("orders", "o_custkey"): "null"})
    policies, _ = check_policies(catalog, spec)
    kept, _ = seed_rows(t, catalog, spec, NOW)
    return null_dangling(t["orders"], "orders", policies, kept, catalog, spec)[0].select("o_orderkey", "o_custkey")


# ---- anonymizing -----------------------------------------------------------------------------------------------------


def _anonymized(spark: SparkSession, sf_dir: str, table: str, column: str, s: Strategy, exception: FieldException | None = None) -> DataFrame:
    t = read(spark, sf_dir, table)[table]
    key = CATALOG.key(table)
    done = anonymize(t, table, key, [FieldStrategy(table, column, s, exception)], NOW, flag=ref(key) % 3 != 0)
    return done.select(key, column)


@query("anon_preserve", f"SELECT c_custkey, email FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "email", Strategy("preserve"))


@query("anon_redact", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE email END AS email FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "email", Strategy("redact"))


@query("anon_id_email", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN concat('user', c_custkey, '@example.com') ELSE email END AS email FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "email", Strategy("fake", "userIdEmail"))


@query("anon_keep_domain", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN concat('user', c_custkey, '@', split_part(email, '@', 2)) ELSE email END AS email FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "email", Strategy("fake", "userIdEmailKeepDomain"))


@query("anon_exception", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN email WHEN email LIKE '%@acme.com' THEN email ELSE concat('user', c_custkey, '@example.com') END AS email FROM {C}")
def _(spark, sf):
    staff = FieldException((Condition("email", "endsWith", "@acme.com"),), Strategy("preserve"))
    return _anonymized(spark, sf, "customer", "email", Strategy("fake", "userIdEmail"), staff)


@query("anon_fake_nullable", f"SELECT c_custkey, CASE WHEN nick IS NULL THEN NULL WHEN c_custkey % 3 <> 0 THEN {G.of('firstName', G.identity_key('customer', 'c_custkey', 'firstName'), G.EN)} ELSE nick END AS nick FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "nick", Strategy("fake", "firstName"))


def _generator(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = read(spark, sf_dir, "customer")["customer"]
        who = own_identity("customer", F.col("c_custkey"))
        value = generate(name, F.concat(who, F.lit(":" + name)), locale_of(F.col("country")), who, F.col("email"))
        return t.select("c_custkey", value.alias("value"))

    return run


for _name in GENERATORS:
    query(f"gen_{_name}", f"SELECT c_custkey, {G.of(_name, G.identity_key('customer', 'c_custkey', _name), G.LOCALE)} AS value FROM {C}")(_generator(_name))


@query("anon_jitter", f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN floor(price * (1 + ({G.seed(G.row_key('orders', 'o_orderkey', 'price'))} / 281474976710656.0::DOUBLE * 2 - 1) * 0.1::DOUBLE) + 0.5) ELSE price END AS BIGINT) AS price FROM {O}")
def _(spark, sf):
    return _anonymized(spark, sf, "orders", "price", Strategy("jitter", percent=10))


@query("anon_obfuscate_first", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {G.scramble('c_name', 'c_name', '0', '12')} ELSE c_name END AS c_name FROM customer")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "c_name", Strategy("obfuscate", side="first", count=12))


@query("anon_obfuscate_last", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {G.scramble('c_name', 'c_name', 'length(c_name) - 6', 'length(c_name)')} ELSE c_name END AS c_name FROM customer")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "c_name", Strategy("obfuscate", side="last", count=6))


@query("anon_obfuscate_before", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {G.scramble('email', 'email', '0', 'instr(email, chr(64)) - 1')} ELSE email END AS email FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "email", Strategy("obfuscate", side="before", delimiter="@"))


@query("anon_obfuscate_number", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {G.scramble('balance', 'CAST(balance AS VARCHAR)', '0', 'length(CAST(balance AS VARCHAR))')} ELSE CAST(balance AS VARCHAR) END AS balance FROM {C}")
def _(spark, sf):
    return _anonymized(spark, sf, "customer", "balance", Strategy("obfuscate", side="first", count=20))


@query("anon_unique", f"""
    WITH k AS (SELECT c_custkey, 'customer:' || CAST(floor(c_custkey / 2) AS BIGINT) AS who, CAST(floor(c_custkey / 2) AS BIGINT) AS id FROM {C})
    SELECT c_custkey, concat('user', id, CASE WHEN row_number() OVER (PARTITION BY who ORDER BY c_custkey) > 1 THEN '-1' ELSE '' END, '@example.com') AS email FROM k
""")  # fmt: skip
def _(spark, sf):
    t = read(spark, sf, "customer")["customer"]
    who = own_identity("customer", F.floor(F.col("c_custkey") / 2))
    return anonymize(t, "customer", "c_custkey", [FieldStrategy("customer", "email", Strategy("fake", "userIdEmail"))], NOW, identity=who, unique=("email",)).select("c_custkey", "email")


TEMPLATE = Strategy("template", bindings=(Binding("user.name", "fake", "firstName"), Binding("user.mail", "fake", "userIdEmail"), Binding("k", "redact"), Binding("tags", "remove"), Binding("absent.path", "fake", "city")))


@query("anon_template", f"""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN payload ELSE concat('{{"user":{{"name":"', {G.of('firstName', "('events:' || event_id || ':payload:user.name')", G.EN)},
        '","mail":"user', event_id, '@example.com"}},"k":null}}') END AS payload FROM {E}
""")  # fmt: skip
def _(spark, sf):
    return _anonymized(spark, sf, "events", "payload", TEMPLATE)


@query("json_read", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('m', user_id, '@x.example') END AS mail, CAST(NULL AS VARCHAR) AS tag FROM {E}")
def _(spark, sf):
    t = read(spark, sf, "events")["events"]
    return t.select("event_id", read_path(F.col("payload"), "user.mail").alias("mail"), read_path(F.col("payload"), "tags.first").alias("tag"))


@query("json_paths", f"""
    SELECT p.path, p.types, (SELECT count(*) FROM {E} WHERE p.every OR event_id % 2 = 0) AS present_in, (SELECT count(*) FROM events) AS sampled
    FROM (VALUES ('user.name', ['string'], TRUE), ('user.mail', ['null', 'string'], TRUE), ('k', ['number'], TRUE), ('tags', ['array'], FALSE)) p(path, types, every)
""")  # fmt: skip
def _(spark, sf):
    return discover(read(spark, sf, "events")["events"], "payload")


LOCALE_SPEC = SubsetSpec(
    {"lineitem": "excluded", "events": "excluded", "nation": "reference", "region": "reference"},
    (BUILDING,),
    (FieldStrategy("orders", "o_orderpriority", Strategy("fake", "zipCode")), FieldStrategy("customer", "nick", Strategy("fake", "zipCode"))),
    locales=(LocaleSource("customer", "country"),),
)


@query("locale_entity", f"SELECT o_orderkey, {G.of('zipCode', G.identity_key('customer', 'o_custkey', 'zipCode'), G.LOCALE)} AS o_orderpriority FROM orders JOIN {C} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    return subset(read(spark, sf, "customer", "orders", "nation", "region"), CATALOG, LOCALE_SPEC, NOW).tables["orders"].select("o_orderkey", "o_orderpriority")


@query("identity_declared", f"SELECT event_id, {G.of('fullName', G.identity_key('customer', 'user_id', 'fullName'), G.EN)} AS event_type FROM events WHERE event_type = 'purchase'")
def _(spark, sf):
    spec = SubsetSpec(
        {"customer": "reference"}, (Rule("events", (Condition("event_type", "eq", "purchase"),)),),
        (FieldStrategy("events", "event_type", Strategy("fake", "fullName")),), identities=(IdentitySource("events", "user_id", "customer"),),
    )
    return subset(read(spark, sf, "customer", "events"), CATALOG, spec, NOW).tables["events"].select("event_id", "event_type")


# ---- profiling -------------------------------------------------------------------------------------------------------


def _facts_sql(table: str, *columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) = count(*) AS is_unique FROM {table}"
        for c in columns
    )


@query("profile_keys", _facts_sql("nation", "n_nationkey", "n_name", "n_regionkey") + " UNION ALL " + _facts_sql("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
def _(spark, sf):
    return profile.profile_keys(read(spark, sf, "nation", "part"))


@query("profile_addressable", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{k}' AS declared_key, count(*) AS rows, count(DISTINCT {e}) AS distinct_keys, {a} AS addressable FROM {t}"
    for t, k, e, a in (("orders", "o_orderkey", "o_orderkey", "count(DISTINCT o_orderkey) = count(*)"), ("lineitem", "", "NULL", "FALSE"), ("events", "user_id", "user_id", "count(DISTINCT user_id) = count(*)"))
))
def _(spark, sf):
    catalog = Catalog({"orders": CATALOG.tables["orders"], "lineitem": Table("lineitem"), "events": Table("events", ("user_id",))})
    return profile.addressable(read(spark, sf, "orders", "lineitem", "events"), catalog)


@query("profile_edges", f"SELECT 'orders.buyer' AS edge, 'customer' AS parent, count(buyer) AS refs, count(*) - count(buyer) AS nulls, 0 AS orphans FROM {O} UNION ALL SELECT 'orders.broken', 'customer', count(broken), 0, (SELECT count(DISTINCT broken) FROM {O} WHERE broken NOT IN (SELECT c_custkey FROM customer)) FROM {O}")
def _(spark, sf):
    fks = [ForeignKey("orders", "buyer", "customer", "c_custkey"), ForeignKey("orders", "broken", "customer", "c_custkey")]
    return profile.edge_facts(read(spark, sf, "orders", "customer"), fks)


@query("edge_summary", """
    SELECT * FROM (VALUES ('customer', 2, 0, 1, (SELECT count(o_custkey) FROM orders) + (SELECT count(user_id) FROM events)),
        ('nation', 2, 2, 0, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)), ('orders', 1, 1, 0, (SELECT count(*) FROM lineitem)),
        ('part', 1, 1, 0, (SELECT count(*) FROM lineitem)), ('region', 1, 1, 0, (SELECT count(*) FROM nation)), ('supplier', 1, 1, 0, (SELECT count(*) FROM lineitem))
    ) s(target, edges, always_followed, turned_off, refs)
""")  # fmt: skip
def _(spark, sf):
    return profile.edge_summary(read(spark, sf), CATALOG, SubsetSpec(policies={("events", "user_id"): "null"}))


@query("detect_morph", f"SELECT DISTINCT 'events' AS \"table\", 'owner_type' AS type_column, 'owner_id' AS id_column, owner_type AS type_value, CASE owner_type WHEN 'Order' THEN 'orders' WHEN 'Customer' THEN 'customer' END AS guessed_table FROM {E} UNION ALL SELECT DISTINCT 'events', 'event_type', 'event_id', event_type, CAST(NULL AS VARCHAR) FROM events")
def _(spark, sf):
    return profile.detect_morphs(spark, read(spark, sf), CATALOG)


@query("pii_scan", f"""
    SELECT 'documents' AS "table", 'text' AS "column", FALSE AS by_name, {', '.join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {k}" for k, p in profile.PERSONAL_VALUES.items())} FROM documents
    UNION ALL SELECT 'customer', 'email', TRUE, count(*), 0, 0 FROM {C}
""")  # fmt: skip
def _(spark, sf):
    t = {"documents": spark.read.parquet(f"{sf}/documents.parquet"), "customer": read(spark, sf, "customer")["customer"].drop("score", "country", "nick")}
    return profile.personal_scan(spark, t, SubsetSpec())


KINDS = "CASE WHEN event_id % 3 = 0 THEN 'App\\\\Models\\\\Order' WHEN event_id % 3 = 1 THEN 'customer' ELSE concat('Kind', event_id % 97) END"


@query("detect_morph_many", f"""
    SELECT DISTINCT 'events' AS "table", 'subject_type' AS type_column, 'subject_id' AS id_column, kind AS type_value,
        CASE WHEN kind LIKE '%Order' THEN 'orders' WHEN kind = 'customer' THEN 'customer' END AS guessed_table
    FROM (SELECT {KINDS.replace(chr(92) * 2, chr(92))} AS kind FROM events)
""")  # fmt: skip
def _(spark, sf):
    """Far more type values than a handful."""
    t = read(spark, sf, "events", "orders", "customer")
    t["events"] = t["events"].select("event_id", F.expr(KINDS).alias("subject_type"), F.col("user_id").alias("subject_id"))
    return profile.detect_morphs(spark, t, CATALOG)


@query("policy_measured", """
    SELECT * FROM (VALUES ('orders.buyer', 'null', NULL), ('orders.o_custkey', 'follow', 'holds no null'), ('orders.nation', 'follow', 'the parent column is no key'),
        ('orders.far', 'follow', 'most of its references are not there')) v(edge, policy, reason)
    WHERE (SELECT count(*) FROM orders WHERE o_custkey IS NULL) = 0 AND (SELECT count(*) > count(DISTINCT c_nationkey) FROM customer)
""")  # fmt: skip
def _(spark, sf):
    """Declared as nullable references to keys; the data say otherwise of three of them."""
    t = read(spark, sf, "orders", "customer")
    t["orders"] = t["orders"].withColumns({
        "nation": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 25), "far": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 10_000_000),
    })
    fks = tuple(ForeignKey("orders", c, "customer", k, True) for c, k in (("buyer", "c_custkey"), ("o_custkey", "c_custkey"), ("nation", "c_nationkey"), ("far", "c_custkey")))
    catalog = Catalog({n: CATALOG.tables[n] for n in t}, fks)
    spec = SubsetSpec(policies={("orders", f.column): "null" for f in fks})
    return measured_policies(t, catalog, spec)


REFERENCE_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "events": ("event_id", "user_id"),
}


@query("references_discovered", f"""
    WITH v AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v, typeof({c}) = 'VARCHAR' AS is_text FROM {t}" for t, cs in REFERENCE_COLUMNS.items() for c in cs)}),
    d AS (SELECT t, c, is_text, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
    s AS (SELECT t, c, count(v) AS refs, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_refs, count(DISTINCT v) = count(*) AS is_key FROM v GROUP BY ALL),
    met AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS there FROM d a JOIN d b ON a.v = b.v AND a.is_text = b.is_text AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
    SELECT met.t AS "table", met.c AS "column", pt AS parent, pc AS parent_column, a.refs, a.distinct_refs, a.nulls, split_part(met.c, '_', 2) = split_part(pc, '_', 2) AND split_part(pc, '_', 2) <> 'id' AS by_name
    FROM met JOIN s a ON a.t = met.t AND a.c = met.c JOIN s b ON b.t = pt AND b.c = pc AND b.is_key WHERE there = a.distinct_refs
""")  # fmt: skip
def _(spark, sf):
    """Nothing declared; every inclusion in a key among the columns of six tables."""
    plain = read(spark, sf, *REFERENCE_COLUMNS)
    return discover_references({t: plain[t].select(*cs) for t, cs in REFERENCE_COLUMNS.items()})


@query("integrity_audit", f"SELECT 'orders.broken' AS edge, count(*) AS rows_dangling, count(DISTINCT broken) AS orphans FROM {O} WHERE broken NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.l_orderkey', 0, 0")
def _(spark, sf):
    t = read(spark, sf, "orders", "customer", "lineitem")
    return profile.integrity_audit(t, [Edge("orders", "broken", "customer"), Edge("lineitem", "l_orderkey", "orders")], {"customer": "c_custkey", "orders": "o_orderkey"})


# ---- sinks and whole jobs --------------------------------------------------------------------------------------------

LITERAL_COLUMNS = ("c_custkey", "nick", "big", "c_acctbal", "raw")


def _literals(dialect: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = read(spark, sf_dir, "customer")["customer"]
        t = t.select("c_custkey", F.concat("nick", F.lit("'s \\ x")).alias("nick"), (F.col("c_acctbal") > 0).alias("big"), F.floor("c_acctbal").cast("double").alias("c_acctbal"), F.encode("c_name", "UTF-8").alias("raw"))
        return value_rows(t, dialect)

    return run


def _literal_sql(name: str, yes: str, no: str, blob: str) -> str:
    return f"""SELECT concat('(', c_custkey, ', ', coalesce({name}, 'NULL'), ', ', CASE WHEN c_acctbal > 0 THEN '{yes}' ELSE '{no}' END, ', ',
        CAST(floor(c_acctbal) AS BIGINT), ', ', {blob}, ')') AS row FROM {C}"""


query("sql_rows_mysql", _literal_sql("chr(39) || nick || '\\''s \\\\ x' || chr(39)", "true", "false", "concat('X''', lower(hex(c_name)), '''')"))(_literals("mysql"))
query("sql_rows_postgres", _literal_sql("' E' || chr(39) || nick || '''''s \\\\ x' || chr(39)", "TRUE", "FALSE", "concat(' E''\\\\x', lower(hex(c_name)), '''')"))(_literals("postgres"))
query("sql_rows_sqlite", _literal_sql("chr(39) || nick || '''''s \\ x' || chr(39)", "1", "0", "concat('X''', lower(hex(c_name)), '''')"))(_literals("sqlite"))


@query("sql_rows_odd_values", """
    SELECT concat('(', o_orderkey, ', ''', strftime(o_orderdate, '%Y-%m-%d 00:00:00'), CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.125' ELSE '.25' END, ''', ',
        CASE WHEN o_orderkey % 5 = 0 THEN '''NaN''' ELSE '0.5' END, ', ', ' E''{"\\\\"', o_orderstatus, '\\\\"",NULL}''', ')') AS row FROM orders
""")  # fmt: skip
def _(spark, sf):
    """Fractions of seconds, numbers that are none, arrays with nulls and quotes."""
    t = read(spark, sf, "orders")["orders"]
    moment = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("o_orderkey") % 3 / 8).cast("decimal(18,6)"))
    odd = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(0.5)
    tags = F.array(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), F.lit(None).cast("string"))
    return value_rows(t.select("o_orderkey", moment.alias("at"), odd.alias("odd"), tags.alias("tags")), "postgres")


@query("sql_statements", "SELECT concat('(', o_orderkey, ', ''', o_orderpriority, ''')') AS row FROM orders")
def _(spark, sf):
    """The rows inside the statements; a statement of another form stops the job."""
    rows = read(spark, sf, "orders")["orders"].select("o_orderkey", "o_orderpriority")
    head = 'INSERT INTO "orders" ("o_orderkey", "o_orderpriority") OVERRIDING SYSTEM VALUE VALUES\n'
    inside = F.split(F.expr(f"substring(statement, {len(head) + 1}, length(statement) - {len(head) + 1})"), ",\n")
    sound = F.col("statement").startswith(head) & F.col("statement").endswith(";") & (F.size(inside) <= 10)
    inside = F.when(sound, inside).otherwise(F.raise_error(F.lit("not a statement of up to 10 rows")))
    return insert_statements(rows, "orders", "postgres", 10).select(F.explode(inside).alias("row"))


@query("sequence_next", "SELECT 'customer' AS \"table\", 'c_custkey' AS \"column\", max(c_custkey) AS value, TRUE AS is_called FROM customer UNION ALL SELECT 'orders', 'o_orderkey', coalesce(max(o_orderkey), 1), count(*) > 0 FROM orders WHERE o_totalprice < 0")
def _(spark, sf):
    t = read(spark, sf, "customer", "orders")
    return sequence_state({"customer": t["customer"], "orders": t["orders"].where("o_totalprice < 0")}, CATALOG)


FULL = SubsetSpec(
    {"region": "reference", "nation": "reference", "supplier": "reference"},
    (NEWEST, Rule("customer", (Condition("c_acctbal", "gt", 9500),)), Rule("part", (Condition("p_size", "lte", 10),))),
    (FieldStrategy("customer", "email", Strategy("fake", "userIdEmailKeepDomain")), FieldStrategy("customer", "nick", Strategy("redact"))),
)
#: As FULL, with tables that come out without rows: their structure only, not at all, and a link table with an endpoint that is not there.
HOLLOW = SubsetSpec(FULL.classes | {"events": "structure", "supplier": "excluded"}, FULL.rules, FULL.strategies)
FULL_SQL = f"""
    WITH c0 AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9500), newest AS {NEWEST_SQL},
    o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c0) OR o_orderkey IN (SELECT o_orderkey FROM newest)),
    c AS (SELECT * FROM {C} WHERE c_custkey IN (SELECT c_custkey FROM c0) OR c_custkey IN (SELECT o_custkey FROM o)),
    p AS (SELECT * FROM part WHERE p_size <= 10), e AS (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM c0)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_partkey IN (SELECT p_partkey FROM p))
"""
FULL_COUNTS = """SELECT 'region' AS "table", count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'part', count(*) FROM p UNION ALL SELECT 'orders', count(*) FROM o
    UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'events', count(*) FROM e"""


@query("subset_full", FULL_SQL + "SELECT c_custkey, concat('user', c_custkey, '@', split_part(email, '@', 2)) AS email, CAST(NULL AS VARCHAR) AS nick, c_nationkey FROM c")
def subset_full(spark, sf):
    return subset(read(spark, sf), CATALOG, FULL, NOW).tables["customer"].select("c_custkey", "email", "nick", "c_nationkey")


@query("subset_lines", FULL_SQL + "SELECT l_orderkey, l_partkey, l_linenumber FROM l")
def _(spark, sf):
    return subset(read(spark, sf), CATALOG, FULL, NOW).tables["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber")


@query("subset_row_counts", FULL_SQL + """
    SELECT 'region' AS "table", count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM c
    UNION ALL SELECT 'part', count(*) FROM p UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', 0 UNION ALL SELECT 'events', 0
""")  # fmt: skip
def _(spark, sf):
    return subset(read(spark, sf), CATALOG, HOLLOW, NOW).row_counts()


@query("subset_integrity", FULL_SQL + """
    SELECT 'customer.c_nationkey' AS edge, count(*) AS rows_dangling, count(DISTINCT c_nationkey) AS orphans FROM c WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'orders.o_custkey', count(*), count(DISTINCT o_custkey) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
    UNION ALL SELECT 'nation.n_regionkey', count(*), count(DISTINCT n_regionkey) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
    UNION ALL SELECT 'lineitem.l_orderkey', count(*), count(DISTINCT l_orderkey) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
    UNION ALL SELECT 'lineitem.l_partkey', count(*), count(DISTINCT l_partkey) FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM p)
    UNION ALL SELECT 'events.user_id', count(*), count(DISTINCT user_id) FROM e WHERE user_id NOT IN (SELECT c_custkey FROM c)
""")  # fmt: skip
def _(spark, sf):
    out = subset(read(spark, sf), CATALOG, FULL, NOW).tables
    wanted = ("customer.c_nationkey", "orders.o_custkey", "nation.n_regionkey", "lineitem.l_orderkey", "lineitem.l_partkey", "events.user_id")
    edges = [e for e in edges_of(CATALOG, FULL, "up") if e.label in wanted]
    return profile.integrity_audit(out, edges, {n: CATALOG.key(n) for n in out})


@query("subset_totals", FULL_SQL + f"SELECT count(*) AS tables_with_rows, CAST(sum(rows) AS BIGINT) AS rows FROM ({FULL_COUNTS}) WHERE rows > 0")
def _(spark, sf):
    return subset(read(spark, sf), CATALOG, FULL, NOW).totals()


@query("subset_largest", FULL_SQL + f"SELECT row_number() OVER (ORDER BY rows DESC, \"table\") AS place, \"table\", rows FROM ({FULL_COUNTS}) WHERE rows > 0")
def _(spark, sf):
    return subset(read(spark, sf), CATALOG, FULL, NOW).largest_first()


# ---- guards and warnings ----------------------------------------------------------------------------------------------

KEEP_ALL = SubsetSpec({"lineitem": "excluded", "events": "excluded"}, (Rule("customer"), NEWEST))


@query("keep_all", f"SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS pk FROM customer UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def _(spark, sf):
    """A table of which a rule keeps every row brings its children, and asks for its parents, but is not asked itself."""
    t = read(spark, sf, "customer", "orders", "nation")
    return kept_table(select_rows(t, CATALOG, KEEP_ALL, NOW)[0]).select("table", "pk")


@query("backfill_warnings", f"""
    SELECT 'orders.o_custkey: customer is not in the output, so these references dangle' AS warning WHERE EXISTS (SELECT 1 FROM {NEWEST_SQL} WHERE o_custkey IS NOT NULL)
    UNION ALL SELECT 'orders.nation: nation is not referred to by its primary key: not backfilled' WHERE EXISTS (SELECT 1 FROM {NEWEST_SQL} WHERE o_custkey IS NOT NULL)
""")  # fmt: skip
def _(spark, sf):
    """References into a table that is left out, and to a column that is no primary key."""
    t = read(spark, sf, "orders", "customer", "nation")
    t["orders"] = t["orders"].withColumn("nation", F.concat(F.lit("N"), F.col("o_custkey") % 25))
    fks = (ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("orders", "nation", "nation", "n_name"))
    spec = SubsetSpec({"customer": "excluded"}, (NEWEST,))
    report = _backfilled(t, spec, Catalog({n: CATALOG.tables[n] for n in t}, fks))[1]
    return spark.createDataFrame([(w,) for w in report.warnings], "warning string")


@query("sql_rows_generated", f"SELECT concat('(', c_custkey, ', ', coalesce('''' || nick || '''', 'NULL'), ')') AS row FROM {C}")
def _(spark, sf):
    t = read(spark, sf, "customer")["customer"].select("c_custkey", "email", "nick", "balance")
    return value_rows(t, "sqlite", ("email", "balance"))


MIXED_JSON = "CASE event_id % 4 WHEN 0 THEN '[1,2.50]' WHEN 1 THEN 'not json' WHEN 2 THEN NULL ELSE concat('{\"a\":', event_id, ',\"b\":1.50}') END"


@query("anon_template_non_objects", f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '{{\"a\":null,\"b\":1.50}}' ELSE {MIXED_JSON} END AS doc FROM events")
def _(spark, sf):
    t = read(spark, sf, "events")["events"].select("event_id", F.expr(MIXED_JSON).alias("doc"))
    redact = Strategy("template", bindings=(Binding("a", "redact"),))
    return anonymize(t, "events", "event_id", [FieldStrategy("events", "doc", redact)], NOW)


@query("pred_instant_text", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-02-29 00:00:00'")
def _(spark, sf):
    """Instants kept as text, against a constant with another spelling of the same."""
    t = read(spark, sf, "orders")["orders"].withColumn("day", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000Z")))
    return matching(t, Rule("orders", (Condition("day", "gt", "1996-02-29 00:00:00"),)), "o_orderkey", NOW).select("o_orderkey")


@query("kept_rows", CASCADE_SQL)
def _(spark, sf):
    t = read(spark, sf, "customer", "orders", "events")
    spec = SubsetSpec({"nation": "reference", "region": "reference", "lineitem": "excluded"}, SEEDS)
    return kept_table(select_rows(t, CATALOG, spec, NOW)[0])

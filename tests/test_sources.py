"""Live tables read in ranges, and references found in the data."""

import uuid

import pytest
from pyspark.sql import functions as F

from cohort.catalog import Catalog, ForeignKey, SubsetSpec, Table
from cohort.sources.inclusion import candidate_pairs, column_sketches, discover_references, named_after, with_discovered
from cohort.sources.profile import edge_summary
from cohort.sources.scans import jdbc_table, key_ranges

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture
def live(spark):
    """Writes tables to a database in memory; its address."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"

    def put(table, df, **types):
        df.write.options(**types).jdbc(url, table, properties=DRIVER)
        return url

    return put


def sizes(df):
    return sorted(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())


def test_ranges_of_a_skewed_key(spark, live):
    """Most keys in a short stretch, a few far out: equal widths would put nearly all rows in one range."""
    rows = spark.range(2_000).select(F.when(F.col("id") % 50 == 0, F.col("id") * 1_000_003).otherwise(F.col("id")).alias("id"), F.lit("x").alias("v"))
    url = live("skewed", rows)
    df = jdbc_table(spark, url, "skewed", "id", 8, **DRIVER)
    assert sorted(df.collect()) == sorted(rows.collect())
    found = sizes(df)
    assert len(found) == 8 and found[-1] <= 2 * found[0]


def test_ranges_of_text(spark, live):
    """Long common beginnings, quotes, case and blanks: each row once, evenly."""
    key = F.concat(F.lit("it's a \\long beginning/"), F.when(F.col("id") % 3 == 0, F.lit("A")).otherwise("a"), F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(600).select(key.alias("k"))
    url = live("texts", rows, createTableColumnTypes="k VARCHAR(120)")
    df = jdbc_table(spark, url, "texts", "k", 5, **DRIVER)
    assert sorted(df.collect()) == sorted(rows.collect())
    found = sizes(df)
    assert len(found) == 5 and found[-1] <= 2 * found[0]


def test_ranges_with_nulls_and_repeats(spark, live):
    rows = spark.range(300).select(F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    url = live("repeats", rows)
    df = jdbc_table(spark, url, "repeats", "k", 6, **DRIVER)
    assert df.where("k IS NULL").count() == 30 and df.where("k = 7").count() == rows.where("k = 7").count() and df.count() == 300
    hot = df.withColumn("p", F.spark_partition_id()).where("k = 7").select("p").distinct()
    assert hot.count() == 1


@pytest.mark.parametrize(("rows", "most"), [(0, 1), (1, 1), (3, 3)])
def test_ranges_of_small_tables(spark, live, rows, most):
    url = live("few", spark.range(rows))
    assert len(key_ranges(spark, url, "few", "id", 8, **DRIVER)) <= most
    assert jdbc_table(spark, url, "few", "id", 8, **DRIVER).count() == rows
    assert jdbc_table(spark, url, "few", **DRIVER).count() == rows


def test_ranges_need_a_plain_key(spark, live):
    url = live("odd", spark.range(10).select((F.col("id") / 3).alias("k")))
    with pytest.raises(ValueError, match="whole numbers"):
        key_ranges(spark, url, "odd", "k", 4, **DRIVER)
    with pytest.raises(ValueError, match="one range"):
        key_ranges(spark, url, "odd", "k", 0, **DRIVER)


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "users": spark.range(1, 5_001).select("id", F.concat(F.lit("u"), "id").alias("login"), F.lit(None).cast("string").alias("note")),
        "orders": spark.range(20_000).select((F.col("id") + 10**6).alias("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5_000 + 1).cast("decimal(12,2)").alias("user_id"), (F.col("id") % 5_001 + 1).alias("stray")),
        "logins": spark.range(900).select(F.concat(F.lit("u"), F.col("id") + 1).alias("login"), (F.col("id") / 2).alias("share"), F.array("id").alias("many")),
    }


def test_discovered_references(shop):
    """One value too many (``stray``) is no reference, though sketches may not see it; keys that repeat are no keys."""
    found = {tuple(r) for r in discover_references(shop).collect()}
    assert found == {
        ("orders", "user_id", "users", "id", 17_142, 5_000, 2_858, True),
        ("logins", "login", "users", "login", 900, 900, 0, True),
    }


def test_sketches_lose_no_inclusion(spark):
    """Children of every size, nested in one key."""
    tables = {"key": spark.range(100_000)} | {f"child{n}": spark.range(n).select(F.col("id").alias("ref")) for n in (1, 5, 60, 700, 9_000, 99_999, 100_000)}
    pairs = {(r["table"], r["parent"]) for r in candidate_pairs(column_sketches(tables)).collect()}
    assert {(t, "key") for t in tables if t != "key"} <= pairs


def test_discovery_of_odd_tables(spark, shop):
    empty = {"none": spark.range(0), "nulls": spark.range(3).select(F.lit(None).cast("long").alias("ref"))}
    assert discover_references(empty).count() == 0
    with pytest.raises(ValueError, match="no table"):
        column_sketches({"shares": shop["logins"].select("share", "many")})
    dotted = {"a.b": spark.range(9).select(F.col("id").alias("x.id")), "c": spark.range(4).select(F.col("id").alias("x.ref"))}
    assert [tuple(r)[:4] for r in discover_references(dotted).collect()] == [("c", "x.ref", "a.b", "x.id")]


def test_catalog_with_discovered(shop):
    catalog = Catalog({"users": Table("users", ("id",)), "orders": Table("orders", ("id",)), "logins": Table("logins")})
    assert with_discovered(shop, catalog).foreign_keys == (ForeignKey("orders", "user_id", "users", "id", nullable=True),)
    declared = Catalog(catalog.tables, (ForeignKey("orders", "user_id", "users", "id"),))
    assert with_discovered(shop, declared) == declared


@pytest.mark.parametrize(("column", "parent", "key", "agrees"), [
    ("user_id", "users", "id", True), ("billing_user_id", "users", "id", True), ("user_id", "events", "event_id", False), ("c_nationkey", "nation", "n_nationkey", True),
    ("id", "users", "id", False), ("stray", "users", "id", False), ("companyId", "companies", "id", True), ("login", "users", "login", True), ("p_size", "part", "p_partkey", False),
])
def test_named_after(column, parent, key, agrees):
    assert named_after(column, parent, key) is agrees


def test_edge_summary_scans_a_table_once(shop):
    fks = (ForeignKey("orders", "user_id", "users", "id", True), ForeignKey("orders", "stray", "users", "id"))
    df = edge_summary(shop, Catalog({}, fks), SubsetSpec(policies={("orders", "user_id"): "null"}))
    assert [tuple(r) for r in df.collect()] == [("users", 2, 1, 1, 37_142)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1

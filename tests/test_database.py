"""Extracts and loads against a database in memory, which Spark ships for its catalog."""

import uuid

import pytest
from pyspark.sql import functions as F

from brindle.sources.database import Database, DatabaseError, load_order


@pytest.fixture()
def db(spark):
    made = Database(spark, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")
    with made._transaction() as run:
        run("CREATE TABLE regions (region_id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, name CLOB)")
        run("CREATE TABLE stores (store_id BIGINT PRIMARY KEY, region_id BIGINT REFERENCES regions, size DOUBLE)")
        run("CREATE TABLE sales (sale_id BIGINT, store_id BIGINT REFERENCES stores, units INT)")
    return made


REFERENCES = [("sales", "store_id", "stores", "store_id"), ("stores", "region_id", "regions", "region_id")]


def frames(spark, lost=False):
    regions = spark.createDataFrame([(1, "north"), (7, "")], "region_id long, name string").withColumn("name", F.nullif("name", F.lit("")))
    stores = spark.createDataFrame([(1, 1, 2.5), (2, 7, None), (3, None, 1.0)], "store_id long, region_id long, size double")
    sales = spark.range(1000).select(F.col("id").alias("sale_id"), (F.col("id") % (4 if lost else 3) + 1).alias("store_id"), (F.col("id") % 5).cast("int").alias("units"))
    return {"sales": sales, "stores": stores, "regions": regions}


def content(db, table):
    return sorted(map(repr, db.rows(f"SELECT * FROM {table}")))


def test_loads_in_reference_order_and_again(spark, db):
    assert load_order(frames(spark), REFERENCES) == ["regions", "stores", "sales"]
    for _ in range(2):
        got = db.load(frames(spark), REFERENCES, {"regions": "region_id"})
        assert list(got.items()) == [("regions", 2), ("stores", 3), ("sales", 1000)]
    assert "None" in "".join(content(db, "regions"))
    with db._transaction() as run:  # generated keys go on after the loaded ones
        run("INSERT INTO regions (name) VALUES ('new')")
    assert db.rows("SELECT max(region_id) AS k FROM regions")[0][0] == 8
    assert not [r for r in db.rows("SELECT tablename FROM sys.systables") if r[0].endswith("_STAGED")]


def test_an_orphan_stops_the_swap(spark, db):
    db.load(frames(spark), REFERENCES)
    before = {t: content(db, t) for t in frames(spark)}
    with pytest.raises(DatabaseError, match="ORPHANS: sales.store_id: 250"):
        db.load(frames(spark, lost=True), REFERENCES)
    # An orphan that only the database knows of undoes the whole transaction.
    with pytest.raises(Exception, match="foreign key"):
        db.load(frames(spark, lost=True), REFERENCES[1:])
    assert {t: content(db, t) for t in before} == before
    assert not [r for r in db.rows("SELECT tablename FROM sys.systables") if r[0].endswith("_STAGED")]
    with pytest.raises(DatabaseError, match="CYCLE"):
        load_order(["a", "b"], [("a", "x", "b", "x"), ("b", "x", "a", "x")])


def test_extract_by_ranges_of_sparse_keys(spark, db):
    ids = [*range(300), *range(10**12, 10**12 + 500), *[77] * 40, None, None]
    rows = spark.createDataFrame([(i, None, 1) for i in ids], "sale_id long, store_id long, units int")
    db.load({"sales": rows})
    parts = db.ranges("sales", "sale_id", 100)
    counts = [spark.read.jdbc(db.url, "sales", predicates=[p]).count() for p in parts]  # each partition alone
    assert sum(counts) == len(ids) and max(counts) <= 100 and len(parts) < 2 * len(ids) / 100 and counts[-1] == 2
    got = db.extract("sales", "sale_id", 100)
    assert got.rdd.getNumPartitions() == len(parts)
    assert sorted(str(r[0]) for r in got.select("SALE_ID").collect()) == sorted(map(str, ids))
    plan = got.filter("SALE_ID > 500").select("SALE_ID")._jdf.queryExecution().toString()
    assert "GreaterThan(SALE_ID,500)" in plan and "UNITS" not in plan.rpartition("Physical Plan")[2]
    assert [r for r in db.ranges("sales", "sale_id", 30) if "77" in r]


def test_negative_keys_and_empty_tables(spark, db):
    assert db.ranges("sales", "sale_id") == [] and db.extract("sales", "sale_id").count() == 0
    rows = spark.range(-500, 500).select(F.col("id").alias("sale_id"), F.lit(None).cast("long").alias("store_id"), F.lit(1).alias("units"))
    db.load({"sales": rows})
    assert db.extract("sales", "sale_id", 64).agg(F.count_distinct("SALE_ID")).first()[0] == 1000


def test_replicated_tables_reconcile(spark, db, tmp_path):
    db.load(frames(spark), REFERENCES)
    keys = {"regions": "region_id", "stores": "store_id", "sales": "sale_id"}
    manifest = db.replicate(keys, str(tmp_path), 200)
    assert {r.table_name: r.row_count for r in manifest.collect()} == {"regions": 2, "stores": 3, "sales": 1000}
    assert spark.read.parquet(str(tmp_path / "sales")).agg(F.sum("UNITS")).first()[0] == 2000

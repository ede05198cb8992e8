"""Every registered query with an oracle against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.sources import roles

DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = con.sql(ORACLES[name])
    names = list(result.columns)
    want = [tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in result.fetchall()]
    assert sorted(names) == columns
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry_runs(spark):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").selectExpr("datediff(max(to_date(l_shipdate)), min(to_date(l_shipdate))) + 1 AS days")
    assert entry.entry(spark).count() == 25 * 6 * lines.first().days


def test_the_product_mart_does_not_expand_its_lines(spark):
    """Two distinct counts would shuffle every line once for each of them and once for the sums."""
    plan = __import__("__spark_entry__").queries()["m_mart_product_performance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_sales_by_order_are_dealt_out_by_the_number_of_lines(spark, monkeypatch):
    """More lines make more parts, not larger ones; an order's lines stay together, no line is lost and results stay the same."""
    names = ("a19_basket_density", "bi05_average_basket", "bk02_pair_rules", "bk04_rule_stability", "u05_itemsets_agree", "j15_item_pairs", "bk05_support_levels")
    before = {n: sorted(entry.queries()[n](spark, DIR).collect(), key=repr) for n in names}
    monkeypatch.setattr(roles, "ORDER_LINES", 300, raising=False)
    assert {n: sorted(entry.queries()[n](spark, DIR).collect(), key=repr) for n in names} == before
    part = F.spark_partition_id().alias("part")
    basket = entry.queries()["ds06_basket"](spark, DIR)
    assert max(r["count"] for r in basket.groupBy(part).count().collect()) < 3 * 300
    assert basket.select("order_id", part).distinct().count() == basket.select("order_id").distinct().count()
    dealt, plain_sales = roles.sales(spark, DIR, by_order=True), roles.sales(spark, DIR)
    assert dealt.exceptAll(plain_sales).isEmpty() and plain_sales.exceptAll(dealt).isEmpty()


def test_many_products_and_stores_are_hashed_within_their_partition(spark, monkeypatch):
    """Else a task sorts all lines that meet a part of the products, or holds every store."""
    names = ("bk02_pair_rules", "bi07_recommended_products", "bi07_rule_kpis", "bi07_rule_pairs", "bi07_rule_table")
    before = {n: [tuple(r) for r in entry.queries()[n](spark, DIR).collect()] for n in names}
    monkeypatch.setattr(roles, "ORDER_LINES", 300)
    monkeypatch.setattr(roles, "HASHED_FROM", 1, raising=False)
    for n in names:
        df = entry.queries()[n](spark, DIR)
        plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
        for key in ("l_partkey", "o_custkey"):
            joins = [line for line in plan if "Join" in line and key in line]
            assert joins and all("ShuffledHashJoin" in line for line in joins)
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(before[n], key=repr)
    dealt, plain_sales = roles.sales(spark, DIR, by_order=True), roles.sales(spark, DIR)
    assert dealt.exceptAll(plain_sales).isEmpty() and plain_sales.exceptAll(dealt).isEmpty()


def test_promotion_days_compute_the_sales_twice_only(spark):
    """Once for units, once for prices; which promotions overlap needs no sales."""
    plan = entry.queries()["q09_promotion_diagnostics"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "o_orderkey" in line for line in plan.split("\n")) == 2


def test_integrity_checks_join_sales_and_stock_once(spark):
    """They are stored by day and category first; of the products the query itself only looks up keys and categories."""
    plan = entry.queries()["q04_integrity_checks"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Join" in line and "p_partkey" in line for line in plan) == 1
    assert not any("Join" in line and key in line for line in plan for key in ("n_regionkey", "o_custkey#", "c_nationkey") if "LeftAnti" not in line)


#: What is planted in a copy of the smallest tables: rows of a query, or (last) a filter of those that stay.
PLANTED = {
    "lineitem": """SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey < 9
        UNION ALL SELECT * REPLACE (-1 AS l_orderkey, 0 AS l_quantity) FROM lineitem WHERE l_orderkey = 7 UNION ALL SELECT * REPLACE (NULL AS l_orderkey, -2 AS l_quantity) FROM lineitem WHERE l_orderkey = 8
        UNION ALL SELECT * REPLACE (-1 AS l_partkey, 1.5 AS l_discount) FROM lineitem WHERE l_orderkey = 9 UNION ALL SELECT * REPLACE (NULL AS l_partkey, -0.5 AS l_discount) FROM lineitem WHERE l_orderkey = 10
        UNION ALL SELECT * REPLACE (-1 AS l_suppkey, -5 AS l_extendedprice) FROM lineitem WHERE l_orderkey = 11 UNION ALL SELECT * REPLACE (NULL AS l_suppkey) FROM lineitem WHERE l_orderkey = 12
        UNION ALL SELECT * REPLACE (1.5 AS l_discount) FROM lineitem WHERE l_orderkey = 13""",
    "orders": """SELECT * FROM orders UNION ALL SELECT * REPLACE (o_orderdate + INTERVAL 9 YEAR AS o_orderdate) FROM orders WHERE o_orderkey IN (5, 6, 7, 13)
        UNION ALL SELECT * REPLACE (-7 AS o_orderkey, -1 AS o_custkey) FROM orders WHERE o_orderkey < 4 UNION ALL SELECT * REPLACE (-8 AS o_orderkey, NULL AS o_custkey) FROM orders WHERE o_orderkey < 3""",
    "customer": "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey < 20",
    "part": "SELECT * FROM part UNION ALL SELECT * REPLACE ('OTHER' AS p_type) FROM part WHERE p_partkey < 5 UNION ALL SELECT * REPLACE (NULL AS p_type) FROM part WHERE p_partkey IN (6, 7)",
}
NULL_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey"}


@pytest.mark.parametrize("case", ["planted", "null_keys", "no_orders"])
def test_integrity_checks_count_what_is_planted(spark, tmp_path, case):
    """Repeated and missing keys, null keys on either side of a reference and a table without rows, as SQL counts them."""
    source, copy = duckdb.connect(), duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        source.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        rows = PLANTED.get(t, f"SELECT * FROM {t}")
        if case == "null_keys" and t in NULL_KEYS:
            rows = f"SELECT * FROM ({rows}) UNION ALL (SELECT * REPLACE (NULL AS {NULL_KEYS[t]}) FROM {t} LIMIT 1)"
        if case == "no_orders" and t == "orders":
            rows = "SELECT * FROM orders WHERE false"
        types = ", ".join(f"{c}::{k} AS {c}" for c, k, *_ in source.sql(f"DESCRIBE {t}").fetchall())
        source.sql(f"COPY (SELECT {types} FROM ({rows})) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        copy.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = {r["check_name"]: r["violations"] for r in entry.queries()["q04_integrity_checks"](spark, str(tmp_path)).collect()}
    want = dict(copy.sql(ORACLES["q04_integrity_checks"]).fetchall())
    assert got == want
    assert sum(v != 0 for v in want.values()) > {"planted": 15, "null_keys": 11, "no_orders": 9}[case]

"""Dimensions, facts and marts of the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.catalog import register
from brindle.sources import roles
from brindle.sources.roles import oracle, table


@register("m_dim_date", oracle("SELECT d, strftime(d, '%Y%m%d')::INT AS date_key, year(d)::INT AS year_no, quarter(d)::INT AS quarter_no, month(d)::INT AS month_no, week(d)::INT AS week_no, dayofweek(d)::INT AS weekday_no FROM (SELECT o_orderdate::DATE AS d FROM orders UNION SELECT l_shipdate::DATE FROM lineitem)"))
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).union(table(spark, d, "lineitem").select(F.to_date("l_shipdate"))).distinct()
    c = F.col("d")
    return days.select(c, F.date_format(c, "yyyyMMdd").cast("int").alias("date_key"), F.year(c).alias("year_no"), F.quarter(c).alias("quarter_no"), F.month(c).alias("month_no"), F.weekofyear(c).alias("week_no"), (F.dayofweek(c) - 1).alias("weekday_no"))


@register("m_dim_product", "SELECT p_partkey AS product_key, p_name AS product_name, p_brand AS brand, p_type AS category, p_size AS size FROM part")
def dim_product(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))


@register("m_dim_store", "SELECT c_custkey AS store_key, c_name AS store_name, c_mktsegment AS channel, n_name AS cell_name, r_name AS region_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_store(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("store_key"), F.col("c_name").alias("store_name"), F.col("c_mktsegment").alias("channel"), F.col("n_name").alias("cell_name"), F.col("r_name").alias("region_name"))


@register("m_dim_warehouse", "SELECT s_suppkey % 4 AS warehouse_key, count(*) AS n_suppliers, count(DISTINCT s_nationkey) AS n_cells FROM supplier GROUP BY 1")
def dim_warehouse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 4).alias("warehouse_key")).agg(F.count(F.lit(1)).alias("n_suppliers"), F.count_distinct("s_nationkey").alias("n_cells"))


@register("m_dim_promotion", oracle("SELECT promotion_id AS promotion_key, * FROM promotions", "promotions"))
def dim_promotion(spark: SparkSession, d: str) -> DataFrame:
    return roles.promotions(spark, d).select(F.col("promotion_id").alias("promotion_key"), "*")


@register("m_fact_orders", "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS order_date, o_orderstatus, o_totalprice::DECIMAL(18,2)::DOUBLE AS total FROM orders")
def fact_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("total"))


@register("m_fact_sales", oracle("SELECT order_id, line_number, sku_id, sale_date, store_id, units, gross::DOUBLE AS gross, discount::DOUBLE AS discount, net::DOUBLE AS net, is_promo FROM sales", "sales"))
def fact_sales(spark: SparkSession, d: str) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("gross", "discount", "net")]
    return roles.sales(spark, d).select("order_id", "line_number", "sku_id", "sale_date", "store_id", "units", *money, "is_promo")


@register("m_fact_daily_demand", oracle("SELECT d, cell_id, region_id, category, units, units = 0 AS no_sale FROM grid", "grid"))
def fact_daily_demand(spark: SparkSession, d: str) -> DataFrame:
    return roles.grid(spark, d).select("d", "cell_id", "region_id", "category", "units", (F.col("units") == 0).alias("no_sale"))


@register("m_fact_inventory", oracle("SELECT d, warehouse_id, category, change, available FROM inventory", "inventory"))
def fact_inventory(spark: SparkSession, d: str) -> DataFrame:
    return roles.inventory(spark, d)


@register("m_fact_deliveries", "SELECT l_shipdate::DATE AS delivery_date, l_suppkey % 4 AS warehouse_id, l_partkey AS sku_id, sum(l_quantity::BIGINT)::BIGINT AS delivered FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL")
def fact_deliveries(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'F'")
    return lines.groupBy(F.to_date("l_shipdate").alias("delivery_date"), (F.col("l_suppkey") % 4).alias("warehouse_id"), F.col("l_partkey").alias("sku_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("delivered"))


def _sales_measures() -> list:
    u, n = F.col("units"), F.col("net")
    return [F.sum(u).alias("units"), F.sum(n).cast("double").alias("net_revenue"), (F.expr("cast(sum(net) * 10000 as bigint) div sum(units)") / 10000).alias("average_price"), F.sum(F.when(F.col("is_promo"), u).otherwise(0)).alias("promo_units")]


_SALES_SQL = "sum(units)::BIGINT AS units, sum(net)::DOUBLE AS net_revenue, ((sum(net) * 10000)::BIGINT // sum(units)::BIGINT) / 10000::DOUBLE AS average_price, sum(CASE WHEN is_promo THEN units ELSE 0 END)::BIGINT AS promo_units"


@register("m_mart_sales_daily", oracle(f"SELECT sale_date, store_id, sku_id, brand, category, region_id, channel, {_SALES_SQL} FROM sales GROUP BY ALL", "sales"))
def mart_sales_daily(spark: SparkSession, d: str) -> DataFrame:
    return roles.sales(spark, d).groupBy("sale_date", "store_id", "sku_id", "brand", "category", "region_id", "channel").agg(*_sales_measures())


@register("m_mart_sales_weekly", oracle(f"SELECT date_trunc('week', sale_date)::DATE AS week_start, region_id, category, {_SALES_SQL} FROM sales GROUP BY ALL", "sales"))
def mart_sales_weekly(spark: SparkSession, d: str) -> DataFrame:
    return roles.sales(spark, d).groupBy(F.trunc("sale_date", "week").alias("week_start"), "region_id", "category").agg(*_sales_measures())


@register("m_mart_store_performance", oracle(f"SELECT store_id, channel, region_name, count(DISTINCT sku_id) AS n_skus, count(DISTINCT sale_date) AS n_days, {_SALES_SQL} FROM sales GROUP BY ALL", "sales"))
def mart_store_performance(spark: SparkSession, d: str) -> DataFrame:
    return roles.sales(spark, d).groupBy("store_id", "channel", "region_name").agg(F.count_distinct("sku_id").alias("n_skus"), F.count_distinct("sale_date").alias("n_days"), *_sales_measures())


@register("m_mart_product_performance", oracle(f"SELECT sku_id, brand, category, count(DISTINCT store_id) AS n_stores, count(DISTINCT sale_date) AS n_days, {_SALES_SQL} FROM sales GROUP BY ALL", "sales"))
def mart_product_performance(spark: SparkSession, d: str) -> DataFrame:
    """Stores are the only distinct count, so no line is shuffled once more for each of two; days are a set, at most the calendar's."""
    n_days = F.size(F.collect_set("sale_date")).cast("long").alias("n_days")
    return roles.sales(spark, d).groupBy("sku_id", "brand", "category").agg(F.count_distinct("store_id").alias("n_stores"), n_days, *_sales_measures())


@register("m_mart_order_metrics", oracle("SELECT order_id, order_date, store_id, count(*) AS n_lines, count(DISTINCT sku_id) AS n_skus, sum(units)::BIGINT AS units, sum(net)::DOUBLE AS net_revenue FROM sales GROUP BY ALL", "sales"))
def mart_order_metrics(spark: SparkSession, d: str) -> DataFrame:
    return roles.sales(spark, d).groupBy("order_id", "order_date", "store_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("sku_id").alias("n_skus"), F.sum("units").alias("units"), F.sum("net").cast("double").alias("net_revenue"))


@register("m_mart_inventory_status", oracle(f"SELECT d, warehouse_id, category, available, CASE WHEN available <= 0 THEN 'OUT' WHEN available <= {roles.SAFETY_STOCK} THEN 'CRITICAL' WHEN available <= {roles.REORDER_POINT} THEN 'REORDER' ELSE 'OK' END AS stock_status FROM inventory", "inventory"))
def mart_inventory_status(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("available")
    status = F.when(a <= 0, "OUT").when(a <= roles.SAFETY_STOCK, "CRITICAL").when(a <= roles.REORDER_POINT, "REORDER").otherwise("OK")
    return roles.inventory(spark, d).select("d", "warehouse_id", "category", "available", status.alias("stock_status"))

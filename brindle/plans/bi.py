"""Filtered business queries: metadata, summary, series, breakdown, and dashboard panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.plans.catalog import register
from brindle.sources import roles
from brindle.sources.roles import oracle, table

DIMENSIONS = {"brand": "brand", "category": "category", "region": "region_name", "channel": "channel", "store": "store_id"}


@dataclass(frozen=True)
class Filters:
    """Conjunctive filters; dates are inclusive, lists are alternatives of at most ``MOST`` values."""

    date_from: date | None = None
    date_to: date | None = None
    regions: Sequence[str] = ()
    channels: Sequence[str] = ()
    stores: Sequence[int] = ()
    categories: Sequence[str] = ()
    brands: Sequence[str] = ()
    skus: Sequence[int] = ()
    promotion: bool | None = None

    MOST = 200

    def condition(self) -> Column:
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from lies behind date_to")
        out = F.lit(True)
        if self.date_from:
            out = out & (F.col("sale_date") >= F.lit(self.date_from))
        if self.date_to:
            out = out & (F.col("sale_date") <= F.lit(self.date_to))
        for column, values in (("region_name", self.regions), ("channel", self.channels), ("store_id", self.stores), ("category", self.categories), ("brand", self.brands), ("sku_id", self.skus)):
            if len(values) > self.MOST:
                raise ValueError(f"over {self.MOST} values for {column}")
            if values:
                out = out & F.col(column).isin(*values)
        return out if self.promotion is None else out & (F.col("is_promo") == self.promotion)


def _measures() -> list[Column]:
    return [F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("net").cast("double"), F.lit(0.0)).alias("revenue")]


def summary(sales: DataFrame, filters: Filters) -> DataFrame:
    price = F.expr("cast(sum(net) * 10000 as bigint) div nullif(sum(units), 0)") / 10000
    return sales.filter(filters.condition()).agg(F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"), *_measures(), price.alias("average_price"), F.count_distinct("store_id").alias("n_stores"), F.count_distinct("sku_id").alias("n_skus"))


def timeseries(sales: DataFrame, filters: Filters, limit: int = 366) -> DataFrame:
    """The latest ``limit`` days, oldest first."""
    daily = sales.filter(filters.condition()).groupBy("sale_date").agg(*_measures())
    return daily.orderBy(F.desc("sale_date")).limit(limit).orderBy("sale_date")


def breakdown(sales: DataFrame, dimension: str, filters: Filters, limit: int = 100) -> DataFrame:
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension}")
    return sales.filter(filters.condition()).groupBy(F.col(DIMENSIONS[dimension]).alias("value")).agg(*_measures()).orderBy(F.desc("revenue"), "value").limit(limit)


def filter_metadata(sales: DataFrame, most: int = 500) -> DataFrame:
    """Every dimension's distinct values, at most ``most`` of each in order, and the span of days as one row more."""
    long = sales.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("value")) for n, c in DIMENSIONS.items() if n != "store"])).alias("x")).select("x.*").distinct()
    ranked = long.withColumn("_n", F.row_number().over(Window.partitionBy("dimension").orderBy("value"))).filter(F.col("_n") <= most).drop("_n")
    days = sales.agg(F.lit("days").alias("dimension"), F.concat_ws("..", F.min("sale_date").cast("string"), F.max("sale_date").cast("string")).alias("value"))
    return ranked.unionByName(days)


_F = Filters(date(1996, 1, 1), date(1999, 12, 31), regions=("ASIA", "EUROPE"), channels=("BUILDING", "MACHINERY", "FURNITURE"), promotion=True)
_WHERE = "sale_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND region_name IN ('ASIA', 'EUROPE') AND channel IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND is_promo"
_M = "coalesce(sum(units), 0)::BIGINT AS units, coalesce(sum(net), 0)::DOUBLE AS revenue"


@register("bi01_filter_metadata", oracle("SELECT DISTINCT 'brand' AS dimension, brand AS value FROM sales UNION ALL SELECT DISTINCT 'category', category FROM sales UNION ALL SELECT DISTINCT 'region', region_name FROM sales UNION ALL SELECT DISTINCT 'channel', channel FROM sales UNION ALL SELECT 'days', min(sale_date)::VARCHAR || '..' || max(sale_date)::VARCHAR FROM sales", "sales"))
def bi01(spark: SparkSession, d: str) -> DataFrame:
    return filter_metadata(roles.sales(spark, d))


@register("bi02_summary", oracle(f"SELECT min(sale_date) AS first_day, max(sale_date) AS last_day, {_M}, ((sum(net) * 10000)::BIGINT // nullif(sum(units)::BIGINT, 0)) / 10000::DOUBLE AS average_price, count(DISTINCT store_id) AS n_stores, count(DISTINCT sku_id) AS n_skus FROM sales WHERE {_WHERE}", "sales"))
def bi02(spark: SparkSession, d: str) -> DataFrame:
    return summary(roles.sales(spark, d), _F)


@register("bi03_timeseries", oracle(f"SELECT * FROM (SELECT sale_date, {_M} FROM sales WHERE {_WHERE} GROUP BY 1 ORDER BY 1 DESC LIMIT 90) ORDER BY 1", "sales"))
def bi03(spark: SparkSession, d: str) -> DataFrame:
    return timeseries(roles.sales(spark, d), _F, 90)


def _breakdown(name: str, column: str) -> None:
    @register(f"bi04_breakdown_{name}", oracle(f"SELECT {column} AS value, {_M} FROM sales WHERE {_WHERE} GROUP BY 1 ORDER BY revenue DESC, value LIMIT 20", "sales"))
    def query(spark: SparkSession, d: str) -> DataFrame:
        return breakdown(roles.sales(spark, d), name, _F, 20)


for _name, _column in DIMENSIONS.items():
    _breakdown(_name, _column)


@register("bi05_stock_by_warehouse", oracle("SELECT warehouse_id, sum(available)::BIGINT AS stock, count(*) FILTER (WHERE available <= 0) AS n_out FROM inventory WHERE d = (SELECT max(d) FROM inventory) GROUP BY 1", "inventory"))
def bi05(spark: SparkSession, d: str) -> DataFrame:
    return roles.inventory(spark, d).join(F.broadcast(roles.ends(spark, d).select(F.col("high").alias("d"))), "d").groupBy("warehouse_id").agg(F.sum("available").alias("stock"), F.count_if(F.col("available") <= 0).alias("n_out"))


@register("bi06_revenue_share", oracle("SELECT category, sum(net)::DOUBLE AS revenue, round(sum(net)::DOUBLE / sum(sum(net)) OVER ()::DOUBLE, 9) AS share FROM sales GROUP BY 1", "sales"))
def bi06(spark: SparkSession, d: str) -> DataFrame:
    by = roles.sales(spark, d).groupBy("category").agg(F.sum("net").alias("net"))
    return by.select("category", F.col("net").cast("double").alias("revenue"), F.round(F.col("net").cast("double") / F.sum("net").over(Window.partitionBy()).cast("double"), 9).alias("share"))


@register("bi06_top_products", oracle("SELECT sku_id, brand, sum(net)::DOUBLE AS revenue FROM sales GROUP BY ALL ORDER BY revenue DESC, sku_id LIMIT 10", "sales"))
def bi06_top(spark: SparkSession, d: str) -> DataFrame:
    return roles.sales(spark, d).groupBy("sku_id", "brand").agg(F.sum("net").cast("double").alias("revenue")).orderBy(F.desc("revenue"), "sku_id").limit(10)


@register("bi06_low_stock_rows", oracle("SELECT category, count(*) FILTER (WHERE available < 5) AS n_rows_below_five, count(*) AS n FROM inventory GROUP BY 1", "inventory"))
def bi06_low(spark: SparkSession, d: str) -> DataFrame:
    """Rows, not episodes, below five units."""
    return roles.inventory(spark, d).groupBy("category").agg(F.count_if(F.col("available") < 5).alias("n_rows_below_five"), F.count(F.lit(1)).alias("n"))


@register("bi07_prediction_by_day", oracle("SELECT d, sum(units)::BIGINT AS actual, sum(p)::BIGINT AS predicted FROM (SELECT d, units, coalesce(lag(units, 7) OVER (PARTITION BY cell_id, category ORDER BY d), 0) AS p FROM grid) GROUP BY 1", "grid"))
def bi07(spark: SparkSession, d: str) -> DataFrame:
    p = F.coalesce(F.lag("units", 7).over(Window.partitionBy("cell_id", "category").orderBy("d")), F.lit(0))
    return roles.grid(spark, d).withColumn("p", p).groupBy("d").agg(F.sum("units").alias("actual"), F.sum("p").alias("predicted"))


@register("bi07_error_histogram", oracle("SELECT least(abs(p - units) // 10, 9)::INT AS bucket, count(*) AS n FROM (SELECT units, coalesce(lag(units, 7) OVER (PARTITION BY cell_id, category ORDER BY d), 0) AS p FROM grid) GROUP BY 1", "grid"))
def bi07_hist(spark: SparkSession, d: str) -> DataFrame:
    p = F.coalesce(F.lag("units", 7).over(Window.partitionBy("cell_id", "category").orderBy("d")), F.lit(0))
    bucket = F.least(F.floor(F.abs(p - F.col("units")) / 10), F.lit(9)).cast("int")
    return roles.grid(spark, d).select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@register("bi08_table_registry", "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer")
def bi08(spark: SparkSession, d: str) -> DataFrame:
    out = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for t in ("orders", "part", "customer")]
    return out[0].unionByName(out[1]).unionByName(out[2])

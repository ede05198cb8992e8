"""Smoke queries and dashboard panels over the roles, in one table of (name, roles, DataFrame form, SQL form)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.plans.catalog import register, registered
from brindle.plans.analytics import _RULES_SQL, _Z_SQL, _km_sql, _table_sql, an01, bk02, so10, sv01
from brindle.plans.datasets import FORECASTING_SQL, ds01
from brindle.sources import roles
from brindle.sources.roles import oracle

_ROLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sales": roles.sales, "grid": roles.grid, "inventory": roles.inventory, "prices": roles.prices}


def panel(name: str, role: str, build: Callable[[DataFrame], DataFrame], sql: str, **how: bool) -> None:
    @register(name, oracle(sql, role))
    def query(spark: SparkSession, d: str) -> DataFrame:
        return build(_ROLES[role](spark, d, **how))


def over(name: str, base: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A panel over another query's rows, which ``sql`` calls ``result``."""
    rows_of, its_sql = registered(base)

    @register(name, f"WITH result AS ({its_sql}) {sql}")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return build(rows_of(spark, d))


def total(column: str, name: str) -> Column:
    return F.sum(column).alias(name)


def money(column: str, name: str) -> Column:
    return F.sum(column).cast("double").alias(name)


def rows() -> Column:
    return F.count(F.lit(1))


def last_day(stock: DataFrame) -> DataFrame:
    """The stock of the last day, a one-row aggregate."""
    return stock.join(F.broadcast(stock.agg(F.max("d").alias("d"))), "d")


# ---- the ten smoke queries
panel("bi05_daily_sales_by_sku", "sales", lambda s: s.groupBy("sale_date", "sku_id").agg(total("units", "units"), money("net", "revenue")), "SELECT sale_date, sku_id, sum(units)::BIGINT AS units, sum(net)::DOUBLE AS revenue FROM sales GROUP BY ALL")
panel("bi05_sales_by_brand_category", "sales", lambda s: s.groupBy("brand", "category").agg(total("units", "units"), money("net", "revenue")), "SELECT brand, category, sum(units)::BIGINT AS units, sum(net)::DOUBLE AS revenue FROM sales GROUP BY ALL")
panel("bi05_sales_by_region_store", "sales", lambda s: s.groupBy("region_name", "store_id").agg(money("net", "revenue")).orderBy(F.desc("revenue"), "store_id").limit(200), "SELECT region_name, store_id, sum(net)::DOUBLE AS revenue FROM sales GROUP BY ALL ORDER BY revenue DESC, store_id LIMIT 200")
panel("bi05_top_skus", "sales", lambda s: s.groupBy("sku_id").agg(total("units", "units")).orderBy(F.desc("units"), "sku_id").limit(10), "SELECT sku_id, sum(units)::BIGINT AS units FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
panel("bi05_promotion_comparison", "sales", lambda s: s.groupBy(F.col("is_promo").alias("promoted")).agg(rows().alias("n_lines"), F.round(F.avg("units"), 6).alias("mean_units")), "SELECT is_promo AS promoted, count(*) AS n_lines, round(avg(units), 6) AS mean_units FROM sales GROUP BY 1")
panel("bi05_price_history", "prices", lambda p: p.filter("cell_id = 3 and category = 'PROMO'").select("valid_from", "valid_to", "price").orderBy("valid_from"), "SELECT valid_from, valid_to, price FROM prices WHERE cell_id = 3 AND category = 'PROMO' ORDER BY 1")
panel("bi05_inventory_history", "inventory", lambda i: i.filter("warehouse_id = 1 and category = 'PROMO'").select("d", "available", "change").orderBy("d"), "SELECT d, available, change FROM inventory WHERE warehouse_id = 1 AND category = 'PROMO' ORDER BY 1")
panel("bi05_basket_contents", "sales", lambda s: s.filter("order_id <= 20").groupBy("order_id", "sku_id", "brand").agg(total("units", "quantity")), "SELECT order_id, sku_id, brand, sum(units)::BIGINT AS quantity FROM sales WHERE order_id <= 20 GROUP BY ALL")
panel("bi05_average_basket", "sales", lambda s: s.groupBy("order_id").agg(F.count_distinct("sku_id").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_skus")), "SELECT round(avg(n), 6) AS mean_skus FROM (SELECT count(DISTINCT sku_id) AS n FROM sales GROUP BY order_id)", by_order=True)
panel("bi05_low_stock", "inventory", lambda i: last_day(i).filter(f"available <= {roles.REORDER_POINT}").select("warehouse_id", "category", "available").orderBy("available", "warehouse_id", "category"), f"SELECT warehouse_id, category, available FROM inventory WHERE d = (SELECT max(d) FROM inventory) AND available <= {roles.REORDER_POINT}")

# ---- business panels
panel("bi06_kpi_totals", "sales", lambda s: s.agg(money("gross", "gross_revenue"), total("units", "units"), rows().alias("n_sales"), F.count_distinct("store_id").alias("n_stores")), "SELECT sum(gross)::DOUBLE AS gross_revenue, sum(units)::BIGINT AS units, count(*) AS n_sales, count(DISTINCT store_id) AS n_stores FROM sales")
panel("bi06_daily_revenue", "sales", lambda s: s.filter("sale_date >= '2000-01-01'").groupBy("sale_date").agg(money("gross", "revenue"), total("units", "units")), "SELECT sale_date, sum(gross)::DOUBLE AS revenue, sum(units)::BIGINT AS units FROM sales WHERE sale_date >= DATE '2000-01-01' GROUP BY 1")
panel("bi06_revenue_by_region", "sales", lambda s: s.groupBy("region_name").agg(money("gross", "revenue")), "SELECT region_name, sum(gross)::DOUBLE AS revenue FROM sales GROUP BY 1")
panel("bi06_store_table", "sales", lambda s: s.groupBy("store_id", "region_name", "channel").agg(total("units", "units"), money("gross", "revenue"), F.count_distinct("sale_date").alias("n_days")), "SELECT store_id, region_name, channel, sum(units)::BIGINT AS units, sum(gross)::DOUBLE AS revenue, count(DISTINCT sale_date) AS n_days FROM sales GROUP BY ALL")
panel("bi06_sku_labels", "sales", lambda s: s.groupBy(F.concat(F.col("brand"), F.lit(" [SKU "), F.col("sku_id").cast("string"), F.lit("]")).alias("sku_label")).agg(money("gross", "revenue")).orderBy(F.desc("revenue"), "sku_label").limit(10), "SELECT brand || ' [SKU ' || sku_id || ']' AS sku_label, sum(gross)::DOUBLE AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
panel("bi06_latest_sales", "sales", lambda s: s.select(F.date_format("sale_date", "yyyy-MM-dd").alias("day"), "order_id", "line_number", "sku_id", "store_id", "units", F.col("gross").cast("double").alias("gross")).orderBy(F.desc("day"), "order_id", "line_number", "sku_id", "gross").limit(50), "SELECT strftime(sale_date, '%Y-%m-%d') AS day, order_id, line_number, sku_id, store_id, units, gross::DOUBLE AS gross FROM sales ORDER BY day DESC, order_id, line_number, sku_id, gross LIMIT 50")
panel("bi06_stock_by_category", "inventory", lambda i: last_day(i).groupBy("category").agg(total("available", "units")), f"SELECT category, sum(available)::BIGINT AS units FROM inventory WHERE d = (SELECT max(d) FROM inventory) GROUP BY 1")
panel("bi06_stock_counts", "inventory", lambda i: i.agg(F.count_distinct("warehouse_id").alias("n_warehouses"), F.count_distinct("category").alias("n_skus"), F.count_if(F.col("available") < 5).alias("n_low_rows")), "SELECT count(DISTINCT warehouse_id) AS n_warehouses, count(DISTINCT category) AS n_skus, count(*) FILTER (WHERE available < 5) AS n_low_rows FROM inventory")
panel("bi06_stock_series", "inventory", lambda i: i.groupBy("d").agg(total("available", "units"), F.count_if(F.col("available") <= 0).alias("n_out")), "SELECT d, sum(available)::BIGINT AS units, count(*) FILTER (WHERE available <= 0) AS n_out FROM inventory GROUP BY 1")

panel("bi06_revenue_by_category", "sales", lambda s: s.groupBy("category").agg(money("gross", "revenue"), total("units", "units")), "SELECT category, sum(gross)::DOUBLE AS revenue, sum(units)::BIGINT AS units FROM sales GROUP BY 1")
panel("bi06_latest_stock", "inventory", lambda i: last_day(i).agg(F.max("d").alias("d"), total("available", "units"), F.count_distinct("warehouse_id").alias("n_warehouses")), "SELECT max(d) AS d, sum(available)::BIGINT AS units, count(DISTINCT warehouse_id) AS n_warehouses FROM inventory WHERE d = (SELECT max(d) FROM inventory)")
panel("bi06_low_rows_by_warehouse", "inventory", lambda i: i.filter("available < 5").groupBy(F.concat(F.lit("Warehouse "), F.col("warehouse_id").cast("string")).alias("warehouse")).agg(rows().alias("n_low_rows")), "SELECT 'Warehouse ' || warehouse_id AS warehouse, count(*) AS n_low_rows FROM inventory WHERE available < 5 GROUP BY 1")

# ---- scientific panels
_ERR = "e AS (SELECT *, coalesce(lag(units, 7) OVER (PARTITION BY cell_id, category ORDER BY d), 0) AS p FROM grid)"


def _with_prediction(g: DataFrame) -> DataFrame:
    return g.withColumn("p", F.coalesce(F.lag("units", 7).over(Window.partitionBy("cell_id", "category").orderBy("d")), F.lit(0)))


panel("bi07_error_by_weekday", "grid", lambda g: _with_prediction(g).groupBy(F.date_format("d", "EEEE").alias("weekday")).agg(F.round(F.avg(F.abs(F.col("p") - F.col("units"))), 6).alias("mae"), rows().alias("n")), f"WITH {_ERR} SELECT dayname(d) AS weekday, round(avg(abs(p - units)), 6) AS mae, count(*) AS n FROM e GROUP BY 1")
panel("bi07_error_by_cell", "grid", lambda g: _with_prediction(g).groupBy("cell_id").agg(F.round(F.sum(F.abs(F.col("p") - F.col("units"))) / F.nullif(F.sum("units"), F.lit(0)), 6).alias("wape")), f"WITH {_ERR} SELECT cell_id, round(sum(abs(p - units)) / nullif(sum(units), 0)::DOUBLE, 6) AS wape FROM e GROUP BY 1")
panel("bi07_worst_errors", "grid", lambda g: _with_prediction(g).select("d", "cell_id", "category", "units", "p", F.abs(F.col("p") - F.col("units")).alias("error")).orderBy(F.desc("error"), "d", "cell_id", "category").limit(25), f"WITH {_ERR} SELECT d, cell_id, category, units, p, abs(p - units) AS error FROM e ORDER BY error DESC, d, cell_id, category LIMIT 25")
panel("bi07_scatter_counts", "grid", lambda g: _with_prediction(g).groupBy((F.floor(F.col("units") / 10) * 10).alias("actual_from"), (F.floor(F.col("p") / 10) * 10).alias("predicted_from")).agg(rows().alias("n")), f"WITH {_ERR} SELECT units // 10 * 10 AS actual_from, p // 10 * 10 AS predicted_from, count(*) AS n FROM e GROUP BY ALL")
panel("bi07_demand_heat", "grid", lambda g: g.groupBy(F.month("d").alias("m"), F.date_format("d", "EEEE").alias("weekday")).agg(total("units", "units")), "SELECT month(d)::INT AS m, dayname(d) AS weekday, sum(units)::BIGINT AS units FROM grid GROUP BY ALL")
panel("bi07_zero_share", "grid", lambda g: g.groupBy("category").agg(F.round(F.avg((F.col("units") == 0).cast("int")), 6).alias("zero_share"), F.max("units").alias("peak")), "SELECT category, round(avg((units = 0)::INT), 6) AS zero_share, max(units) AS peak FROM grid GROUP BY 1")


@register("bi07_anomaly_directions", oracle(f"WITH {_Z_SQL} SELECT direction, category, count(*) AS n FROM z GROUP BY ALL", "grid"))
def anomaly_directions(spark: SparkSession, d: str) -> DataFrame:
    return an01(spark, d).groupBy("direction", "category").agg(rows().alias("n"))


@register("bi07_rule_table", oracle(f"WITH {_RULES_SQL} SELECT antecedent, consequent, n_both, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift, rule_id, round(round(support, 9) * round(confidence, 9) * round(lift, 9), 12) AS ranking_score FROM rules ORDER BY ranking_score DESC, rule_id LIMIT 15", "sales"))
def rule_table(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen rules with the highest product of support, confidence and lift."""
    score = F.round(F.col("support") * F.col("confidence") * F.col("lift"), 12)
    return bk02(spark, d).withColumn("ranking_score", score).orderBy(F.desc("ranking_score"), "rule_id").limit(15)


@register("bi07_best_f1", oracle(f"WITH {_table_sql()}, k AS (SELECT p, round(2 * tp / (tp + fp + all_pos)::DOUBLE, 6) AS f1 FROM t) SELECT f1 AS best_f1, min(p) AS threshold FROM k WHERE f1 = (SELECT max(f1) FROM k) GROUP BY f1", "inventory"))
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return so10(spark, d).groupBy(F.col("f1").alias("best_f1")).agg(F.min("threshold").alias("threshold")).orderBy(F.desc("best_f1")).limit(1)


@register("bi07_median_survival", oracle(f"SELECT min(CASE WHEN survival <= 0.5 THEN t END) AS median_days, min(survival) AS last_survival FROM ({_km_sql()})", "inventory"))
def median_survival(spark: SparkSession, d: str) -> DataFrame:
    return sv01(spark, d).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_days"), F.min("survival").alias("last_survival"))


@register("bi07_target_coverage", oracle(f"SELECT category, round(avg(target_complete::INT), 6) AS coverage, count(scheduled_price) AS n_priced FROM ({FORECASTING_SQL}) GROUP BY 1", "grid", "prices", "promotions"))
def target_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ds01(spark, d).groupBy("category").agg(F.round(F.avg(F.col("target_complete").cast("int")), 6).alias("coverage"), F.count("scheduled_price").alias("n_priced"))


def bands(value: str, edges: tuple[float, ...], name: str) -> tuple[Callable[[], Column], str]:
    """The number of edges at or below the value, null for a null value: what builds the column when a query runs, and the SQL."""
    text = " + ".join(f"({value} >= {e})::INT" for e in edges)
    return lambda: sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0)).alias(name), f"({text})::INT AS {name}"


def share(n: Column, of: str, name: str) -> Column:
    return F.round(F.count_if(n) / F.count(of), 6).alias(name)


# ---- panels over the results of the analytical cores
over("bi07_anomaly_kpis", "an01_z_scores", lambda z: z.agg(rows().alias("n_events"), F.count_if("scorable").alias("n_scorable"), F.count_if(F.col("direction") == "HIGH").alias("n_high"), F.count_if(F.col("direction") == "LOW").alias("n_low")), "SELECT count(*) AS n_events, count(*) FILTER (WHERE scorable) AS n_scorable, count(*) FILTER (WHERE direction = 'HIGH') AS n_high, count(*) FILTER (WHERE direction = 'LOW') AS n_low FROM result")
over("bi07_method_shares", "an03_agreement", lambda a: a.crossJoin(F.broadcast(a.agg(F.sum("n").alias("_t")))).select("agreement", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share")), "SELECT agreement, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM result")
over("bi07_rule_kpis", "bk02_pair_rules", lambda r: r.agg(rows().alias("n_rules"), F.max("lift").alias("max_lift"), F.round(F.avg("confidence") * 100, 4).alias("mean_confidence_pct")), "SELECT count(*) AS n_rules, max(lift) AS max_lift, round(avg(confidence) * 100, 4) AS mean_confidence_pct FROM result")
_band, _band_sql = bands("confidence", (0.25, 0.35, 0.45), "band")
over("bi07_confidence_bands", "bk02_pair_rules", lambda r, b=_band: r.groupBy(b()).agg(rows().alias("n_rules"), F.max("lift").alias("max_lift")), f"SELECT {_band_sql}, count(*) AS n_rules, max(lift) AS max_lift FROM result GROUP BY 1")
over("bi07_recommended_products", "bk02_pair_rules", lambda r: r.groupBy(F.col("consequent").alias("product")).agg(rows().alias("n_rules")).orderBy(F.desc("n_rules"), "product").limit(10), "SELECT consequent AS product, count(*) AS n_rules FROM result GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
over("bi07_rule_pairs", "bk02_pair_rules", lambda r: r.select(F.concat_ws(" -> ", "antecedent", "consequent").alias("rule_pair"), F.round("lift", 3).alias("lift")).orderBy(F.desc("lift"), "rule_pair").limit(10), "SELECT antecedent || ' -> ' || consequent AS rule_pair, round(lift, 3) AS lift FROM result ORDER BY 2 DESC, 1 LIMIT 10")
over("bi07_error_by_category", "fc01_baselines", lambda f: f.groupBy("category").agg(F.round(F.avg(F.abs(F.col("trailing_week") - F.col("y"))), 6).alias("mae"), rows().alias("n_rows")), "SELECT category, round(avg(abs(trailing_week - y)), 6) AS mae, count(*) AS n_rows FROM result GROUP BY 1")
over("bi07_demand_and_forecast", "fc01_baselines", lambda f: f.groupBy("d").agg(total("y", "observed"), total("trailing_week", "predicted")), "SELECT d, sum(y)::BIGINT AS observed, sum(trailing_week)::BIGINT AS predicted FROM result GROUP BY 1")
over("bi07_promotion_kpis", "pr02_period_rates", lambda p: p.agg(F.count_distinct("promotion_id").alias("n_promotions"), F.count_distinct(F.struct("promotion_id", "cell_id", "category")).alias("n_exposures"), total("units", "units")), "SELECT count(DISTINCT promotion_id) AS n_promotions, count(DISTINCT (promotion_id, cell_id, category)) AS n_exposures, sum(units)::BIGINT AS units FROM result")
over("bi07_campaign_rates", "pr02_period_rates", lambda p: p.groupBy(F.concat(F.lit("Campaign "), F.col("promotion_id").cast("string")).alias("campaign"), "period").agg(F.round(F.sum("units") / F.sum("n_days"), 6).alias("units_per_day")), "SELECT 'Campaign ' || promotion_id AS campaign, period, round(sum(units) / sum(n_days)::DOUBLE, 6) AS units_per_day FROM result GROUP BY ALL")
over("bi07_promotion_lift_by_category", "pr03_comparisons", lambda p: p.groupBy("category", "comparison").agg(F.round(F.avg("relative_change") * 100, 4).alias("mean_change_pct"), F.count("relative_change").alias("n")), "SELECT category, comparison, round(avg(relative_change) * 100, 4) AS mean_change_pct, count(relative_change) AS n FROM result GROUP BY ALL")
over("bi07_lift_classes", "pr03_comparisons", lambda p: p.groupBy("comparison", F.when(F.col("relative_change") > 0, "up").when(F.col("relative_change") < 0, "down").when(F.col("relative_change") == 0, "flat").otherwise("unknown").alias("class")).agg(rows().alias("n")), "SELECT comparison, CASE WHEN relative_change > 0 THEN 'up' WHEN relative_change < 0 THEN 'down' WHEN relative_change = 0 THEN 'flat' ELSE 'unknown' END AS class, count(*) AS n FROM result GROUP BY ALL")
_band, _band_sql = bands("margin", (0.5, 1.0, 1.5), "band")
over("bi07_margin_bands", "sg05_nearest_centroid", lambda c, b=_band: c.groupBy("cluster", b()).agg(rows().alias("n_stores")), f"SELECT cluster, {_band_sql}, count(*) AS n_stores FROM result GROUP BY ALL")
over("bi07_segment_sizes", "sg05_nearest_centroid", lambda c: c.groupBy("cluster").agg(rows().alias("n_stores"), F.round(F.avg("distance"), 4).alias("mean_distance")), "SELECT cluster, count(*) AS n_stores, round(avg(distance), 4) AS mean_distance FROM result GROUP BY 1")
over("bi07_cohort_kpis", "ds10_survival_cohort", lambda c: c.groupBy("cohort_status").agg(rows().alias("n"), F.count_if("event_observed").alias("n_events"), total("duration_days", "days")), "SELECT cohort_status, count(*) AS n, count(*) FILTER (WHERE event_observed) AS n_events, sum(duration_days)::BIGINT AS days FROM result GROUP BY 1")
over("bi07_events_by_warehouse", "ds10_survival_cohort", lambda c: c.groupBy("warehouse_id").agg(rows().alias("n"), share(F.col("event_observed"), "event_observed", "event_share")), "SELECT warehouse_id, count(*) AS n, round(count(*) FILTER (WHERE event_observed) / count(event_observed)::DOUBLE, 6) AS event_share FROM result GROUP BY 1")
_band, _band_sql = bands("available", (1, 5, 20, 50, 200), "band")
over("bi07_risk_by_stock_band", "ds02_stockout", lambda s, b=_band: s.groupBy(b()).agg(rows().alias("n"), F.count_if("stockout_within_7d").alias("n_stockouts")), f"SELECT {_band_sql}, count(*) AS n, count(*) FILTER (WHERE stockout_within_7d) AS n_stockouts FROM result GROUP BY 1")
over("bi07_next_stockouts", "ds02_stockout", lambda s: s.filter("first_stockout_date is not null and available > 0").select("d", "warehouse_id", "category", "available", "first_stockout_date").orderBy(F.desc("d"), "available", "warehouse_id", "category").limit(25), "SELECT d, warehouse_id, category, available, first_stockout_date FROM result WHERE first_stockout_date IS NOT NULL AND available > 0 ORDER BY d DESC, available, warehouse_id, category LIMIT 25")
over("bi07_rule_decisions", "so03_rule_baselines", lambda s: s.groupBy("category").agg(total("at_reorder", "n_at_reorder"), total("at_safety", "n_at_safety"), total("low_cover", "n_low_cover"), rows().alias("n")), "SELECT category, sum(at_reorder)::BIGINT AS n_at_reorder, sum(at_safety)::BIGINT AS n_at_safety, sum(low_cover)::BIGINT AS n_low_cover, count(*) AS n FROM result GROUP BY 1")
over("bi07_survival_by_warehouse", "sv01_kaplan_meier_by_warehouse", lambda s: s.groupBy("warehouse_id").agg(F.min("survival").alias("last_survival"), total("events", "events")), "SELECT warehouse_id, min(survival) AS last_survival, sum(events)::BIGINT AS events FROM result GROUP BY 1")

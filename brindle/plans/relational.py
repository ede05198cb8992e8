"""Projections, joins, aggregations, windows, sorts and set operations of the inventory as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import joins as J
from brindle.operators import sequences as W
from brindle.operators import summaries as A
from brindle.plans.catalog import register
from brindle.plans.datasets import AS_OF, EPISODES_CTE, HELD, ds09
from brindle.sources import roles
from brindle.sources.roles import oracle, table

CELL = ["cell_id", "category"]


# ---- projections and filters


@register("pf01_select_rename", "SELECT o_orderkey AS order_id, o_custkey AS store_id, o_totalprice AS amount FROM orders")
def pf01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "store_id", "o_totalprice": "amount"})


@register("pf02_surrogate_star", "SELECT n_nationkey AS cell_key, * FROM nation")
def pf02(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_key"), "*")


@register("pf04_case_labels", oracle("SELECT order_id, line_number, sku_id, units, CASE WHEN units < 10 THEN 'LOW' WHEN units < 30 THEN 'MID' ELSE 'HIGH' END AS size_label, is_promo AS has_promotion, 'realized_sales_not_demand' AS unit_semantics FROM sales", "sales"))
def pf04(spark, d):
    """Branches, a derived flag and a literal tag (PF03, PF04, PF07)."""
    size = F.when(F.col("units") < 10, "LOW").when(F.col("units") < 30, "MID").otherwise("HIGH")
    return roles.sales(spark, d).select("order_id", "line_number", "sku_id", "units", size.alias("size_label"), F.col("is_promo").alias("has_promotion"), F.lit("realized_sales_not_demand").alias("unit_semantics"))


@register("pf05_buckets", "SELECT CASE WHEN o_totalprice < 50000 THEN '<50k' WHEN o_totalprice < 150000 THEN '50k-150k' ELSE '150k+' END AS bucket, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY 1 ORDER BY low")
def pf05(spark, d):
    bucket = F.when(F.col("o_totalprice") < 50000, "<50k").when(F.col("o_totalprice") < 150000, "50k-150k").otherwise("150k+")
    return table(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")).orderBy("low")


@register("pf06_null_unless_complete", oracle("SELECT cell_id, category, count(*) AS days, CASE WHEN count(*) FILTER (WHERE units > 0) >= 10 THEN sum(units) END::BIGINT AS units_if_active FROM grid GROUP BY ALL", "grid"))
def pf06(spark, d):
    return roles.grid(spark, d).groupBy(*CELL).agg(F.count(F.lit(1)).alias("days"), F.when(F.count_if(F.col("units") > 0) >= 10, F.sum("units")).alias("units_if_active"))


@register("pf09_split_between", oracle("SELECT CASE WHEN d BETWEEN DATE '1900-01-01' AND DATE '1999-06-30' THEN 'train' WHEN d BETWEEN DATE '1999-07-08' AND DATE '2000-06-30' THEN 'validation' WHEN d BETWEEN DATE '2000-07-08' AND DATE '9999-12-31' THEN 'test' ELSE 'embargo' END AS split, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM grid GROUP BY 1", "grid"))
def pf09(spark, d):
    c = F.col("d")
    split = F.when(c.between("1900-01-01", "1999-06-30"), "train").when(c.between("1999-07-08", "2000-06-30"), "validation").when(c.between("2000-07-08", "9999-12-31"), "test").otherwise("embargo")
    return roles.grid(spark, d).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@register("pf10_distinct_from", oracle("SELECT count(*) AS n_changed FROM (SELECT units, lag(units) OVER (PARTITION BY cell_id, category ORDER BY d) AS before FROM grid) WHERE units IS DISTINCT FROM before", "grid"))
def pf10(spark, d):
    before = F.lag("units").over(Window.partitionBy(*CELL).orderBy("d"))
    return roles.grid(spark, d).withColumn("before", before).filter(~F.col("units").eqNullSafe(F.col("before"))).agg(F.count(F.lit(1)).alias("n_changed"))


@register("pf11_in_dates", oracle("SELECT d, sum(units)::BIGINT AS units FROM grid WHERE d IN (DATE '1997-01-31', DATE '1997-02-28', DATE '1997-03-31') GROUP BY d", "grid"))
def pf11(spark, d):
    days = [F.to_date(F.lit(x)) for x in ("1997-01-31", "1997-02-28", "1997-03-31")]
    return roles.grid(spark, d).filter(F.col("d").isin(*days)).groupBy("d").agg(F.sum("units").alias("units"))


@register("pf12_scalar_subquery", oracle("SELECT warehouse_id, sum(available)::BIGINT AS stock FROM inventory WHERE d = (SELECT max(d) FROM inventory) GROUP BY 1", "inventory"))
def pf12(spark, d):
    stock = roles.inventory(spark, d)
    last = stock.agg(F.max("d").alias("d"))  # one row
    return stock.join(F.broadcast(last), "d").groupBy("warehouse_id").agg(F.sum("available").alias("stock"))


@register("pf13_like_prefix", "SELECT p_type, count(*) AS n FROM part WHERE p_name LIKE 'part 1%' OR p_brand LIKE 'Brand#1%' GROUP BY p_type")
def pf13(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").startswith("part 1") | F.col("p_brand").startswith("Brand#1")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@register("pf14_finite_clip", "SELECT event_id, least(greatest(value, 1), 20) AS shown FROM events WHERE value IS NOT NULL AND isfinite(value)")
def pf14(spark, d):
    v = F.col("value")
    return table(spark, d, "events").filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("event_id", F.least(F.greatest(v, F.lit(1)), F.lit(20)).alias("shown"))


@register("pf15_allow_list", oracle("SELECT d, cell_id, category, units FROM grid", "grid"))
def pf15(spark, d):
    """Forbidden columns go first, then only the allowed ones stay."""
    frame = roles.grid(spark, d).drop("revenue", "is_promo")
    return frame.select(*[c for c in ("d", "cell_id", "category", "units") if c in frame.columns])


# ---- joins


@register("j01_sales_enriched", oracle("SELECT order_id, line_number, store_id, region_name, channel, sku_id, brand, category, sale_date, units, net::DOUBLE AS net FROM sales", "sales"))
def j01(spark, d):
    return roles.sales(spark, d).select("order_id", "line_number", "store_id", "region_name", "channel", "sku_id", "brand", "category", "sale_date", "units", F.col("net").cast("double").alias("net"))


@register("j02_dimension_product", "SELECT n_name AS cell_name, r_name AS region_name, brand FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part)")
def j02(spark, d):
    """Every cell with every brand: the product of two dimensions is the result itself."""
    cells = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("cell_name"), F.col("r_name").alias("region_name"))
    return cells.crossJoin(table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct())


@register("j03_left_zero_fill", "SELECT c_custkey AS store_id, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS revenue, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j03(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("store_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"), F.count("o_orderkey").alias("n_orders"))
    joined = table(spark, d, "customer").select(F.col("c_custkey").alias("store_id")).join(orders, "store_id", "left")
    return joined.select("store_id", F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@register("j04_price_validity", oracle("SELECT s.order_id, s.line_number, s.sku_id, s.sale_date, p.price AS posted_price, p.valid_from FROM sales s LEFT JOIN prices p ON p.cell_id = s.cell_id AND p.category = s.category AND s.sale_date BETWEEN p.valid_from AND p.valid_to", "sales", "prices"))
def j04(spark, d):
    joined = J.validity_join(roles.sales(spark, d), roles.prices(spark, d), CELL, "sale_date")
    return joined.select("order_id", "line_number", "sku_id", "sale_date", F.col("price").alias("posted_price"), "valid_from")


@register("j05_trailing_30d", oracle("SELECT store_id, sale_date, (sum(units) OVER (PARTITION BY store_id ORDER BY sale_date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))::BIGINT AS units_30d FROM (SELECT store_id, sale_date, sum(units) AS units FROM sales GROUP BY ALL)", "sales"))
def j05(spark, d):
    daily = roles.sales(spark, d).groupBy("store_id", "sale_date").agg(F.sum("units").alias("units"))
    return daily.select("store_id", "sale_date", F.sum("units").over(J.days_window(["store_id"], "sale_date", -29, 0)).alias("units_30d"))


@register("j06_lag_by_date", oracle("WITH e AS (SELECT * FROM grid WHERE units > 0) SELECT e.d, e.cell_id, e.category, a.units AS lag_1, b.units AS lag_7 FROM e LEFT JOIN e a ON a.cell_id = e.cell_id AND a.category = e.category AND a.d = e.d - 1 LEFT JOIN e b ON b.cell_id = e.cell_id AND b.category = e.category AND b.d = e.d - 7", "grid"))
def j06(spark, d):
    return J.lag_days(roles.grid(spark, d).filter("units > 0"), CELL, "d", "units", (1, 7)).select("d", *CELL, "lag_1", "lag_7")


@register("j08_range_aggregates", oracle("SELECT d, cell_id, category, (SELECT count(*) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d >= g.d - 7 AND h.d < g.d) AS n, (SELECT sum(units) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d >= g.d - 7 AND h.d < g.d)::BIGINT AS total, (SELECT min(units) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d > g.d AND h.d <= g.d + 7) AS low_ahead FROM grid g", "grid"))
def j08(spark, d):
    back, ahead = J.days_window(CELL, "d", -7, -1), J.days_window(CELL, "d", 1, 7)
    return roles.grid(spark, d).select("d", *CELL, F.count(F.lit(1)).over(back).alias("n"), F.sum("units").over(back).alias("total"), F.min("units").over(ahead).alias("low_ahead"))


@register("j09_semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j09(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@register("j10_anti_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j10(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register("j11_orphans", "SELECT 'lines_without_order' AS check_name, count(*) AS violations FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL UNION ALL SELECT 'customers_without_nation', count(*) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IS NULL UNION ALL SELECT 'events_without_customer', count(*) FROM events LEFT JOIN customer ON user_id = c_custkey WHERE c_custkey IS NULL")
def j11(spark, d):
    t = lambda n: table(spark, d, n)
    found = [("lines_without_order", J.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey")), ("customers_without_nation", J.orphans(t("customer"), t("nation"), "c_nationkey", "n_nationkey")), ("events_without_customer", J.orphans(t("events"), t("customer"), "user_id", "c_custkey"))]
    counts = [rows.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations")) for name, rows in found]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("j12_interval_overlaps", oracle("WITH x AS (SELECT warehouse_id AS cell_id, episode_start AS s, coalesce(recovery_date, DATE '9999-12-31') AS e, category || ':' || strftime(episode_start, '%%Y%%m%%d') AS id FROM (WITH %s SELECT * FROM episodes)) SELECT a.cell_id, a.id AS low_id, b.id AS high_id FROM x a JOIN x b ON a.cell_id = b.cell_id AND a.id < b.id AND a.s <= b.e AND b.s <= a.e" % EPISODES_CTE, "inventory"))
def j12(spark, d):
    name = F.concat("category", F.lit(":"), F.date_format("episode_start", "yyyyMMdd"))
    e = ds09(spark, d).select(F.col("warehouse_id").alias("cell_id"), name.alias("id"), F.col("episode_start").alias("s"), F.coalesce("recovery_date", F.to_date(F.lit("9999-12-31"))).alias("e"))
    return J.overlaps(e, ["cell_id"], "id", "s", "e")


@register("j13_series_expand", oracle("SELECT promotion_id, unnest(generate_series(start_date - days::INT, end_date + days::INT, INTERVAL 1 DAY))::DATE AS calendar_date FROM promotions", "promotions"))
def j13(spark, d):
    return J.expand_days(roles.promotions(spark, d), F.expr("date_sub(start_date, days)"), F.expr("date_add(end_date, days)")).select("promotion_id", "calendar_date")


@register("j14_event_in_episode", oracle(f"WITH {EPISODES_CTE} SELECT x.warehouse_id, x.category, x.d, e.episode_start, 'W' || x.warehouse_id || '_S' || x.category || '_' || strftime(e.episode_start, '%Y%m%d') AS episode_id FROM inventory x {AS_OF.format('d')} WHERE x.available <= 0 AND {HELD.format('d')}", "inventory"))
def j14(spark, d):
    events = roles.inventory(spark, d).filter("available <= 0").select("warehouse_id", "category", "d")
    found = J.in_episode(events, ds09(spark, d), ["warehouse_id", "category"], "d")
    name = F.concat(F.lit("W"), F.col("warehouse_id").cast("string"), F.lit("_S"), F.col("category"), F.lit("_"), F.date_format("episode_start", "yyyyMMdd"))
    return found.select("warehouse_id", "category", "d", "episode_start", name.alias("episode_id"))


@register("j15_item_pairs", oracle("WITH b AS (SELECT DISTINCT order_id, brand FROM sales) SELECT x.brand AS a, y.brand AS b, count(*) AS n_orders, round(count(*) / (SELECT count(DISTINCT order_id) FROM b)::DOUBLE, 9) AS support FROM b x JOIN b y ON x.order_id = y.order_id AND x.brand < y.brand GROUP BY ALL", "sales"))
def j15(spark, d):
    rows = roles.sales(spark, d, by_order=True).select("order_id", "brand")
    n = rows.agg(F.count_distinct("order_id").alias("n"))
    pairs = J.item_pairs(rows, "order_id", "brand").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_orders"))
    return pairs.crossJoin(F.broadcast(n)).select("a", "b", "n_orders", F.round(F.col("n_orders") / F.col("n"), 9).alias("support"))


@register("j16_one_to_one", "SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)")
def j16(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return J.one_to_one(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


@register("j17_key_subset", oracle("SELECT count(*) AS n, sum(units)::BIGINT AS units FROM sales WHERE (store_id, sku_id) IN (SELECT store_id, sku_id FROM sales WHERE is_promo)", "sales"))
def j17(spark, d):
    s = roles.sales(spark, d)
    return s.join(s.filter("is_promo").select("store_id", "sku_id"), ["store_id", "sku_id"], "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@register("j18_two_roles", "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j18(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("first_name"), F.col("b.n_name").alias("second_name"))


@register("j19_total_reconciliation", "SELECT count(*) AS n_orders, count(*) FILTER (WHERE abs(t - o_totalprice::DECIMAL(18,2)) > 0.01) AS n_off FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j19(spark, d):
    totals = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t"))
    joined = table(spark, d, "orders").join(totals, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.abs(F.col("t") - F.col("o_totalprice").cast("decimal(18,2)")) > 0.01).alias("n_off"))


@register("j20_region_correlated", oracle("SELECT g.d, g.region_id, g.category, (SELECT round(avg(units), 6) FROM grid h WHERE h.region_id = g.region_id AND h.category = g.category AND h.units > 0 AND h.d >= g.d - 7 AND h.d < g.d) AS velocity FROM (SELECT DISTINCT d, region_id, category FROM grid) g", "grid"))
def j20(spark, d):
    sold = F.when(F.col("units") > 0, F.col("units"))
    daily = roles.grid(spark, d).groupBy("d", "region_id", "category").agg(F.sum(sold).alias("s"), F.count(sold).alias("n"))
    week = J.days_window(["region_id", "category"], "d", -7, -1)
    return daily.select("d", "region_id", "category", F.round(F.sum("s").over(week) / F.nullif(F.sum("n").over(week), F.lit(0)), 6).alias("velocity"))


@register("j21_promotion_bridge", oracle("SELECT c.d, x.cell_id, min(promotion_id) AS promotion_id FROM calendar c JOIN promotions ON c.d BETWEEN start_date AND end_date JOIN (SELECT n_nationkey AS cell_id FROM nation) x ON x.cell_id % 3 = promotion_id % 3 GROUP BY ALL", "calendar", "promotions"))
def j21(spark, d):
    active = J.expand_days(roles.promotions(spark, d), F.col("start_date"), F.col("end_date"), "d").withColumn("m", F.col("promotion_id") % 3)
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_id"), (F.col("n_nationkey") % 3).alias("m"))
    return active.join(F.broadcast(roles.calendar(spark, d)), "d", "left_semi").join(cells, "m").groupBy("d", "cell_id").agg(F.min("promotion_id").alias("promotion_id"))


# ---- aggregations


@register("a02_multi_distinct", oracle("SELECT region_id, count(DISTINCT store_id) AS n_stores, count(DISTINCT sku_id) AS n_skus, count(DISTINCT order_id) AS n_orders, sum(units)::BIGINT AS units FROM sales GROUP BY 1", "sales"))
def a02(spark, d):
    return roles.sales(spark, d).groupBy("region_id").agg(F.count_distinct("store_id").alias("n_stores"), F.count_distinct("sku_id").alias("n_skus"), F.count_distinct("order_id").alias("n_orders"), F.sum("units").alias("units"))


@register("a04_filtered_pivot", oracle("SELECT category, sum(units) FILTER (WHERE is_promo)::BIGINT AS promo_units, sum(units) FILTER (WHERE NOT is_promo)::BIGINT AS base_units, count(*) FILTER (WHERE return_flag = 'R') AS n_returned, bool_or(units >= 50) AS has_bulk, min(brand) AS any_brand FROM sales GROUP BY 1", "sales"))
def a04(spark, d):
    p = F.col("is_promo")
    return roles.sales(spark, d).groupBy("category").agg(F.sum(F.when(p, F.col("units"))).alias("promo_units"), F.sum(F.when(~p, F.col("units"))).alias("base_units"), F.count_if(F.col("return_flag") == "R").alias("n_returned"), F.bool_or(F.col("units") >= 50).alias("has_bulk"), F.min("brand").alias("any_brand"))


@register("a06_listagg", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a06(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@register("a09_duplicate_grain", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a09(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register("a10_nested_average", "SELECT round(avg(n), 6) AS lines_per_order FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def a10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").count().agg(F.round(F.avg("count"), 6).alias("lines_per_order"))


@register("a11_group_summaries", oracle("SELECT category, count(*) AS n, round(avg(units), 6) AS mean, round(stddev_samp(units), 6) AS std, count(DISTINCT cell_id) AS n_cells FROM grid GROUP BY 1", "grid"))
def a11(spark, d):
    return roles.grid(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("units"), 6).alias("mean"), F.round(F.stddev_samp("units"), 6).alias("std"), F.count_distinct("cell_id").alias("n_cells"))


def _profile_sql(column: str) -> str:
    x = f"{column}::DOUBLE"
    return f"SELECT '{column}' AS column_name, count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS low, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, round(quantile_cont({x}, 0.95), 6) AS p95, max({x}) AS high, round((avg({x}**3) - 3*avg({x})*avg({x}**2) + 2*avg({x})**3) / stddev_pop({x})**3, 6) AS skew FROM lineitem"


@register("a12_numeric_profile", " UNION ALL ".join(_profile_sql(c) for c in ("l_quantity", "l_discount")))
def a12(spark, d):
    return A.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])


@register("a13_missingness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique FROM part" for c in ("p_brand", "p_type", "p_size")))
def a13(spark, d):
    return A.missingness(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@register("a13_top_values", "SELECT column_name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE r <= 3")
def a13_top(spark, d):
    return A.top_values(table(spark, d, "part"), ["p_brand", "p_type"], 3)


@register("a14_correlations", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
def a14(spark, d):
    c = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return table(spark, d, "lineitem").agg(c("l_quantity", "l_extendedprice", "quantity_price"), c("l_quantity", "l_discount", "quantity_discount"), c("l_discount", "l_tax", "discount_tax"))


@register("a15_moment_skew", oracle("WITH m AS (SELECT category, avg(units) AS m, stddev_samp(units) AS s FROM grid GROUP BY 1) SELECT category, round(avg((units - m) ** 3) / any_value(s) ** 3, 6) AS moment_skew FROM grid JOIN m USING (category) GROUP BY 1", "grid"))
def a15(spark, d):
    return A.moment_skew(roles.grid(spark, d), ["category"], "units")


@register("a16_iqr_outliers", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT any_value(q1) AS q1, any_value(q3) AS q3, count(*) FILTER (WHERE o_totalprice < q1 - 1.5*(q3-q1) OR o_totalprice > q3 + 1.5*(q3-q1)) AS n_outliers FROM orders, q")
def a16(spark, d):
    return A.tukey_outliers(table(spark, d, "orders"), "o_totalprice")


@register("a17_weighted_quantiles", "WITH c AS (SELECT l_quantity::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total FROM c) SELECT q, min(v) AS quantile_value FROM k, (SELECT unnest([0.25, 0.5, 0.9]::DOUBLE[]) AS q) WHERE cum >= q * total GROUP BY q")
def a17(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))  # fifty quantities
    return A.weighted_quantiles(counts, "v", "n", [0.25, 0.5, 0.9])


@register("a17_value_shares", "SELECT p_size, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 9) AS share FROM part GROUP BY 1")
def a17_shares(spark, d):
    counts = table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("p_size", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@register("a18_pivot", oracle("SELECT region_name, sum(units) FILTER (WHERE line_status = 'F')::BIGINT AS \"F\", sum(units) FILTER (WHERE line_status = 'O')::BIGINT AS \"O\" FROM sales GROUP BY 1", "sales"))
def a18(spark, d):
    return roles.sales(spark, d).groupBy("region_name").pivot("line_status", ["F", "O"]).agg(F.sum("units"))


@register("a19_basket_density", oracle("SELECT round(count(*) / (count(DISTINCT order_id) * count(DISTINCT brand))::DOUBLE, 9) AS density FROM (SELECT DISTINCT order_id, brand FROM sales)", "sales"))
def a19(spark, d):
    rows = roles.sales(spark, d, by_order=True).select("order_id", "brand").distinct()
    return rows.agg(F.round(F.count(F.lit(1)) / (F.count_distinct("order_id") * F.count_distinct("brand")), 9).alias("density"))


@register("a20_error_metrics", oracle("SELECT category, count(*) AS n, round(sum(abs(p - y)) / sum(abs(y))::DOUBLE, 6) AS wape, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(sum(p - y) / sum(abs(y))::DOUBLE, 6) AS bias FROM (SELECT category, units AS y, coalesce(lag(units, 7) OVER (PARTITION BY cell_id, category ORDER BY d), 0) AS p FROM grid) GROUP BY 1", "grid"))
def a20(spark, d):
    p = F.coalesce(F.lag("units", 7).over(Window.partitionBy(*CELL).orderBy("d")), F.lit(0))
    return roles.grid(spark, d).withColumn("p", p).groupBy("category").agg(F.count(F.lit(1)).alias("n"), *A.error_metrics(F.col("units"), F.col("p")))


@register("a22_composite_distinct", oracle("SELECT count(DISTINCT concat(warehouse_id, ':', category)) AS n_series, count(DISTINCT d) AS n_days FROM inventory", "inventory"))
def a22(spark, d):
    return roles.inventory(spark, d).agg(F.count_distinct("warehouse_id", "category").alias("n_series"), F.count_distinct("d").alias("n_days"))


@register("a24_state_sequences", oracle("SELECT cell_id, string_agg(state::VARCHAR, ' -> ' ORDER BY m) AS states, count(*) FILTER (WHERE before IS NOT NULL AND before <> state) AS n_changes FROM (SELECT *, lag(state) OVER (PARTITION BY cell_id ORDER BY m) AS before FROM (SELECT cell_id, strftime(d, '%Y-%m') AS m, (sum(units) > 800)::INT AS state FROM grid GROUP BY ALL)) GROUP BY 1", "grid"))
def a24(spark, d):
    monthly = roles.grid(spark, d).groupBy("cell_id", F.date_format("d", "yyyy-MM").alias("m")).agg((F.sum("units") > 800).cast("int").alias("state"))
    monthly = monthly.withColumn("changed", (F.lag("state").over(Window.partitionBy("cell_id").orderBy("m")) != F.col("state")).cast("int"))
    states = F.transform(F.array_sort(F.collect_list(F.struct("m", "state"))), lambda x: x["state"].cast("string"))
    return monthly.groupBy("cell_id").agg(F.array_join(states, " -> ").alias("states"), F.coalesce(F.sum("changed"), F.lit(0)).alias("n_changes"))


# ---- windows


@register("w01_gap_days", "SELECT o_custkey, o_orderkey, date_diff('day', lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate::DATE)::INT AS gap_days FROM orders")
def w01(spark, d):
    before = F.lag(F.to_date("o_orderdate")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff(F.to_date("o_orderdate"), before).alias("gap_days"))


@register("w02_episode_starts", oracle("SELECT warehouse_id, count(*) AS n_starts FROM (SELECT warehouse_id, available, coalesce(lag(available) OVER (PARTITION BY warehouse_id, category ORDER BY d), 1) AS before FROM inventory) WHERE available <= 0 AND before > 0 GROUP BY 1", "inventory"))
def w02(spark, d):
    before = F.coalesce(F.lag("available").over(Window.partitionBy("warehouse_id", "category").orderBy("d")), F.lit(1))
    return roles.inventory(spark, d).withColumn("before", before).filter("available <= 0 and before > 0").groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n_starts"))


@register("w03_flow_breaks", oracle("SELECT count(*) FILTER (WHERE before + change <> available) AS n_breaks, count(before) AS n_steps FROM (SELECT *, lag(available) OVER (PARTITION BY warehouse_id, category ORDER BY d) AS before FROM inventory)", "inventory"))
def w03(spark, d):
    before = F.lag("available").over(Window.partitionBy("warehouse_id", "category").orderBy("d"))
    return roles.inventory(spark, d).withColumn("before", before).agg(F.count_if(F.col("before") + F.col("change") != F.col("available")).alias("n_breaks"), F.count("before").alias("n_steps"))


@register("w07_strict_prior", oracle("SELECT d, cell_id, category, count(*) OVER w AS n, round(avg(units) OVER w, 6) AS mean, round(stddev_samp(units) OVER w, 6) AS std FROM grid WHERE units > 0 WINDOW w AS (PARTITION BY cell_id, category ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "grid"))
def w07(spark, d):
    before = Window.partitionBy(*CELL).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return roles.grid(spark, d).filter("units > 0").select("d", *CELL, F.count(F.lit(1)).over(before).alias("n"), F.round(F.avg("units").over(before), 6).alias("mean"), F.round(F.stddev_samp("units").over(before), 6).alias("std"))


@register("w08_runs", oracle("SELECT cell_id, category, min(d) AS run_start, max(d) AS run_end, count(*) AS run_days FROM (SELECT *, d - (row_number() OVER (PARTITION BY cell_id, category ORDER BY d))::INT AS island FROM grid WHERE units > 0) GROUP BY cell_id, category, island", "grid"))
def w08(spark, d):
    return W.runs(roles.grid(spark, d).filter("units > 0"), CELL, "d")


@register("w12_pct_change", oracle("SELECT cell_id, m, units, round(units / nullif(lag(units) OVER (PARTITION BY cell_id ORDER BY m), 0)::DOUBLE - 1, 6) AS change FROM (SELECT cell_id, date_trunc('month', d)::DATE AS m, sum(units)::BIGINT AS units FROM grid GROUP BY ALL)", "grid"))
def w12(spark, d):
    monthly = roles.grid(spark, d).groupBy("cell_id", F.trunc("d", "month").alias("m")).agg(F.sum("units").alias("units"))
    before = F.lag("units").over(Window.partitionBy("cell_id").orderBy("m"))
    return monthly.withColumn("change", F.round(F.col("units") / F.nullif(before, F.lit(0)) - 1, 6))


@register("w13_latest_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w13(spark, d):
    return W.latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@register("w14_percent_rank", "SELECT p_partkey, p_size, round((rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY p_type), 9) AS pct_rank, ntile(3) OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS tercile FROM part")
def w14(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    placed = W.places(W.rank_shares(part, ["p_type"], "p_size", 1 / 8), ["p_type", "p_size"], "p_partkey", 1 / 65536)
    first = F.col("n_below") + F.col("place")  # from 1, in the order of size and key
    long, size = F.col("n_all") % 3, F.floor(F.col("n_all") / 3)  # the first terciles have one row more
    tercile = F.when(first <= long * (size + 1), F.ceil(first / (size + 1))).otherwise(long + F.ceil((first - long * (size + 1)) / size))
    return placed.select("p_partkey", "p_size", F.round("share", 9).alias("pct_rank"), tercile.cast("long").alias("tercile"))


@register("w15_ratio_to_max", "SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_type), 9) AS ratio FROM part")
def w15(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / F.max("p_retailprice").over(Window.partitionBy("p_type")), 9).alias("ratio"))


@register("w16_every_nth", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n, greatest(count(*) OVER (PARTITION BY p_type) // 20, 1) AS step FROM part) WHERE n % step = 0 AND n // step < 20")
def w16(spark, d):
    return W.every_nth(table(spark, d, "part"), ["p_type"], ["p_partkey"], 20).select("p_type", "p_partkey")


@register("w17_volume_groups", oracle("WITH s AS (SELECT cell_id, category, avg(units) AS mean, avg((units = 0)::INT) AS zero FROM grid GROUP BY ALL), q AS (SELECT quantile_cont(mean, 0.33) AS a, quantile_cont(mean, 0.67) AS b FROM s) SELECT cell_id, category, CASE WHEN mean <= a THEN 'low' WHEN mean <= b THEN 'medium' ELSE 'high' END AS volume_group, CASE WHEN zero >= 0.5 THEN 'intermittent' ELSE 'regular' END AS demand_group FROM s, q", "grid"))
def w17(spark, d):
    s = roles.grid(spark, d).groupBy(*CELL).agg(F.avg("units").alias("mean"), F.avg((F.col("units") == 0).cast("int")).alias("zero"))
    q = s.agg(F.percentile("mean", F.lit(0.33)).alias("a"), F.percentile("mean", F.lit(0.67)).alias("b"))  # one row
    volume = F.when(F.col("mean") <= F.col("a"), "low").when(F.col("mean") <= F.col("b"), "medium").otherwise("high")
    return s.crossJoin(F.broadcast(q)).select(*CELL, volume.alias("volume_group"), F.when(F.col("zero") >= 0.5, "intermittent").otherwise("regular").alias("demand_group"))


@register("w18_lead_times", oracle("WITH %s, w AS (SELECT e.*, (SELECT min(i.d) FROM inventory i WHERE i.warehouse_id = e.warehouse_id AND i.category = e.category AND i.d >= e.episode_start - 7 AND i.d < e.episode_start AND i.available <= 20) AS first_alert FROM episodes e) SELECT warehouse_id, category, episode_start, first_alert, date_diff('day', first_alert, episode_start)::INT AS lead_days FROM w" % EPISODES_CTE, "inventory"))
def w18(spark, d):
    """The first day of warning in the week before each episode.  Warned days are listed under the days they may warn of."""
    warned = roles.inventory(spark, d).filter("available <= 20").select("warehouse_id", "category", F.col("d").alias("alert"), F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", 7))).alias("episode_start"))
    first = warned.groupBy("warehouse_id", "category", "episode_start").agg(F.min("alert").alias("first_alert"))
    joined = ds09(spark, d).join(first, ["warehouse_id", "category", "episode_start"], "left")
    return joined.select("warehouse_id", "category", "episode_start", "first_alert", F.datediff("episode_start", "first_alert").alias("lead_days"))


# ---- sorts and sets


@register("s01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def s01(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@register("s02_latest_ascending", oracle("SELECT * FROM (SELECT sale_date, sum(units)::BIGINT AS units FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 30) ORDER BY 1", "sales"))
def s02(spark, d):
    return roles.sales(spark, d).groupBy("sale_date").agg(F.sum("units").alias("units")).orderBy(F.desc("sale_date")).limit(30).orderBy("sale_date")


@register("s04_mixed_order", "SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_size DESC, p_brand ASC, abs(p_retailprice - 1000) DESC NULLS LAST, p_partkey LIMIT 40")
def s04(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_size"), "p_brand", F.abs(F.col("p_retailprice") - 1000).desc_nulls_last(), "p_partkey").limit(40).select("p_partkey", "p_size", "p_brand")


@register("s06_paging", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def s06(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@register("s08_distinct_values", "SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 500")
def s08(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").limit(500)


@register("u01_date_domain", "SELECT o_orderdate::DATE AS d FROM orders UNION SELECT l_shipdate::DATE FROM lineitem")
def u01(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).union(table(spark, d, "lineitem").select(F.to_date("l_shipdate"))).distinct()


@register("u02_labelled_union", "SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def u02(spark, d):
    counts = [table(spark, d, t).agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("n")) for label, t in (("orders", "orders"), ("lines", "lineitem"), ("events", "events"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("u04_purge_shared", "WITH e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM e)")
def u04(spark, d):
    orders = table(spark, d, "orders")
    late = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return orders.filter(~late).join(orders.filter(late).select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@register("u06_set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def u06(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").select("l_partkey"))


@register("u07_jaccard", "SELECT round(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0)::DOUBLE, 9) AS jaccard, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a OR b) AS n_union FROM (SELECT l_discount >= 0.05 AS a, l_quantity >= 25 AS b FROM lineitem)")
def u07(spark, d):
    a, b = F.col("l_discount") >= 0.05, F.col("l_quantity") >= 25
    both, either = F.count_if(a & b), F.count_if(a | b)
    return table(spark, d, "lineitem").agg(F.round(both / F.nullif(either, F.lit(0)), 9).alias("jaccard"), both.alias("n_both"), either.alias("n_union"))


# ---- scalar functions


@register("f01_date_parts", "SELECT DISTINCT d, strftime(d, '%Y%m%d')::INT AS date_key, year(d)::INT AS y, quarter(d)::INT AS q, month(d)::INT AS m, week(d)::INT AS w, dayofweek(d)::INT AS dow, dayname(d) AS day_name, date_trunc('week', d)::DATE AS week_start, strftime(d, '%Y-%m') AS month_name FROM (SELECT o_orderdate::DATE AS d FROM orders)")
def f01(spark, d):
    c = F.col("d")
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(c, F.date_format(c, "yyyyMMdd").cast("int").alias("date_key"), F.year(c).alias("y"), F.quarter(c).alias("q"), F.month(c).alias("m"), F.weekofyear(c).alias("w"), (F.dayofweek(c) - 1).alias("dow"), F.date_format(c, "EEEE").alias("day_name"), F.trunc(c, "week").alias("week_start"), F.date_format(c, "yyyy-MM").alias("month_name"))


@register("f08_rule_ids", "SELECT n_name, substr(sha256(n_name || '->' || r_name), 1, 16) AS rule_id, md5(n_name) AS content_hash FROM nation JOIN region ON n_regionkey = r_regionkey")
def f08(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", F.substring(F.sha2(F.concat("n_name", F.lit("->"), "r_name"), 256), 1, 16).alias("rule_id"), F.md5("n_name").alias("content_hash"))


@register("f09_json_fields", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def f09(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("f10_strict_numbers", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || value ELSE value::VARCHAR END AS DOUBLE) IS NULL AS rejected FROM events")
def f10(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", raw.try_cast("double").isNull().alias("rejected"))

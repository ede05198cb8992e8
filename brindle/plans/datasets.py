"""Point-in-time datasets: features look back, targets look ahead, and nothing crosses the prediction day.

All look-backs and look-aheads of a dataset share one sort by key and day: they are range frames over calendar days, not
joins.  ``null`` means not observable; zero means observed and none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.joins import days_window, expand_days, validity_join
from brindle.operators.sequences import episodes
from brindle.plans.catalog import register
from brindle.sources import roles
from brindle.sources.roles import REORDER_POINT, SAFETY_STOCK, oracle

CELL = ["cell_id", "category"]


def forecasting(grid: DataFrame, prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """Lags, trailing week, scheduled price and promotion, and the next week's units where it is complete."""
    week, ahead = days_window(CELL, "d", -7, -1), days_window(CELL, "d", 1, 7)
    lags = {f"lag_{k}": F.max("units").over(days_window(CELL, "d", -k, -k)) for k in (1, 7, 14, 28)}
    frame = grid.withColumns(
        lags
        | {
            "rolling_mean_7d": F.round(F.avg("units").over(week), 6),
            "rolling_std_7d": F.round(F.stddev_samp("units").over(week), 6),
            "sales_velocity_7d": F.sum("units").over(week),
            "zero_days_prior_7d": F.sum((F.col("units") == 0).cast("long")).over(week),
            "observed_days_next_7d": F.count("units").over(ahead),
            "_next": F.sum("units").over(ahead),
        }
    )
    complete = F.col("observed_days_next_7d") == 7
    frame = frame.withColumn("target_complete", complete).withColumn("target_units_next_7d", F.when(complete, F.col("_next")))
    frame = validity_join(frame, prices, CELL, "d").withColumnRenamed("price", "scheduled_price").drop("valid_from", "valid_to")
    running = expand_days(promotions, F.col("start_date"), F.col("end_date"), "d").groupBy("d").agg(F.min("promotion_id").alias("scheduled_promotion_id"))
    frame = frame.join(F.broadcast(running), "d", "left")  # at most one row a day of the calendar
    return frame.withColumn("scheduled_is_promo", F.col("scheduled_promotion_id").isNotNull()).drop("_next", "revenue", "is_promo")


FORECASTING_SQL = """
SELECT g.d, g.cell_id, g.region_id, g.category, g.units,
  (SELECT max(h.units) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d = g.d - 1) AS lag_1,
  (SELECT max(h.units) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d = g.d - 7) AS lag_7,
  (SELECT max(h.units) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d = g.d - 14) AS lag_14,
  (SELECT max(h.units) FROM grid h WHERE h.cell_id = g.cell_id AND h.category = g.category AND h.d = g.d - 28) AS lag_28,
  round(avg(units) OVER w, 6) AS rolling_mean_7d, round(stddev_samp(units) OVER w, 6) AS rolling_std_7d,
  (sum(units) OVER w)::BIGINT AS sales_velocity_7d, (sum((units = 0)::INT) OVER w)::BIGINT AS zero_days_prior_7d,
  count(units) OVER f AS observed_days_next_7d, count(units) OVER f = 7 AS target_complete,
  CASE WHEN count(units) OVER f = 7 THEN sum(units) OVER f END::BIGINT AS target_units_next_7d,
  p.price AS scheduled_price, q.id AS scheduled_promotion_id, q.id IS NOT NULL AS scheduled_is_promo
FROM grid g
LEFT JOIN prices p ON p.cell_id = g.cell_id AND p.category = g.category AND g.d BETWEEN p.valid_from AND p.valid_to
LEFT JOIN (SELECT c.d, min(promotion_id) AS id FROM calendar c JOIN promotions ON c.d BETWEEN start_date AND end_date GROUP BY c.d) q ON q.d = g.d
WINDOW w AS (PARTITION BY g.cell_id, g.category ORDER BY g.d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
       f AS (PARTITION BY g.cell_id, g.category ORDER BY g.d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING)
"""


@register("ds01_forecasting", oracle(FORECASTING_SQL, "grid", "prices", "promotions"))
def ds01(spark: SparkSession, d: str) -> DataFrame:
    return forecasting(roles.grid(spark, d), roles.prices(spark, d), roles.promotions(spark, d))


def stockout(inventory: DataFrame, reorder: int = REORDER_POINT, safety: int = SAFETY_STOCK, horizon: int = 7) -> DataFrame:
    """Stock ratios and the first stockout within the horizon, with event and censoring times."""
    keys = ["warehouse_id", "category"]
    ahead, week, whole = days_window(keys, "d", 1, horizon), days_window(keys, "d", -7, -1), Window.partitionBy(*keys)
    frame = inventory.withColumns(
        {
            "stock_to_safety_ratio": F.round(F.col("available") / F.lit(float(safety)), 6),
            "distance_to_reorder_point": F.col("available") - reorder,
            "replenishment_sum_7d": F.sum(F.greatest("change", F.lit(0))).over(week),
            "sales_velocity_7d": F.round(F.avg(F.when(F.col("change") < 0, -F.col("change"))).over(week), 6),
            "first_stockout_date": F.min(F.when(F.col("available") <= 0, F.col("d"))).over(ahead),
            "_left": F.datediff(F.max("d").over(whole), "d"),
        }
    )
    first = F.col("first_stockout_date")
    return frame.select(
        *keys, "d", "available", "stock_to_safety_ratio", "distance_to_reorder_point", "replenishment_sum_7d", "sales_velocity_7d", "first_stockout_date",
        first.isNotNull().alias("event_observed"), F.datediff(first, "d").alias("event_time_days"),
        F.when(first.isNull(), F.least(F.lit(horizon), F.greatest(F.lit(0), F.col("_left")))).alias("censor_time_days"),
        (F.col("_left") >= horizon).alias("horizon_complete"),
        F.when(first.isNotNull() | (F.col("_left") >= horizon), first.isNotNull()).alias("stockout_within_7d"),
    )


STOCKOUT_SQL = f"""
WITH last AS (SELECT max(d) AS m FROM inventory),
x AS (SELECT i.*, (SELECT min(j.d) FROM inventory j WHERE j.warehouse_id = i.warehouse_id AND j.category = i.category AND j.d > i.d AND j.d <= i.d + 7 AND j.available <= 0) AS first_stockout_date,
  (SELECT sum(greatest(j.change, 0)) FROM inventory j WHERE j.warehouse_id = i.warehouse_id AND j.category = i.category AND j.d >= i.d - 7 AND j.d < i.d)::BIGINT AS replenishment_sum_7d,
  round((SELECT avg(-j.change) FROM inventory j WHERE j.warehouse_id = i.warehouse_id AND j.category = i.category AND j.d >= i.d - 7 AND j.d < i.d AND j.change < 0), 6) AS sales_velocity_7d
  FROM inventory i)
SELECT warehouse_id, category, d, available, round(available / {SAFETY_STOCK}.0::DOUBLE, 6) AS stock_to_safety_ratio, available - {REORDER_POINT} AS distance_to_reorder_point,
  replenishment_sum_7d, sales_velocity_7d, first_stockout_date, first_stockout_date IS NOT NULL AS event_observed, date_diff('day', d, first_stockout_date)::INT AS event_time_days,
  CASE WHEN first_stockout_date IS NULL THEN least(7, greatest(0, date_diff('day', d, m))) END::INT AS censor_time_days,
  date_diff('day', d, m) >= 7 AS horizon_complete,
  CASE WHEN first_stockout_date IS NOT NULL OR date_diff('day', d, m) >= 7 THEN first_stockout_date IS NOT NULL END AS stockout_within_7d
FROM x, last
"""


@register("ds02_stockout", oracle(STOCKOUT_SQL, "inventory"))
def ds02(spark: SparkSession, d: str) -> DataFrame:
    return stockout(roles.inventory(spark, d))


def segmentation(sales: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Thirty-day store features at each month end.  Each sale is listed under the snapshots that it counts for."""
    near = F.array(F.last_day("sale_date"), F.last_day(F.add_months(F.trunc("sale_date", "month"), 1)))
    rows = sales.withColumn("snapshot_date", F.explode(F.filter(near, lambda s: F.col("sale_date") > F.date_add(s, -30))))
    rows = rows.join(F.broadcast(snapshots), "snapshot_date")  # one row a month
    daily = rows.groupBy("snapshot_date", "store_id", "region_id", "channel", "sale_date").agg(
        F.sum("net").alias("net"), F.sum("units").alias("units"), F.sum(F.when(F.col("is_promo"), F.col("units")).otherwise(0)).alias("promo_units"), F.collect_set("sku_id").alias("skus")
    )
    return daily.groupBy("snapshot_date", "store_id", "region_id", "channel").agg(
        F.sum("net").cast("double").alias("revenue_30d"), F.sum("units").alias("units_30d"),
        F.size(F.array_distinct(F.flatten(F.collect_list("skus")))).cast("long").alias("active_skus_30d"),
        (F.expr("cast(sum(net) * 10000 as bigint) div sum(units)") / 10000).alias("average_price_30d"),
        F.round(F.sum("promo_units") / F.sum("units"), 6).alias("promotion_unit_share_30d"),
        F.round(F.stddev_samp(F.col("net").cast("double")), 4).alias("revenue_volatility_30d"),
    )


SEGMENTATION_SQL = """
WITH snaps AS (SELECT DISTINCT last_day(l_shipdate::DATE) AS snapshot_date FROM lineitem WHERE last_day(l_shipdate::DATE) <= (SELECT max(l_shipdate::DATE) FROM lineitem)),
r AS (SELECT s.*, snapshot_date FROM sales s, snaps WHERE sale_date <= snapshot_date AND sale_date > snapshot_date - 30),
v AS (SELECT snapshot_date, store_id, stddev_samp(net::DOUBLE) AS vol FROM (SELECT snapshot_date, store_id, sale_date, sum(net) AS net FROM r GROUP BY ALL) GROUP BY ALL)
SELECT r.snapshot_date, r.store_id, region_id, channel, sum(net)::DOUBLE AS revenue_30d, sum(units)::BIGINT AS units_30d, count(DISTINCT sku_id) AS active_skus_30d,
  ((sum(net) * 10000)::BIGINT // sum(units)::BIGINT) / 10000::DOUBLE AS average_price_30d, round(sum(CASE WHEN is_promo THEN units ELSE 0 END) / sum(units)::DOUBLE, 6) AS promotion_unit_share_30d,
  round(any_value(vol), 4) AS revenue_volatility_30d
FROM r JOIN v ON v.snapshot_date = r.snapshot_date AND v.store_id = r.store_id GROUP BY ALL
"""


@register("ds03_segmentation", oracle(SEGMENTATION_SQL, "sales"))
def ds03(spark: SparkSession, d: str) -> DataFrame:
    return segmentation(roles.sales(spark, d), roles.snapshots(spark, d))


@register("ds04_segment_assignment", oracle(SEGMENTATION_SQL, "sales"))
def ds04(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as the segmentation dataset: assignments add no labels."""
    return ds03(spark, d)


def anomaly(grid: DataFrame) -> DataFrame:
    """Sales events with what was known before them, over days with sales only."""
    sold = grid.filter("units > 0")
    week = days_window(CELL, "d", -7, -1)
    return sold.select(
        "d", *CELL, F.col("units").alias("event_units"), (F.floor(F.round(F.col("revenue") * 10000) / F.col("units")) / 10000).alias("event_unit_price"), F.col("is_promo").alias("event_is_promo"),
        F.max("units").over(days_window(CELL, "d", -1, -1)).alias("lag_1"), F.max("units").over(days_window(CELL, "d", -7, -7)).alias("lag_7"),
        F.round(F.avg("units").over(week), 6).alias("rolling_mean_7d"), F.round(F.stddev_samp("units").over(week), 6).alias("rolling_std_7d"),
    )


ANOMALY_SQL = """
WITH e AS (SELECT * FROM grid WHERE units > 0)
SELECT d, cell_id, category, units AS event_units, floor(round(revenue * 10000) / units) / 10000::DOUBLE AS event_unit_price, is_promo AS event_is_promo,
  max(units) OVER (PARTITION BY cell_id, category ORDER BY d RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS lag_1,
  max(units) OVER (PARTITION BY cell_id, category ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS lag_7,
  round(avg(units) OVER w, 6) AS rolling_mean_7d, round(stddev_samp(units) OVER w, 6) AS rolling_std_7d
FROM e WINDOW w AS (PARTITION BY cell_id, category ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
"""


@register("ds05_anomaly", oracle(ANOMALY_SQL, "grid"))
def ds05(spark: SparkSession, d: str) -> DataFrame:
    return anomaly(roles.grid(spark, d))


def baskets(sales: DataFrame) -> DataFrame:
    """Order x product lines with their context."""
    return sales.groupBy("order_id", "sku_id", "order_date", "store_id", "brand", "category", "region_id", "channel").agg(F.sum("units").alias("quantity"))


@register("ds06_basket", oracle("SELECT order_id, sku_id, order_date, store_id, brand, category, region_id, channel, sum(units)::BIGINT AS quantity FROM sales GROUP BY ALL", "sales"))
def ds06(spark: SparkSession, d: str) -> DataFrame:
    return baskets(roles.sales(spark, d, by_order=True))


def promotion_daily(grid: DataFrame, prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """Each exposure (promotion x cell x category) day by day, from as many days before to as many after as it lasts.

    Measures are null outside the observed calendar, and zero inside it where nothing was sold.
    """
    exposures = grid.select(*CELL, "region_id").distinct().join(F.broadcast(promotions), F.col("cell_id") % 3 == F.col("promotion_id") % 3)
    days = expand_days(exposures, F.expr("date_sub(start_date, days)"), F.expr("date_add(end_date, days)"))
    c = F.col("calendar_date")
    period = F.when(c < F.col("start_date"), "PRE").when(c <= F.col("end_date"), "DURING").otherwise("POST")
    bounds = grid.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))  # one row
    days = days.withColumn("period", period).crossJoin(F.broadcast(bounds))
    seen = c.between(F.col("first_day"), F.col("last_day"))
    days = days.withColumn("is_observable", seen).withColumn("boundary_status", F.when(seen, "IN_BOUNDS").when(c < F.col("first_day"), "BEFORE_DATA").otherwise("AFTER_DATA"))
    exposed = days.select("promotion_id", *CELL, "calendar_date")  # before the joins below, which keep every day once
    sold = grid.filter("units > 0").select(F.col("d").alias("calendar_date"), *CELL, F.col("units").alias("_units"), F.col("revenue").alias("_revenue"))
    days = days.join(sold, ["calendar_date", *CELL], "left")
    days = days.withColumn("realized_units", F.when(seen, F.coalesce("_units", F.lit(0)))).withColumn("realized_revenue", F.when(seen, F.coalesce("_revenue", F.lit(0.0))))
    days = validity_join(days, prices, CELL, "calendar_date").withColumn("posted_price", F.when(F.col("is_observable"), F.col("price")))
    running = expand_days(promotions.withColumnRenamed("promotion_id", "other"), F.col("start_date"), F.col("end_date"))
    running = running.select("calendar_date", "other").distinct()
    also = exposed.join(F.broadcast(running), "calendar_date").filter((F.col("other") != F.col("promotion_id")) & (F.col("cell_id") % 3 == F.col("other") % 3))
    also = also.groupBy("promotion_id", *CELL, "calendar_date").agg(F.expr("listagg(cast(other as string), ',') WITHIN GROUP (ORDER BY other)").alias("overlapping_promotion_ids"))
    days = days.join(also, ["promotion_id", *CELL, "calendar_date"], "left").withColumn("promotion_overlap", F.col("overlapping_promotion_ids").isNotNull())
    return days.select("promotion_id", *CELL, "region_id", "calendar_date", "period", "is_observable", "boundary_status", "realized_units", "realized_revenue", "posted_price", "promotion_overlap", "overlapping_promotion_ids")


PROMOTION_DAILY_CTE = """
promo_daily AS (
  SELECT e.promotion_id, e.cell_id, e.category, e.region_id, e.calendar_date,
    CASE WHEN e.calendar_date < start_date THEN 'PRE' WHEN e.calendar_date <= end_date THEN 'DURING' ELSE 'POST' END AS period,
    e.calendar_date BETWEEN lo AND hi AS is_observable,
    CASE WHEN e.calendar_date BETWEEN lo AND hi THEN 'IN_BOUNDS' WHEN e.calendar_date < lo THEN 'BEFORE_DATA' ELSE 'AFTER_DATA' END AS boundary_status,
    CASE WHEN e.calendar_date BETWEEN lo AND hi THEN coalesce(g.units, 0) END AS realized_units,
    CASE WHEN e.calendar_date BETWEEN lo AND hi THEN coalesce(g.revenue, 0) END AS realized_revenue,
    CASE WHEN e.calendar_date BETWEEN lo AND hi THEN p.price END AS posted_price,
    o.ids IS NOT NULL AS promotion_overlap, o.ids AS overlapping_promotion_ids
  FROM (SELECT x.*, q.*, unnest(generate_series(start_date - days::INT, end_date + days::INT, INTERVAL 1 DAY))::DATE AS calendar_date
        FROM (SELECT DISTINCT cell_id, category, region_id FROM grid) x JOIN promotions q ON x.cell_id % 3 = q.promotion_id % 3) e
  CROSS JOIN (SELECT min(d) AS lo, max(d) AS hi FROM grid)
  LEFT JOIN grid g ON g.d = e.calendar_date AND g.cell_id = e.cell_id AND g.category = e.category
  LEFT JOIN prices p ON p.cell_id = e.cell_id AND p.category = e.category AND e.calendar_date BETWEEN p.valid_from AND p.valid_to
  LEFT JOIN (SELECT a.promotion_id, c.d, string_agg(b.promotion_id::VARCHAR, ',' ORDER BY b.promotion_id) AS ids
             FROM promotions a JOIN promotions b ON a.promotion_id <> b.promotion_id AND a.promotion_id % 3 = b.promotion_id % 3
             JOIN (SELECT unnest(generate_series(min(start_date), max(end_date), INTERVAL 1 DAY))::DATE AS d FROM promotions) c ON c.d BETWEEN b.start_date AND b.end_date GROUP BY ALL) o
    ON o.promotion_id = e.promotion_id AND o.d = e.calendar_date)"""


@register("ds07_promotion_daily", oracle(f"WITH {PROMOTION_DAILY_CTE} SELECT * FROM promo_daily", "grid", "prices", "promotions"))
def ds07(spark: SparkSession, d: str) -> DataFrame:
    return promotion_daily(roles.grid(spark, d), roles.prices(spark, d), roles.promotions(spark, d))


def promotion_performance(daily: DataFrame) -> DataFrame:
    """One row an exposure: days, sums and daily rates by period, null unless the period was seen in full."""
    measures = []
    for p in ("PRE", "DURING", "POST"):
        mine, k = F.col("period") == p, p.lower()
        measures += [
            F.count_if(mine).alias(f"{k}_expected_days"),
            F.count_if(mine & F.col("is_observable")).alias(f"{k}_observed_days"),
            F.sum(F.when(mine, F.col("realized_units"))).alias(f"partial_{k}_units"),
            F.round(F.avg(F.when(mine, F.round(F.col("posted_price") * 10000).cast("long"))) / 10000, 6).alias(f"{k}_mean_price"),
        ]
    rows = daily.groupBy("promotion_id", *CELL).agg(*measures, F.bool_or("promotion_overlap").alias("has_overlap"), F.min("region_id").alias("region_id"))
    for k in ("pre", "during", "post"):
        whole = F.col(f"{k}_observed_days") == F.col(f"{k}_expected_days")
        rows = rows.withColumn(f"{k}_complete", whole).withColumn(f"{k}_units", F.when(whole, F.col(f"partial_{k}_units")))
        rows = rows.withColumn(f"{k}_units_per_day", F.round(F.col(f"{k}_units") / F.col(f"{k}_expected_days"), 6))
    return rows.withColumn("comparison_eligible", F.expr("pre_complete and during_complete and post_complete and not has_overlap"))


def _performance_sql() -> str:
    parts = []
    for p in ("PRE", "DURING", "POST"):
        k, f = p.lower(), f"FILTER (WHERE period = '{p}')"
        full = f"count(*) FILTER (WHERE period = '{p}' AND is_observable) = count(*) {f}"
        parts += [
            f"count(*) {f} AS {k}_expected_days", f"count(*) FILTER (WHERE period = '{p}' AND is_observable) AS {k}_observed_days", f"(sum(realized_units) {f})::BIGINT AS partial_{k}_units",
            f"round(avg(round(posted_price * 10000)::BIGINT) {f} / 10000, 6) AS {k}_mean_price", f"{full} AS {k}_complete", f"CASE WHEN {full} THEN sum(realized_units) {f} END::BIGINT AS {k}_units",
            f"round(CASE WHEN {full} THEN sum(realized_units) {f} END / (count(*) {f})::DOUBLE, 6) AS {k}_units_per_day",
        ]
    seen = " AND ".join(f"count(*) FILTER (WHERE period = '{p}' AND is_observable) = count(*) FILTER (WHERE period = '{p}')" for p in ("PRE", "DURING", "POST"))
    return f"SELECT promotion_id, cell_id, category, min(region_id) AS region_id, bool_or(promotion_overlap) AS has_overlap, {', '.join(parts)}, {seen} AND NOT bool_or(promotion_overlap) AS comparison_eligible FROM promo_daily GROUP BY ALL"


@register("ds08_promotion_performance", oracle(f"WITH {PROMOTION_DAILY_CTE} {_performance_sql()}", "grid", "prices", "promotions"))
def ds08(spark: SparkSession, d: str) -> DataFrame:
    return promotion_performance(ds07(spark, d))


EPISODES_CTE = """
episodes AS MATERIALIZED (
  SELECT warehouse_id, category, d AS episode_start, recovery_date, coalesce(date_diff('day', d, recovery_date), date_diff('day', d, last_day) + 1)::INT AS duration_days, recovery_date IS NULL AS right_censored
  FROM (SELECT i.*, coalesce(lag(available) OVER o, 1) AS before, max(d) OVER (PARTITION BY warehouse_id, category) AS last_day,
               min(CASE WHEN available > 0 THEN d END) OVER (PARTITION BY warehouse_id, category ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recovery_date
        FROM inventory i WINDOW o AS (PARTITION BY warehouse_id, category ORDER BY d))
  WHERE available <= 0 AND before > 0)"""

#: The episode that holds an event ``x`` of a day: the last one that started by then, if it has not ended.  Episodes do not overlap.
AS_OF = "ASOF LEFT JOIN episodes e ON e.warehouse_id = x.warehouse_id AND e.category = x.category AND e.episode_start <= x.{0}"
HELD = "(e.episode_start IS NOT NULL AND (e.recovery_date IS NULL OR x.{0} < e.recovery_date))"


@register("ds09_stockout_episodes", oracle(f"WITH {EPISODES_CTE} SELECT * FROM episodes", "inventory"))
def ds09(spark: SparkSession, d: str) -> DataFrame:
    return episodes(roles.inventory(spark, d), ["warehouse_id", "category"], "d", "available")


def survival_cohort(frame: DataFrame) -> DataFrame:
    """At-risk rows with follow-up, and why the others are left out."""
    duration = F.when(F.col("event_observed"), F.col("event_time_days")).otherwise(F.col("censor_time_days"))
    status = F.when(F.col("available") <= 0, "already_out").when(duration <= 0, "no_follow_up").otherwise("included")
    return frame.select("warehouse_id", "category", "d", "available", "event_observed", duration.alias("duration_days"), status.alias("cohort_status"))


@register("ds10_survival_cohort", oracle(f"WITH s AS ({STOCKOUT_SQL.replace('WITH last', 'WITH last', 1)}) SELECT warehouse_id, category, d, available, event_observed, CASE WHEN event_observed THEN event_time_days ELSE censor_time_days END AS duration_days, CASE WHEN available <= 0 THEN 'already_out' WHEN (CASE WHEN event_observed THEN event_time_days ELSE censor_time_days END) <= 0 THEN 'no_follow_up' ELSE 'included' END AS cohort_status FROM s", "inventory"))
def ds10(spark: SparkSession, d: str) -> DataFrame:
    return survival_cohort(ds02(spark, d))

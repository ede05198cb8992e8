"""Sensitivity, gates, audits and evidence tables of the analytical cores; serving and simulation as queries."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import eda, forest, scoring, serving
from brindle.operators.contracts import Feature, Signature
from brindle.operators.sequences import latest
from brindle.plans.analytics import _COMPARISON_SQL, _LATEST_SQL, _Z_SQL, _cohort, _latest, _rules, _scored, _table_sql, an01, bk04, pr03
from brindle.plans.analytics import _PERIOD_SQL
from brindle.plans.catalog import register
from brindle.plans.datasets import AS_OF, CELL, EPISODES_CTE, HELD, PROMOTION_DAILY_CTE, STOCKOUT_SQL, ds02, ds03, ds05, ds07, ds09
from brindle.plans.io_streams import shared_folder
from brindle.sources import roles, simulate
from brindle.sources.roles import oracle, table


@register("an05_sensitivity")
def an05(spark: SparkSession, d: str) -> DataFrame:
    """Share flagged and Jaccard with the first setting, for a grid of contamination and seed."""
    events = ds05(spark, d).select("d", *CELL, "event_units", "event_unit_price").cache()
    scored = {(c, s): forest.isolation_scores(events, ["event_units", "event_unit_price"], contamination=c, seed=s, keys=["d", *CELL]) for c in (0.01, 0.02) for s in (1, 2)}
    first, out = None, None
    for (c, s), frame in scored.items():
        flags = frame.select("d", *CELL, "is_anomaly")
        first = flags.withColumnRenamed("is_anomaly", "_first") if first is None else first
        both = flags.join(first, ["d", *CELL])
        a, b = F.col("is_anomaly"), F.col("_first")
        row = both.agg(F.lit(c).alias("contamination"), F.lit(s).alias("seed"), F.round(F.avg(a.cast("int")), 6).alias("flagged"), F.round(F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0)), 6).alias("jaccard"))
        out = row if out is None else out.unionByName(row)
    return out


_LEVELS = ((0.005, "brand"), (0.01, "brand"), (0.005, "category"), (0.01, "category"))


@register("bk05_support_levels", oracle(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS min_support, '{i}' AS level, count(*) AS n_pairs FROM (SELECT x.i AS a, y.i AS b, count(*) AS n FROM (SELECT DISTINCT order_id, {i} AS i FROM sales) x JOIN (SELECT DISTINCT order_id, {i} AS i FROM sales) y ON x.order_id = y.order_id AND x.i < y.i GROUP BY ALL) WHERE n >= {s} * (SELECT count(DISTINCT order_id) FROM sales)" for s, i in _LEVELS), "sales"))
def bk05(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs stay at each support, for brands and for categories."""
    from brindle.operators.joins import item_pairs

    sales = roles.sales(spark, d, by_order=True)
    n = sales.agg(F.count_distinct("order_id").alias("n_orders"))
    out = None
    for level in ("brand", "category"):
        pairs = item_pairs(sales, "order_id", level).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))
        for s in (0.005, 0.01):
            row = pairs.filter(F.col("n") >= F.lit(s) * F.col("n_orders")).agg(F.lit(s).alias("min_support"), F.lit(level).alias("level"), F.count(F.lit(1)).alias("n_pairs"))
            out = row if out is None else out.unionByName(row)
    return out


@register("bk05_eligible_contexts", oracle("SELECT region_name, channel, count(DISTINCT order_id) AS n_baskets, count(DISTINCT order_id) >= 100 AS eligible FROM sales GROUP BY ALL", "sales"))
def bk05_contexts(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("order_id")
    return roles.sales(spark, d).groupBy("region_name", "channel").agg(n.alias("n_baskets"), (n >= 100).alias("eligible"))


@register("pr01_contract_gates", oracle(f"WITH {PROMOTION_DAILY_CTE} SELECT 'duplicate_days' AS gate, coalesce(sum(n - 1), 0)::BIGINT AS violations FROM (SELECT count(*) AS n FROM promo_daily GROUP BY promotion_id, cell_id, category, calendar_date) UNION ALL SELECT 'null_inside', count(*) FROM promo_daily WHERE is_observable AND realized_units IS NULL UNION ALL SELECT 'value_outside', count(*) FROM promo_daily WHERE NOT is_observable AND realized_units IS NOT NULL UNION ALL SELECT 'sold_without_price', count(*) FROM promo_daily WHERE realized_units > 0 AND posted_price IS NULL", "grid", "prices", "promotions"))
def pr01(spark: SparkSession, d: str) -> DataFrame:
    daily = ds07(spark, d)
    seen, u = F.col("is_observable"), F.col("realized_units")
    gates = {"null_inside": seen & u.isNull(), "value_outside": ~seen & u.isNotNull(), "sold_without_price": (u > 0) & F.col("posted_price").isNull()}
    one = daily.agg(*[F.count_if(c).alias(g) for g, c in gates.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("violations")) for g in gates])).alias("x")).select("x.*")
    twice = daily.groupBy("promotion_id", *CELL, "calendar_date").agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.lit("duplicate_days").alias("gate"), F.coalesce(F.sum("x"), F.lit(0)).alias("violations"))
    return twice.unionByName(long)


@register("pr05_baseline_sensitivity", oracle(f"WITH {PROMOTION_DAILY_CTE}, r AS (SELECT promotion_id, cell_id, category, avg(realized_units) FILTER (WHERE period = 'DURING') AS during, avg(realized_units) FILTER (WHERE period = 'PRE') AS pre, avg(realized_units) FILTER (WHERE period = 'PRE' AND date_diff('day', calendar_date, s.start_date) <= 7) AS pre7 FROM promo_daily JOIN promotions s USING (promotion_id) WHERE is_observable GROUP BY ALL) SELECT promotion_id, count(*) AS n, count(*) FILTER (WHERE sign(during - pre) = sign(during - pre7)) AS n_same_sign, round(avg(abs(pre - pre7)), 6) AS mean_shift FROM r WHERE pre IS NOT NULL AND pre7 IS NOT NULL GROUP BY 1", "grid", "prices", "promotions"))
def pr05(spark: SparkSession, d: str) -> DataFrame:
    """Do effects keep their sign against a shorter baseline?"""
    daily = ds07(spark, d).filter("is_observable").join(F.broadcast(roles.promotions(spark, d).select("promotion_id", "start_date")), "promotion_id")
    u, pre = F.col("realized_units"), F.col("period") == "PRE"
    near = pre & (F.datediff("start_date", "calendar_date") <= 7)
    r = daily.groupBy("promotion_id", *CELL).agg(F.avg(F.when(F.col("period") == "DURING", u)).alias("during"), F.avg(F.when(pre, u)).alias("pre"), F.avg(F.when(near, u)).alias("pre7")).filter("pre is not null and pre7 is not null")
    return r.groupBy("promotion_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum(F.col("during") - F.col("pre")) == F.signum(F.col("during") - F.col("pre7"))).alias("n_same_sign"), F.round(F.avg(F.abs(F.col("pre") - F.col("pre7"))), 6).alias("mean_shift"))


@register("pr06_extreme_changes", oracle(f"WITH {_COMPARISON_SQL} SELECT promotion_id, cell_id, category, comparison, change FROM cmp WHERE change IS NOT NULL ORDER BY abs(change) DESC, promotion_id, cell_id, category, comparison LIMIT 50", "grid", "prices", "promotions"))
def pr06_extreme(spark: SparkSession, d: str) -> DataFrame:
    return pr03(spark, d).filter("change is not null").select("promotion_id", *CELL, "comparison", "change").orderBy(F.desc(F.abs("change")), "promotion_id", *CELL, "comparison").limit(50)


@register("pr06_eligibility_funnel", oracle(f"WITH {PROMOTION_DAILY_CTE}, e AS (SELECT promotion_id, cell_id, category, bool_and(is_observable) AS seen, bool_or(promotion_overlap) AS overlap FROM promo_daily GROUP BY ALL) SELECT promotion_id, count(*) AS n_exposures, count(*) FILTER (WHERE seen) AS n_complete, count(*) FILTER (WHERE seen AND NOT overlap) AS n_eligible FROM e GROUP BY 1", "grid", "prices", "promotions"))
def pr06_funnel(spark: SparkSession, d: str) -> DataFrame:
    e = ds07(spark, d).groupBy("promotion_id", *CELL).agg(F.bool_and("is_observable").alias("seen"), F.bool_or("promotion_overlap").alias("overlap"))
    return e.groupBy("promotion_id").agg(F.count(F.lit(1)).alias("n_exposures"), F.count_if("seen").alias("n_complete"), F.count_if(F.col("seen") & ~F.col("overlap")).alias("n_eligible"))


@register("so01_horizon_episodes", oracle(f"WITH {EPISODES_CTE}, x AS (SELECT i.warehouse_id, i.category, i.d, i.available, min(CASE WHEN available <= 0 THEN d END) OVER (PARTITION BY warehouse_id, category ORDER BY d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING) AS f FROM inventory i) SELECT x.warehouse_id, x.category, x.d, x.f AS first_stockout_date, e.episode_start FROM (SELECT * FROM x WHERE available > 0 AND f IS NOT NULL) x {AS_OF.format('f')} WHERE {HELD.format('f')}", "inventory"))
def so01(spark: SparkSession, d: str) -> DataFrame:
    """Positive horizons with the episode that their first stockout belongs to."""
    from brindle.operators.joins import in_episode

    positive = ds02(spark, d).filter("available > 0 and event_observed").select("warehouse_id", "category", "d", "first_stockout_date")
    return in_episode(positive, ds09(spark, d), ["warehouse_id", "category"], "first_stockout_date").select("warehouse_id", "category", "d", "first_stockout_date", "episode_start")


@register("so08_detection", oracle(f"WITH {EPISODES_CTE}, w AS (SELECT e.*, (SELECT min(i.d) FROM inventory i WHERE i.warehouse_id = e.warehouse_id AND i.category = e.category AND i.d >= e.episode_start - 7 AND i.d < e.episode_start AND i.available <= 20) AS a FROM episodes e) SELECT count(*) AS n_episodes, count(a) AS n_detected, round(count(a) / count(*)::DOUBLE, 6) AS detection_rate, median(date_diff('day', a, episode_start)) AS median_lead FROM w", "inventory"))
def so08(spark: SparkSession, d: str) -> DataFrame:
    from brindle.plans.relational import w18

    return w18(spark, d).agg(F.count(F.lit(1)).alias("n_episodes"), F.count("first_alert").alias("n_detected"), F.round(F.count("first_alert") / F.count(F.lit(1)), 6).alias("detection_rate"), F.percentile("lead_days", F.lit(0.5)).alias("median_lead"))


@register("sv05_proportionality")
def sv05(spark: SparkSession, d: str) -> DataFrame:
    """The test of proportional hazards by Schoenfeld residuals, one row a covariate."""
    from brindle.operators import cox

    columns = ["stock", "velocity"]
    frame = _cohort(spark, d).select("t", "event_observed", (F.col("available") / 50.0).alias("stock"), (F.coalesce("sales_velocity_7d", F.lit(0.0)) / 20.0).alias("velocity")).cache()
    found = cox.proportionality(frame, "t", "event_observed", columns, cox.fit_cox(frame, "t", "event_observed", columns))
    return spark.createDataFrame([(c, n, round(s, 4), round(q, 6)) for c, n, s, q in found], "covariate string, n_events long, statistic double, p_value double")


@register("sg01_latest_cohort", oracle(f"WITH s AS (SELECT store_id, max(sale_date) AS last_day, count(DISTINCT sale_date) AS n_days FROM sales GROUP BY 1) SELECT * FROM s WHERE last_day >= {roles.split_sql(0.95)}", "calendar", "sales"))
def sg01(spark: SparkSession, d: str) -> DataFrame:
    return roles.sales(spark, d).groupBy("store_id").agg(F.max("sale_date").alias("last_day"), F.count_distinct("sale_date").alias("n_days")).filter(F.col("last_day") >= roles.split_day(spark, d, 0.95))


@register("sg08_feature_audit", oracle(f"WITH {_LATEST_SQL} SELECT feature, count(*) AS n, count(DISTINCT v) AS n_unique, round(((avg(v**3) - 3*avg(v)*avg(v**2) + 2*avg(v)**3) / stddev_pop(v)**3) * sqrt(count(*)::DOUBLE * (count(*) - 1)) / (count(*) - 2), 4) AS adjusted_skew FROM (SELECT unnest(['revenue_30d', 'units_30d']) AS feature, unnest([revenue_30d, units_30d::DOUBLE]) AS v FROM latest) GROUP BY 1", "sales"))
def sg08(spark: SparkSession, d: str) -> DataFrame:
    long = _latest(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in ("revenue_30d", "units_30d")])).alias("x")).select("x.*")
    n = F.count(F.lit(1))
    return long.groupBy("feature").agg(n.alias("n"), F.count_distinct("v").alias("n_unique"), F.round(F.skewness("v") * F.sqrt(n.cast("double") * (n - 1)) / (n - 2), 4).alias("adjusted_skew"))


@register("rp04_component_plot")
def rp04(spark: SparkSession, d: str) -> DataFrame:
    """The latest stores on two principal components."""
    from brindle.operators.clusters import robust_scale

    columns = ["revenue_30d", "units_30d", "active_skus_30d"]
    scaled = robust_scale(_latest(spark, d), columns)
    flat = VectorAssembler(inputCols=[f"{c}_scaled" for c in columns], outputCol="_v").transform(scaled)
    parts = PCA(k=2, inputCol="_v", outputCol="_pc").fit(flat).transform(flat).withColumn("_pc", vector_to_array("_pc"))
    return parts.select("store_id", F.round(F.abs(F.col("_pc")[0]), 6).alias("component_1"), F.round(F.abs(F.col("_pc")[1]), 6).alias("component_2"))


@register("rp05_top_anomalies", oracle(f"WITH {_Z_SQL} SELECT d, cell_id, category, event_units, z FROM z WHERE direction = 'HIGH' AND z IS NOT NULL ORDER BY z DESC, d, cell_id, category LIMIT 20", "grid"))
def rp05(spark: SparkSession, d: str) -> DataFrame:
    return an01(spark, d).filter("direction = 'HIGH' and z is not null").select("d", *CELL, "event_units", "z").orderBy(F.desc("z"), "d", *CELL).limit(20)


@register("rp06_stable_rules", oracle(f"WITH {_PERIOD_SQL}, v AS (SELECT rule_id FROM per GROUP BY 1 HAVING count(*) FILTER (WHERE period_support > 0) >= 3 AND round(stddev_samp(period_support) / nullif(avg(period_support), 0), 6) <= 0.25) SELECT rule_id, antecedent, consequent, round(support * confidence * lift, 9) AS ranking_score FROM rules WHERE rule_id IN (SELECT rule_id FROM v) ORDER BY support * confidence * lift DESC, rule_id LIMIT 15", "sales"))
def rp06(spark: SparkSession, d: str) -> DataFrame:
    stable = bk04(spark, d).filter("stability = 'STABLE'").select("rule_id")
    ranked = _rules(spark, d).join(stable, "rule_id", "left_semi").withColumn("_s", F.col("support") * F.col("confidence") * F.col("lift"))
    return ranked.orderBy(F.desc("_s"), "rule_id").limit(15).select("rule_id", "antecedent", "consequent", F.round("_s", 9).alias("ranking_score"))


@register("q11_simulated_checks", oracle("""
SELECT count(*) AS n, count(*) FILTER (WHERE b + change <> available) AS n_flow_broken, count(*) FILTER (WHERE before IS NOT NULL AND before <> d - 1) AS n_gap,
  (SELECT count(*) FROM (SELECT 1 FROM inventory GROUP BY warehouse_id, category, d HAVING count(*) > 1)) AS n_duplicates,
  (SELECT sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END)::BIGINT FROM lineitem JOIN part ON l_partkey = p_partkey) - sum(change)::BIGINT AS n_units_lost
FROM (SELECT *, lag(available) OVER (PARTITION BY warehouse_id, category ORDER BY d) AS b, lag(d) OVER (PARTITION BY warehouse_id, category ORDER BY d) AS before FROM inventory)
""", "inventory"))
def q11(spark: SparkSession, d: str) -> DataFrame:
    """The laws of the stock series: each day's flow, no gap, unique grain, and no unit of the lines lost."""
    stock = roles.inventory(spark, d)
    days = Window.partitionBy("warehouse_id", "category").orderBy("d")
    laws = stock.withColumns({"b": F.lag("available").over(days), "before": F.lag("d").over(days)}).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") + F.col("change") != F.col("available")).alias("n_flow_broken"), F.count_if(F.col("before") != F.date_sub("d", 1)).alias("n_gap"), F.sum("change").alias("_change")
    )
    twice = stock.groupBy("warehouse_id", "category", "d").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n_duplicates"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long")).alias("_lines"))
    return laws.crossJoin(twice).crossJoin(lines).select("n", "n_flow_broken", "n_gap", "n_duplicates", (F.col("_lines") - F.col("_change")).alias("n_units_lost"))  # one row each


@register("si02_price_schedule", oracle("SELECT brand, valid_from, (valid_from + INTERVAL 6 DAY)::DATE AS valid_to, CASE WHEN w % 3 = 2 THEN floor(base * 90) / 100 ELSE floor(base * 100) / 100 END::DOUBLE AS price FROM (SELECT p_brand AS brand, max(p_retailprice) AS base FROM part GROUP BY 1) CROSS JOIN (SELECT w, low + (7 * w)::INT AS valid_from FROM (SELECT min(d) AS low, unnest(range((max(d) - min(d)) // 7 + 1)) AS w FROM calendar))", "calendar"))
def si02(spark: SparkSession, d: str) -> DataFrame:
    """A weekly schedule of every brand from the highest price of its parts."""
    bases = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_retailprice").alias("base"))
    return simulate.weekly_prices(bases, roles.calendar(spark, d), "brand", "base")


@register("si03_donor_statistics", oracle("WITH x AS (SELECT category, units, is_promo, gross::DOUBLE AS gross, gross::DOUBLE / max(gross::DOUBLE) OVER (PARTITION BY category) AS r FROM sales) SELECT category, count(*) AS n, round(avg(is_promo::INT), 6) AS flag_rate, round(avg((units > 0)::INT), 6) AS nonzero_rate, quantile_cont(units, 0.5)::DOUBLE AS p50, quantile_cont(units, 0.9)::DOUBLE AS p90, round(avg(r), 6) AS price_ratio FROM x GROUP BY 1", "sales"))
def si03(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.sales(spark, d).select("category", "units", "is_promo", F.col("gross").cast("double").alias("gross"))
    return simulate.donor_statistics(rows, "category", "units", "is_promo", "gross")


@register("se01_batch_inference", oracle(f"WITH s AS ({STOCKOUT_SQL}), p AS (SELECT round(1 / (1 + exp((available - 20) / 10.0::DOUBLE)), 6) AS p FROM s) SELECT count(*) AS n, round(avg(p), 6) AS mean_probability, count(*) FILTER (WHERE p NOT BETWEEN 0 AND 1) AS n_faults FROM p", "inventory"))
def se01(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear model over the stockout features behind its signature."""
    p = 1 / (1 + F.exp((F.col("available") - 20) / 10.0))
    model = serving.Model("stockout", "1", Signature((Feature("available", "integer"), Feature("distance_to_reorder_point", "integer"))), lambda f: f.withColumn("probability", F.round(p, 6)), {"probability": "probability"})
    registry = serving.Registry()
    registry.add(model)
    frame = ds02(spark, d).select("available", "distance_to_reorder_point")
    scored = serving.Engine(registry).infer("stockout", frame)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability")).crossJoin(serving.output_faults(scored, model.outputs).withColumnRenamed("probability", "n_faults"))


_SPOILT = "CASE WHEN o_orderkey % 13 = 5 THEN NULL WHEN o_orderkey % 17 = 3 THEN 'n/a' WHEN o_orderkey % 19 = 2 THEN '2.5' ELSE (o_orderkey % 40)::VARCHAR END"
_SCORE = "20 / (20 + ({}))"


@register("se03_scored_rows", f"WITH x AS (SELECT o_orderkey, {_SPOILT} AS v, CASE WHEN o_orderstatus = 'P' THEN '?' ELSE o_orderstatus END AS s, o_orderkey % 40 AS k FROM orders), f AS (SELECT *, concat_ws(',', CASE WHEN v IS NULL THEN 'available:NULL_FEATURE' WHEN v IN ('n/a', '2.5') THEN 'available:INVALID_FEATURE' END, CASE WHEN s = '?' THEN 'status:INVALID_FEATURE' END) AS faults FROM x) SELECT o_orderkey, CASE WHEN faults = '' AND k <> 33 THEN round({_SCORE.format('k')}::DOUBLE, 6) END AS probability, CASE WHEN faults = '' AND k = 33 THEN 'probability:INVALID_OUTPUT' ELSE faults END AS faults FROM f")
def se03(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows to be scored, some of them spoilt, by a model that errs on one value: scores for good rows, codes for bad ones."""
    k = F.col("o_orderkey")
    spoilt = F.when(k % 13 == 5, None).when(k % 17 == 3, "n/a").when(k % 19 == 2, "2.5").otherwise((k % 40).cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", spoilt.alias("available"), F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus")).alias("status"))
    p = F.when(F.col("available") == 33, 1.5).otherwise(F.round(F.expr(_SCORE.format("available")), 6))
    signature = Signature((Feature("available", "integer", coerce=True), Feature("status", "string", categories=("F", "O"))))
    registry = serving.Registry()
    registry.add(serving.Model("stockout", "1", signature, lambda f: f.withColumn("probability", p), {"probability": "probability"}))
    out = serving.Engine(registry).infer_rows("stockout", rows, keep=["o_orderkey"])
    return out.withColumn("faults", F.array_join(F.transform("faults", lambda x: F.concat(x.feature, F.lit(":"), x.code)), ","))


@register("se04_latest_features", oracle("SELECT * EXCLUDE (n) FROM (SELECT warehouse_id, category, d, available, change, row_number() OVER (PARTITION BY warehouse_id, category ORDER BY d DESC) AS n FROM inventory WHERE d <= " + roles.split_sql(0.7) + ") WHERE n = 1", "inventory"))
def se04(spark: SparkSession, d: str) -> DataFrame:
    return latest(roles.inventory(spark, d).filter(F.col("d") <= roles.split_day(spark, d, 0.7)), ["warehouse_id", "category"], F.desc("d"))


@register("ed01_readiness")
def ed01(spark: SparkSession, d: str) -> DataFrame:
    """Exploratory runs of two datasets: rows, repeated keys, coverage, readiness.  A run reads its dataset some forty times, so each is stored first."""
    out, folder = [], shared_folder(spark)
    for name, frame, keys, target in (("stockout", ds02(spark, d), ["warehouse_id", "category", "d"], "stockout_within_7d"), ("segmentation", ds03(spark, d), ["snapshot_date", "store_id"], None)):
        frame.write.parquet(f"{folder}/{name}")
        r = eda.run_eda(spark.read.parquet(f"{folder}/{name}"), keys, target)
        out.append((name, r["metrics"]["rows"], r["metrics"]["repeated_keys"], float(r["metrics"]["target_coverage"]), r["readiness"], len(r["findings"])))
    return spark.createDataFrame(out, "dataset string, n_rows long, repeated_keys long, target_coverage double, readiness string, n_findings int")


@register("rp03_metric_agreement", oracle(f"WITH {_table_sql()}, a AS (SELECT sum(pos + neg)::BIGINT AS n, sum(pos / all_pos::DOUBLE * tp / (tp + fp)) AS a FROM t), b AS (SELECT avg(precision) AS b FROM scored JOIN (SELECT p, tp / (tp + fp)::DOUBLE AS precision FROM t) USING (p) WHERE y = 1) SELECT n, round(a, 6) AS average_precision, (abs(a - b) > 1e-6)::BIGINT AS n_disagreeing FROM a, b", "inventory"))
def rp03(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by the ranking table and again as the mean precision at the scores of the positive rows."""
    df = _scored(spark, d)
    a = scoring.ranking_metrics(df, "y", "p").select("n", "average_precision")
    at = scoring.score_table(df, "y", "p").select(F.col("score").alias("p"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    b = df.filter("y = 1").join(at, "p").agg(F.avg("precision").alias("b"))
    return a.crossJoin(b).select("n", "average_precision", (F.abs(F.col("average_precision") - F.col("b")) > 1e-6).cast("long").alias("n_disagreeing"))  # one row each


@register("u05_itemsets_agree", oracle("WITH i AS (SELECT DISTINCT order_id, brand FROM sales), c AS (SELECT brand AS a, '' AS b, count(*) AS n FROM i GROUP BY 1 UNION ALL SELECT x.brand, y.brand, count(*) FROM i x JOIN i y ON x.order_id = y.order_id AND x.brand < y.brand GROUP BY 1, 2) SELECT count(*) AS n_itemsets, sum(n)::BIGINT AS n_occurrences, 0::BIGINT AS n_only_first, 0::BIGINT AS n_only_second FROM c WHERE n >= 0.01 * (SELECT count(DISTINCT order_id) FROM i)", "sales"))
def u05(spark: SparkSession, d: str) -> DataFrame:
    """Itemsets by frequent-pattern growth and by counting are the same; how many there are, and their occurrences."""
    from brindle.operators import rules, sets

    rows = roles.sales(spark, d, by_order=True).select("order_id", "brand")
    grown = rules.frequent_itemsets(rows, "order_id", "brand", 0.01).persist()
    totals = grown.agg(F.count(F.lit(1)).alias("n_itemsets"), F.sum("n").alias("n_occurrences"))
    return totals.crossJoin(sets.differences(grown, rules.counted_itemsets(rows, "order_id", "brand", 0.01)))  # one row each


@register("u04_purged_training_rows", oracle(f"WITH {EPISODES_CTE}, m AS MATERIALIZED (SELECT x.warehouse_id, x.category, x.d, CASE WHEN {HELD.format('d')} THEN e.episode_start END AS e FROM inventory x {AS_OF.format('d')}), s AS (SELECT {roles.split_sql(0.7)} AS s) SELECT m.warehouse_id, m.category, m.d FROM m, s WHERE m.d < s AND NOT EXISTS (SELECT 1 FROM m o, s t WHERE o.d >= t.s AND o.warehouse_id = m.warehouse_id AND o.category = m.category AND o.e = m.e)", "inventory"))
def u04(spark: SparkSession, d: str) -> DataFrame:
    """Training days without those of an episode that runs on into the evaluation, which starts 70 percent down the calendar."""
    from brindle.operators import sets
    from brindle.operators.joins import with_episode

    days = roles.inventory(spark, d).select("warehouse_id", "category", "d")
    marked = with_episode(days, ds09(spark, d), ["warehouse_id", "category"], "d")
    name = F.when(F.col("episode_start").isNotNull(), F.concat_ws(":", F.col("warehouse_id").cast("string"), "category", F.col("episode_start").cast("string")))
    late = F.col("d") >= roles.split_day(spark, d, 0.7)
    marked = marked.withColumn("episode", name)
    return sets.purge_shared(marked.filter(~late), marked.filter(late), "episode").select("warehouse_id", "category", "d")


@register("an03_jaccard_by_category", oracle(f"WITH {_Z_SQL} SELECT category, count(*) FILTER (WHERE direction <> 'NONE' AND event_units >= 60) AS n_both, count(*) FILTER (WHERE direction <> 'NONE' OR event_units >= 60) AS n_union, round(count(*) FILTER (WHERE direction <> 'NONE' AND event_units >= 60) / nullif(count(*) FILTER (WHERE direction <> 'NONE' OR event_units >= 60), 0)::DOUBLE, 9) AS jaccard FROM z GROUP BY 1", "grid"))
def an03_by(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators import sets

    flags = an01(spark, d).select("category", (F.col("direction") != "NONE").alias("a"), (F.col("event_units") >= 60).alias("b"))
    return sets.jaccard(flags, "a", "b", ["category"])

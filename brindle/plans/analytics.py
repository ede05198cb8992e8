"""The analytical cores as queries: forecasting, stockout, survival, segmentation, anomaly, basket, promotion."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import clusters, cox, forest, rules, scoring
from brindle.operators import sequences as W
from brindle.operators import summaries as A
from brindle.plans.catalog import register
from brindle.plans.datasets import CELL, PROMOTION_DAILY_CTE, SEGMENTATION_SQL, STOCKOUT_SQL, ds01, ds02, ds03, ds05, ds07, segmentation
from brindle.sources import roles
from brindle.sources.roles import oracle, table

# ---- forecasting

_BASE_SQL = "SELECT d, cell_id, category, region_id, y, 0 AS zero, 7 * coalesce(lag_1, 0) AS last_day, coalesce(velocity, 0)::BIGINT AS trailing_week FROM (SELECT d, cell_id, category, region_id, lag(units, 1) OVER o AS lag_1, sum(units) OVER (PARTITION BY cell_id, category ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS velocity, CASE WHEN count(units) OVER f = 7 THEN sum(units) OVER f END::BIGINT AS y FROM grid WINDOW o AS (PARTITION BY cell_id, category ORDER BY d), f AS (PARTITION BY cell_id, category ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) WHERE y IS NOT NULL"


def baselines(frame: DataFrame) -> DataFrame:
    """Zero, seven times yesterday, and the trailing week, never below zero."""
    positive = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return frame.filter("target_complete").select("d", *CELL, "region_id", F.col("target_units_next_7d").alias("y"), F.lit(0).alias("zero"), positive(7 * F.col("lag_1")).alias("last_day"), positive(F.col("sales_velocity_7d")).alias("trailing_week"))


@register("fc01_baselines", oracle(_BASE_SQL, "grid"))
def fc01(spark: SparkSession, d: str) -> DataFrame:
    return baselines(ds01(spark, d))


@register("fc02_baseline_errors", oracle(f"WITH b AS ({_BASE_SQL}), l AS (SELECT 'zero' AS model, y, zero AS p FROM b UNION ALL SELECT 'last_day', y, last_day FROM b UNION ALL SELECT 'trailing_week', y, trailing_week FROM b) SELECT model, round(sum(abs(p - y)) / sum(abs(y))::DOUBLE, 6) AS wape, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(sum(p - y) / sum(abs(y))::DOUBLE, 6) AS bias FROM l GROUP BY 1", "grid"))
def fc02(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("long").alias("p")) for m in ("zero", "last_day", "trailing_week")])
    long = fc01(spark, d).select("y", F.explode(models).alias("m")).select("y", "m.*")
    return long.groupBy("model").agg(*A.error_metrics(F.col("y"), F.col("p")))


@register("fc06_sliced_errors", oracle(f"WITH b AS ({_BASE_SQL}), l AS (SELECT 'category' AS dimension, category AS value, y, trailing_week AS p FROM b UNION ALL SELECT 'region_id', region_id::VARCHAR, y, trailing_week FROM b UNION ALL SELECT 'cell_id', cell_id::VARCHAR, y, trailing_week FROM b) SELECT dimension, value, count(*) AS n_rows, round(sum(abs(p - y)) / nullif(sum(abs(y)), 0)::DOUBLE, 6) AS wape, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(sum(p - y) / nullif(sum(abs(y)), 0)::DOUBLE, 6) AS bias FROM l GROUP BY 1, 2", "grid"))
def fc06(spark: SparkSession, d: str) -> DataFrame:
    return A.sliced(fc01(spark, d), ["category", "region_id", "cell_id"], A.error_metrics(F.col("y"), F.col("trailing_week")))


def forecast_models(frame: DataFrame) -> dict[str, Pipeline]:
    """The candidates: linear with ridge penalty, Poisson with log link, boosted trees."""
    numbers = ["lag_1", "lag_7", "rolling_mean_7d", "rolling_std_7d", "scheduled_price"]
    prepare = [
        Imputer(inputCols=numbers, outputCols=[f"{c}_i" for c in numbers], strategy="median"),
        StringIndexer(inputCol="category", outputCol="category_x", handleInvalid="keep"),
        OneHotEncoder(inputCols=["category_x"], outputCols=["category_v"], handleInvalid="keep"),
        VectorAssembler(inputCols=[f"{c}_i" for c in numbers], outputCol="numbers_v"),
        StandardScaler(inputCol="numbers_v", outputCol="scaled_v", withMean=True),
        VectorAssembler(inputCols=["scaled_v", "category_v"], outputCol="features"),
    ]
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "p"}
    return {
        "ridge": Pipeline(stages=[*prepare, LinearRegression(regParam=0.1, elasticNetParam=0.0, **common)]),
        "poisson": Pipeline(stages=[*prepare, GeneralizedLinearRegression(family="poisson", link="log", regParam=0.1, maxIter=15, **common)]),
        "boosted": Pipeline(stages=[*prepare, GBTRegressor(maxIter=10, maxDepth=4, seed=7, **common)]),
    }


@register("fc04_model_errors")
def fc04(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate fitted on the first weeks and judged once on later ones, with a week's gap between."""
    frame = ds01(spark, d).filter("target_complete").withColumn("y", F.col("target_units_next_7d").cast("double"))
    frame = frame.withColumns({c: F.col(c).cast("double") for c in ("lag_1", "lag_7", "rolling_mean_7d", "rolling_std_7d", "scheduled_price")}).persist()  # every iteration of a fit reads it
    train, test = frame.filter(F.col("d") <= roles.split_day(spark, d, 0.7)), frame.filter(F.col("d") > F.date_add(F.lit(roles.split_day(spark, d, 0.7)).cast("date"), 7))
    out = None
    for name, pipeline in forecast_models(frame).items():
        scored = pipeline.fit(train).transform(test).withColumn("p", F.greatest("p", F.lit(0.0)))
        row = scored.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"), *A.error_metrics(F.col("y"), F.col("p")))
        out = row if out is None else out.unionByName(row)
    return out


# ---- stockout classification

#: Labels and scores for the metrics: a stockout within a week, by a logistic rule of the stock at hand.
_SCORED_SQL = f"scored AS (SELECT stockout_within_7d::INT AS y, round(1 / (1 + exp((least(available, 500) - 20) / 10.0::DOUBLE)), 6) AS p, category AS grp FROM ({STOCKOUT_SQL}) WHERE available > 0 AND stockout_within_7d IS NOT NULL)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    known = ds02(spark, d).filter("available > 0 and stockout_within_7d is not null")
    p = F.round(1 / (1 + F.exp((F.least("available", F.lit(500)) - 20) / 10.0)), 6)
    return known.select(F.col("stockout_within_7d").cast("int").alias("y"), p.alias("p"), F.col("category").alias("grp"))


@register("so03_rule_baselines", oracle(f"WITH s AS ({STOCKOUT_SQL}) SELECT warehouse_id, category, d, 0 AS never, (available <= 20)::INT AS at_reorder, (available <= 5)::INT AS at_safety, (coalesce(sales_velocity_7d, 0) > 0 AND available / nullif(sales_velocity_7d, 0) <= 7)::INT AS low_cover FROM s", "inventory"))
def so03(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("sales_velocity_7d", F.lit(0.0))
    cover = (v > 0) & (F.col("available") / F.nullif(v, F.lit(0.0)) <= 7)
    return ds02(spark, d).select("warehouse_id", "category", "d", F.lit(0).alias("never"), (F.col("available") <= 20).cast("int").alias("at_reorder"), (F.col("available") <= 5).cast("int").alias("at_safety"), F.coalesce(cover, F.lit(False)).cast("int").alias("low_cover"))


_RANKING = """SELECT {by}sum(pos + neg)::BIGINT AS n, round(sum(pos / nullif(all_pos, 0)::DOUBLE * tp / (tp + fp)), 6) AS average_precision,
  round(sum(pos * (all_neg - fp + neg / 2.0::DOUBLE)) / nullif(max(all_pos)::DOUBLE * max(all_neg), 0), 6) AS roc_auc,
  round(sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg), 6) AS brier, round(sum(pos) / sum(pos + neg)::DOUBLE, 6) AS prevalence FROM t {group}"""


def _table_sql(by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"{_SCORED_SQL}, c AS (SELECT {cols}p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM scored GROUP BY ALL), t AS (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS tp, sum(neg) OVER ({part}ORDER BY p DESC) AS fp, sum(pos) OVER ({part}) AS all_pos, sum(neg) OVER ({part}) AS all_neg FROM c)"


@register("so04_ranking_metrics", oracle(f"WITH {_table_sql()} " + _RANKING.format(by="", group=""), "inventory"))
def so04(spark: SparkSession, d: str) -> DataFrame:
    return scoring.ranking_metrics(_scored(spark, d), "y", "p")


@register("so04_confusion", oracle(f"WITH {_SCORED_SQL}, m AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM scored) SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM m", "inventory"))
def so04_confusion(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(_scored(spark, d), "y", "p", 0.5)


@register("so05_best_threshold", oracle(f"WITH {_table_sql()}, k AS (SELECT p AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / all_pos::DOUBLE, 6) AS recall, round(fp / all_neg::DOUBLE, 6) AS fpr, round(2 * tp / (tp + fp + all_pos)::DOUBLE, 6) AS f1 FROM t) SELECT * FROM k ORDER BY f1 DESC, threshold LIMIT 1", "inventory"))
def so05(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_threshold(_scored(spark, d), "y", "p")


@register("so07_calibration", oracle(f"WITH {_SCORED_SQL}, e AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM scored) SELECT len(list_filter(edges, lambda x: x < p))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed_rate FROM scored, e GROUP BY 1", "inventory"))
def so07(spark: SparkSession, d: str) -> DataFrame:
    return scoring.calibration(_scored(spark, d), "y", "p")


@register("so09_sliced_metrics", oracle(f"WITH {_table_sql('grp')} " + _RANKING.format(by="grp, ", group="GROUP BY grp"), "inventory"))
def so09(spark: SparkSession, d: str) -> DataFrame:
    return scoring.ranking_metrics(_scored(spark, d), "y", "p", ["grp"])


@register("so10_threshold_curves", oracle(f"WITH {_table_sql()} SELECT p AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / all_pos::DOUBLE, 6) AS recall, round(fp / all_neg::DOUBLE, 6) AS fpr, round(2 * tp / (tp + fp + all_pos)::DOUBLE, 6) AS f1 FROM t", "inventory"))
def so10(spark: SparkSession, d: str) -> DataFrame:
    return scoring.curve(_scored(spark, d), "y", "p")


def _judged(spark: SparkSession, d: str, model) -> DataFrame:
    """Ranking metrics on later days of a stockout model that is fitted with balanced class weights."""
    frame = ds02(spark, d).filter("stockout_within_7d is not null and available > 0").withColumn("y", F.col("stockout_within_7d").cast("int"))
    frame = frame.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("available", "replenishment_sum_7d", "sales_velocity_7d")})
    train, test = frame.filter(F.col("d") <= roles.split_day(spark, d, 0.7)), frame.filter(F.col("d") > F.date_add(F.lit(roles.split_day(spark, d, 0.7)).cast("date"), 7))
    n = train.groupBy("y").count().withColumn("weight", F.sum("count").over(Window.partitionBy()) / (2 * F.col("count"))).drop("count")
    vectors = VectorAssembler(inputCols=["available", "replenishment_sum_7d", "sales_velocity_7d"], outputCol="v")
    fitted = model.fit(vectors.transform(train.join(F.broadcast(n), "y")))
    scored = fitted.transform(vectors.transform(test)).select("y", F.round(vector_to_array("probability")[1], 6).alias("p"))
    return scoring.ranking_metrics(scored, "y", "p")


@register("so06_balanced_logistic")
def so06(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", regParam=0.01))


@register("so06_boosted_trees")
def so06_boosted(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, GBTClassifier(featuresCol="v", labelCol="y", weightCol="weight", maxIter=10, maxDepth=4, seed=7))


# ---- survival

_COHORT_SQL = f"cohort AS (SELECT * FROM (SELECT warehouse_id, category, d, available, event_observed, CASE WHEN event_observed THEN event_time_days ELSE censor_time_days END AS t FROM ({STOCKOUT_SQL})) WHERE available > 0 AND t > 0)"


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_observed"), F.col("event_time_days")).otherwise(F.col("censor_time_days"))
    return ds02(spark, d).withColumn("t", t).filter("available > 0 and t > 0")


def _km_sql(by: str = "") -> str:
    part, cols = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"WITH {_COHORT_SQL}, c AS (SELECT {cols}t, count(*) AS n, sum(event_observed::INT)::BIGINT AS events FROM cohort GROUP BY ALL), r AS (SELECT *, (sum(n) OVER ({part}) - coalesce(sum(n) OVER ({part}ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS at_risk FROM c) SELECT {cols}t, n, events, at_risk, round(exp(sum(ln(1 - events / at_risk::DOUBLE)) OVER ({part}ORDER BY t)), 6) AS survival FROM r"


@register("sv01_kaplan_meier", oracle(_km_sql(), "inventory"))
def sv01(spark: SparkSession, d: str) -> DataFrame:
    return W.kaplan_meier(_cohort(spark, d), "t", "event_observed").withColumn("survival", F.round("survival", 6))


@register("sv01_kaplan_meier_by_warehouse", oracle(_km_sql("warehouse_id"), "inventory"))
def sv01_by(spark: SparkSession, d: str) -> DataFrame:
    return W.kaplan_meier(_cohort(spark, d), "t", "event_observed", ["warehouse_id"]).withColumn("survival", F.round("survival", 6))


@register("sv03_concordance", oracle(f"WITH {_COHORT_SQL} SELECT count(*) AS n_pairs, round(avg(CASE WHEN -a.available > -b.available THEN 1.0 WHEN a.available = b.available THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS c_index FROM cohort a JOIN cohort b ON a.event_observed AND (b.t > a.t OR (b.t = a.t AND NOT b.event_observed))", "inventory"))
def sv03(spark: SparkSession, d: str) -> DataFrame:
    return scoring.concordance(_cohort(spark, d).withColumn("r", -F.col("available")), "t", "event_observed", "r")


@register("sv04_horizon_brier", oracle(f"WITH {_COHORT_SQL}, x AS (SELECT *, 1 / (1 + exp(-(available - 20) / 10.0::DOUBLE)) AS s FROM cohort WHERE t = 7 OR event_observed) SELECT 3 AS horizon, count(*) FILTER (WHERE NOT event_observed AND t < 3) AS n_early_censored, CASE WHEN count(*) FILTER (WHERE NOT event_observed AND t < 3) = 0 THEN round(avg(pow((NOT (event_observed AND t <= 3))::INT - s, 2)), 6) END AS brier FROM x", "inventory"))
def sv04(spark: SparkSession, d: str) -> DataFrame:
    s = 1 / (1 + F.exp(-(F.col("available") - 20) / 10.0))
    return scoring.horizon_brier(_cohort(spark, d).filter("t = 7 or event_observed").withColumn("s", s), "t", "event_observed", "s", 3)


@register("sv02_cox_model")
def sv02(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients and the model's concordance."""
    frame = _cohort(spark, d).select("t", "event_observed", (F.col("available") / 50.0).alias("stock"), (F.coalesce("sales_velocity_7d", F.lit(0.0)) / 20.0).alias("velocity")).cache()
    beta = cox.fit_cox(frame, "t", "event_observed", ["stock", "velocity"])
    risky = cox.add_risk(frame, ["stock", "velocity"], beta).withColumn("risk", F.round("risk", 9))
    return scoring.concordance(risky, "t", "event_observed", "risk").withColumns({"beta_stock": F.lit(round(float(beta[0]), 6)), "beta_velocity": F.lit(round(float(beta[1]), 6))})


# ---- segmentation

_FEATURES = ("revenue_30d", "units_30d", "active_skus_30d")


def _latest(spark: SparkSession, d: str, back: int = 0) -> DataFrame:
    """The stores at the last snapshot (or so many before it), from the sales of its thirty days alone."""
    last = roles.snapshots(spark, d).orderBy(F.desc("snapshot_date")).offset(back).first()
    last = last and last[0]
    known = roles.snapshots(spark, d).filter(F.col("snapshot_date") == F.lit(last))
    return segmentation(roles.sales(spark, d).filter(F.col("sale_date").between(F.date_add(F.lit(last), -29), F.lit(last))), known)


_LATEST_SQL = "latest AS (SELECT store_id, sum(net)::DOUBLE AS revenue_30d, sum(units)::BIGINT AS units_30d, count(DISTINCT sku_id) AS active_skus_30d FROM sales, (SELECT max(last_day(l_shipdate::DATE)) AS s FROM lineitem WHERE last_day(l_shipdate::DATE) <= (SELECT max(l_shipdate::DATE) FROM lineitem)) WHERE sale_date <= s AND sale_date > s - 30 GROUP BY 1)"
_SCALED_SQL = f"{_LATEST_SQL}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _FEATURES) + " FROM latest), scaled AS (SELECT store_id, " + ", ".join(f"({c} - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1.0 ELSE q_{c}[3] - q_{c}[1] END::DOUBLE AS {c}_scaled" for c in _FEATURES) + " FROM latest, q)"


@register("sg02_robust_scaling", oracle(f"WITH {_SCALED_SQL} SELECT store_id, " + ", ".join(f"round({c}_scaled, 6) AS {c}_scaled" for c in _FEATURES) + " FROM scaled", "sales"))
def sg02(spark: SparkSession, d: str) -> DataFrame:
    return clusters.robust_scale(_latest(spark, d), _FEATURES).select("store_id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in _FEATURES])


_CENTROIDS = ((0, -0.5, -0.5, -0.5), (1, 0.3, 0.4, 0.0), (2, 2.0, 2.0, 1.5))
_SCALED = [f"{c}_scaled" for c in _FEATURES]


@register("sg05_nearest_centroid", oracle(f"WITH {_SCALED_SQL}, c(cluster, a, b, e) AS (VALUES {', '.join(map(str, _CENTROIDS))}), k AS (SELECT store_id, cluster, sqrt(pow(revenue_30d_scaled - a, 2) + pow(units_30d_scaled - b, 2) + pow(active_skus_30d_scaled - e, 2)) AS dist FROM scaled, c), r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY dist, cluster) AS n, lead(dist) OVER (PARTITION BY store_id ORDER BY dist, cluster) AS second FROM k) SELECT store_id, cluster, round(dist, 6) AS distance, round(second - dist, 6) AS margin FROM r WHERE n = 1", "sales"))
def sg05(spark: SparkSession, d: str) -> DataFrame:
    centroids = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, a, b, c in _CENTROIDS], ["cluster", *_SCALED]).withColumn("cluster", F.col("cluster").cast("int"))
    return clusters.nearest_centroid(clusters.robust_scale(_latest(spark, d), _FEATURES), centroids, ["store_id"], _SCALED)


@register("sg07_profiles", oracle(f"WITH {_LATEST_SQL}, l AS (SELECT (store_id % 3)::BIGINT AS cluster, f.* FROM latest, LATERAL (SELECT unnest(['revenue_30d', 'units_30d', 'active_skus_30d']) AS feature, unnest([revenue_30d, units_30d::DOUBLE, active_skus_30d::DOUBLE]) AS value) f), o AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY 1), c AS (SELECT cluster, feature, count(*) AS n, avg(value) AS mean, median(value) AS median FROM l GROUP BY 1, 2) SELECT cluster, feature, n, round(mean, 4) AS mean, round(median, 4) AS median, round((mean - m) / s, 4) AS standardized, CASE WHEN (mean - m) / s > 0.35 THEN 'high' WHEN (mean - m) / s < -0.35 THEN 'low' ELSE 'typical' END AS level FROM c JOIN o USING (feature)", "sales"))
def sg07(spark: SparkSession, d: str) -> DataFrame:
    return clusters.profiles(_latest(spark, d).withColumn("cluster", F.col("store_id") % 3), "cluster", _FEATURES)


@register("sg03_kmeans_segments")
def sg03(spark: SparkSession, d: str) -> DataFrame:
    scaled = clusters.robust_scale(_latest(spark, d), _FEATURES)
    return clusters.kmeans_segments(scaled.select("store_id", *_SCALED), _SCALED, 3).groupBy("segment").agg(F.count(F.lit(1)).alias("n_stores"), *[F.round(F.avg(c), 6).alias(c) for c in _SCALED])


@register("sg06_cluster_quality", oracle(f"WITH {_LATEST_SQL}, p AS (SELECT store_id % 3 AS cluster, revenue_30d AS x, units_30d::DOUBLE AS y FROM latest), c AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), g AS (SELECT avg(x) AS gx, avg(y) AS gy FROM p), w AS (SELECT p.cluster, sum(pow(x - cx, 2) + pow(y - cy, 2)) AS w, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS s FROM p JOIN c USING (cluster) GROUP BY 1), b AS (SELECT sum(n * (pow(cx - gx, 2) + pow(cy - gy, 2))) AS b, sum(n)::BIGINT AS n, count(*) AS k FROM c, g), db AS (SELECT max((a.s + e.s) / sqrt(pow(ca.cx - ce.cx, 2) + pow(ca.cy - ce.cy, 2))) AS worst FROM w a JOIN c ca USING (cluster), w e JOIN c ce USING (cluster) WHERE a.cluster <> e.cluster GROUP BY a.cluster) SELECT k, n, round((b / (k - 1)) / ((SELECT sum(w) FROM w) / (n - k)), 6) AS calinski_harabasz, round((SELECT avg(worst) FROM db), 6) AS davies_bouldin FROM b", "sales"))
def sg06(spark: SparkSession, d: str) -> DataFrame:
    points = _latest(spark, d).select((F.col("store_id") % 3).alias("cluster"), F.col("revenue_30d").alias("x"), F.col("units_30d").cast("double").alias("y"))
    return clusters.cluster_quality(points, "cluster", ["x", "y"])


@register("sg06_silhouette", oracle(f"WITH {_LATEST_SQL}, p AS (SELECT store_id, store_id % 3 AS cluster, revenue_30d AS x, units_30d::DOUBLE AS y FROM latest), k AS (SELECT a.store_id, a.cluster, b.cluster AS other, count(*) AS n, sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS s FROM p a CROSS JOIN p b GROUP BY ALL), m AS (SELECT store_id, cluster, max(s / nullif(n - 1, 0)) FILTER (WHERE cluster = other) AS a, min(s / n) FILTER (WHERE cluster <> other) AS b FROM k GROUP BY ALL), v AS (SELECT cluster, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM m) SELECT cluster::BIGINT AS cluster, count(*) AS n, round(avg(s), 6) AS silhouette FROM v GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(s), 6) FROM v", "sales"))
def sg06_silhouette(spark: SparkSession, d: str) -> DataFrame:
    points = _latest(spark, d).select((F.col("store_id") % 3).alias("cluster"), F.col("revenue_30d").alias("x"), F.col("units_30d").cast("double").alias("y"))
    return clusters.silhouette(points, "cluster", ["x", "y"])


@register("sg06_label_retention", oracle(f"WITH h AS ({SEGMENTATION_SQL}), e AS (SELECT quantile_cont(revenue_30d, [0.25, 0.75]) AS e FROM h WHERE snapshot_date = (SELECT max(snapshot_date) FROM h)), l AS (SELECT snapshot_date, store_id, CASE WHEN revenue_30d < e[1] THEN 0 WHEN revenue_30d < e[2] THEN 1 ELSE 2 END AS k FROM h, e), j AS (SELECT l.snapshot_date, l.k AS a, r.k AS b FROM l JOIN l r ON l.store_id = r.store_id AND r.snapshot_date = (SELECT max(snapshot_date) FROM h) WHERE l.snapshot_date < r.snapshot_date), n AS (SELECT snapshot_date, count(*) AS n, avg((a = b)::INT) AS same FROM j GROUP BY 1), t AS (SELECT snapshot_date, sum(c * (c - 1) / 2) AS s FROM (SELECT snapshot_date, count(*) AS c FROM j GROUP BY snapshot_date, a, b) GROUP BY 1), ta AS (SELECT snapshot_date, sum(c * (c - 1) / 2) AS s FROM (SELECT snapshot_date, count(*) AS c FROM j GROUP BY snapshot_date, a) GROUP BY 1), tb AS (SELECT snapshot_date, sum(c * (c - 1) / 2) AS s FROM (SELECT snapshot_date, count(*) AS c FROM j GROUP BY snapshot_date, b) GROUP BY 1) SELECT snapshot_date, n AS n_rows, round(same, 6) AS retention, round(CASE WHEN (ta.s + tb.s) / 2 = ta.s * tb.s / (n * (n - 1) / 2) THEN 1.0 ELSE (t.s - ta.s * tb.s / (n * (n - 1) / 2)) / ((ta.s + tb.s) / 2 - ta.s * tb.s / (n * (n - 1) / 2)) END, 6) AS adjusted_rand FROM n JOIN t USING (snapshot_date) JOIN ta USING (snapshot_date) JOIN tb USING (snapshot_date)", "sales"))
def sg06_retention(spark: SparkSession, d: str) -> DataFrame:
    """Revenue groups of the stores at earlier snapshots against those at the latest, by the latest one's cuts."""
    history = ds03(spark, d).persist()
    last = _latest(spark, d)
    low, high = A.quantiles(last, "revenue_30d", [0.25, 0.75])
    label = F.when(F.col("revenue_30d") < F.lit(low), 0).when(F.col("revenue_30d") < F.lit(high), 1).otherwise(2)
    latest_day = F.broadcast(last.agg(F.max("snapshot_date").alias("_last")))
    labelled = history.crossJoin(latest_day).select("snapshot_date", "_last", "store_id", label.alias("a"))  # one row joined
    reference = labelled.filter("snapshot_date = _last").select("store_id", F.col("a").alias("b"))
    return clusters.label_agreement(labelled.filter("snapshot_date < _last").join(reference, "store_id"), "a", "b", ["snapshot_date"])


# ---- anomaly

_Z_SQL = f"z AS (SELECT d, cell_id, category, event_units, n, CASE WHEN n >= 2 AND std > 0 THEN round((event_units - mean) / std, 6) END AS z, n >= 2 AS scorable, CASE WHEN n < 2 THEN 'NONE' WHEN std > 0 THEN CASE WHEN (event_units - mean) / std >= 3 THEN 'HIGH' WHEN (event_units - mean) / std <= -3 THEN 'LOW' ELSE 'NONE' END WHEN event_units > mean THEN 'HIGH' WHEN event_units < mean THEN 'LOW' ELSE 'NONE' END AS direction FROM (SELECT d, cell_id, category, units AS event_units, count(*) OVER w AS n, avg(units) OVER w AS mean, stddev_samp(units) OVER w AS std FROM grid WHERE units > 0 WINDOW w AS (PARTITION BY cell_id, category ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"


def z_scores(events: DataFrame, value: str = "event_units", history: int = 2, limit: float = 3.0) -> DataFrame:
    """z against strictly earlier events; a deviation of zero leaves z null and decides by sign alone."""
    before = Window.partitionBy(*CELL).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    x = events.select("d", *CELL, value, F.count(F.lit(1)).over(before).alias("n"), F.avg(value).over(before).alias("_m"), F.stddev_samp(value).over(before).alias("_s"))
    ready, z = F.col("n") >= history, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    flat = F.when(F.col(value) > F.col("_m"), "HIGH").when(F.col(value) < F.col("_m"), "LOW").otherwise("NONE")
    direction = F.when(~ready, "NONE").when(F.col("_s") > 0, F.when(z >= limit, "HIGH").when(z <= -limit, "LOW").otherwise("NONE")).otherwise(flat)
    return x.select("d", *CELL, value, "n", F.when(ready, F.round(z, 6)).alias("z"), ready.alias("scorable"), direction.alias("direction"))


@register("an01_z_scores", oracle(f"WITH {_Z_SQL} SELECT * FROM z", "grid"))
def an01(spark: SparkSession, d: str) -> DataFrame:
    return z_scores(ds05(spark, d))


@register("an02_isolation_forest")
def an02(spark: SparkSession, d: str) -> DataFrame:
    events = ds05(spark, d).select("d", *CELL, "event_units", "event_unit_price", F.coalesce("lag_1", F.lit(0)).alias("lag_1"))
    return forest.isolation_scores(events, ["event_units", "event_unit_price", "lag_1"], keys=["d", *CELL])


@register("an03_agreement", oracle(f"WITH {_Z_SQL}, f AS (SELECT direction <> 'NONE' AS a, event_units >= 60 AS b FROM z) SELECT CASE WHEN a AND b THEN 'BOTH' WHEN a THEN 'FIRST_ONLY' WHEN b THEN 'SECOND_ONLY' ELSE 'NEITHER' END AS agreement, count(*) AS n FROM f GROUP BY 1", "grid"))
def an03(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("direction") != "NONE", F.col("event_units") >= 60
    label = F.when(a & b, "BOTH").when(a, "FIRST_ONLY").when(b, "SECOND_ONLY").otherwise("NEITHER")
    return an01(spark, d).groupBy(label.alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@register("an04_anomaly_runs", oracle(f"WITH {_Z_SQL}, e AS (SELECT * FROM z WHERE direction <> 'NONE') SELECT cell_id, category, min(d) AS run_start, max(d) AS run_end, count(*) AS run_days FROM (SELECT *, d - (row_number() OVER (PARTITION BY cell_id, category ORDER BY d))::INT AS island FROM e) GROUP BY cell_id, category, island", "grid"))
def an04(spark: SparkSession, d: str) -> DataFrame:
    return W.runs(an01(spark, d).filter("direction <> 'NONE'"), CELL, "d")


@register("an06_review_ranking", oracle(f"WITH {_Z_SQL}, e AS (SELECT d, cell_id, category, event_units, coalesce(abs(z), 0) AS az FROM z WHERE scorable), r AS (SELECT *, round((rank() OVER (ORDER BY az) + (count(*) OVER (PARTITION BY az) - 1) / 2.0::DOUBLE) / count(*) OVER () + (rank() OVER (ORDER BY event_units) + (count(*) OVER (PARTITION BY event_units) - 1) / 2.0::DOUBLE) / count(*) OVER (), 9) AS review_score FROM e) SELECT * FROM r ORDER BY review_score DESC, d, cell_id, category LIMIT 100", "grid"))
def an06(spark: SparkSession, d: str) -> DataFrame:
    scored = an01(spark, d).filter("scorable").select("d", *CELL, "event_units", F.coalesce(F.abs("z"), F.lit(0.0)).alias("az"))
    return rules.review_rank(scored, "az", "event_units", k=100)


# ---- baskets

_RULES_SQL = "b AS (SELECT DISTINCT order_id, brand FROM sales), n AS (SELECT count(DISTINCT order_id) AS n FROM b), s AS (SELECT brand, count(*) AS c FROM b GROUP BY 1), p AS (SELECT x.brand AS antecedent, y.brand AS consequent, count(*) AS n_both FROM b x JOIN b y ON x.order_id = y.order_id AND x.brand <> y.brand GROUP BY ALL), rules AS (SELECT antecedent, consequent, n_both, n_both / n::DOUBLE AS support, n_both / a.c::DOUBLE AS confidence, n_both * n / (a.c * e.c)::DOUBLE AS lift, substr(sha256(antecedent || '->' || consequent), 1, 16) AS rule_id FROM p, n, s a, s e WHERE a.brand = antecedent AND e.brand = consequent AND n_both / n::DOUBLE >= 0.005 AND n_both / a.c::DOUBLE >= 0.05 AND n_both * n / (a.c * e.c)::DOUBLE >= 0.9)"


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.pair_rules(roles.sales(spark, d, by_order=True).select("order_id", "brand"), "order_id", "brand", 0.005, 0.05, 0.9)


@register("bk02_pair_rules", oracle(f"WITH {_RULES_SQL} SELECT antecedent, consequent, n_both, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift, rule_id FROM rules", "sales"))
def bk02(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).withColumns({c: F.round(c, 9) for c in ("support", "confidence", "lift")})


@register("bk02_frequent_itemsets", oracle("WITH b AS (SELECT DISTINCT order_id, brand FROM sales), n AS (SELECT count(DISTINCT order_id) AS n FROM b), i AS (SELECT brand AS itemset, count(*) AS c FROM b GROUP BY 1 UNION ALL SELECT x.brand || '|' || y.brand, count(*) FROM b x JOIN b y ON x.order_id = y.order_id AND x.brand < y.brand GROUP BY 1) SELECT itemset, c AS n FROM i, n WHERE c >= n * 0.01", "sales"))
def bk02_sets(spark: SparkSession, d: str) -> DataFrame:
    return rules.frequent_itemsets(roles.sales(spark, d, by_order=True).select("order_id", "brand"), "order_id", "brand", 0.01)


_PERIOD_SQL = f"{_RULES_SQL}, o AS (SELECT DISTINCT order_id, strftime(order_date, '%Y') AS period FROM sales), bp AS (SELECT b.*, period FROM b JOIN o USING (order_id)), g AS (SELECT period, count(*) AS n_groups FROM o GROUP BY 1), sp AS (SELECT period, brand, count(*) AS n_a FROM bp GROUP BY ALL), pp AS (SELECT x.period, x.brand AS a, y.brand AS c, count(*) AS n_both FROM bp x JOIN bp y ON x.order_id = y.order_id AND x.brand <> y.brand GROUP BY ALL), per AS (SELECT rule_id, g.period, round(coalesce(pp.n_both, 0) / n_groups::DOUBLE, 9) AS period_support, round(coalesce(pp.n_both, 0) / nullif(sp.n_a, 0)::DOUBLE, 9) AS period_confidence FROM rules CROSS JOIN g LEFT JOIN pp ON pp.period = g.period AND pp.a = antecedent AND pp.c = consequent LEFT JOIN sp ON sp.period = g.period AND sp.brand = antecedent)"


def _by_period(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.sales(spark, d, by_order=True).select("order_id", "brand", F.date_format("order_date", "yyyy").alias("period"))
    return rules.rules_by_period(rows, _rules(spark, d), "order_id", "brand", "period")


@register("bk03_rules_by_period", oracle(f"WITH {_PERIOD_SQL} SELECT * FROM per", "sales"))
def bk03(spark: SparkSession, d: str) -> DataFrame:
    return _by_period(spark, d)


@register("bk04_rule_stability", oracle(f"WITH {_PERIOD_SQL}, v AS (SELECT rule_id, count(*) FILTER (WHERE period_support > 0) AS n_periods, round(stddev_samp(period_support) / nullif(avg(period_support), 0), 6) AS variation FROM per GROUP BY 1) SELECT *, CASE WHEN n_periods < 3 THEN 'SPARSE' WHEN variation <= 0.25 THEN 'STABLE' ELSE 'VARIABLE' END AS stability FROM v", "sales"))
def bk04(spark: SparkSession, d: str) -> DataFrame:
    return rules.stability(_by_period(spark, d))


# ---- promotion

_PERIOD_RATES = f"{PROMOTION_DAILY_CTE}, pm AS (SELECT promotion_id, cell_id, category, period, count(*) FILTER (WHERE is_observable) AS n_days, sum(realized_units)::BIGINT AS units, CASE WHEN count(*) FILTER (WHERE is_observable) > 0 THEN round(sum(realized_units) / (count(*) FILTER (WHERE is_observable))::DOUBLE, 6) END AS units_per_day, CASE WHEN sum(realized_units) > 0 THEN round(round(sum(realized_revenue::DECIMAL(18,4)) * 100)::DOUBLE / sum(realized_units), 5) END AS unit_price_cents FROM promo_daily GROUP BY ALL)"


def period_rates(daily: DataFrame) -> DataFrame:
    """Days seen, units, units a day and realized price of each exposure and period."""
    seen = F.count_if("is_observable")
    return daily.groupBy("promotion_id", *CELL, "period").agg(seen.alias("n_days"), F.sum("realized_units").alias("units"), F.round(F.sum("realized_units") / F.nullif(seen, F.lit(0)), 6).alias("units_per_day"), F.when(F.sum("realized_units") > 0, F.round(F.round(F.sum(F.col("realized_revenue").cast("decimal(18,4)")) * 100).cast("double") / F.nullif(F.sum("realized_units"), F.lit(0)), 5)).alias("unit_price_cents"))


@register("pr02_period_rates", oracle(f"WITH {_PERIOD_RATES} SELECT * FROM pm", "grid", "prices", "promotions"))
def pr02(spark: SparkSession, d: str) -> DataFrame:
    return period_rates(ds07(spark, d))


_COMPARISON_SQL = f"{_PERIOD_RATES}, cmp AS (SELECT a.promotion_id, a.cell_id, a.category, k.name AS comparison, b.units_per_day - a.units_per_day AS change, CASE WHEN a.units_per_day > 0 THEN round(b.units_per_day / a.units_per_day - 1, 6) END AS relative_change, a.units_per_day = 0 AS zero_baseline FROM pm a JOIN pm b USING (promotion_id, cell_id, category) JOIN (VALUES ('during_pre', 'PRE', 'DURING'), ('post_during', 'DURING', 'POST'), ('post_pre', 'PRE', 'POST')) k(name, base, other) ON a.period = k.base AND b.period = k.other)"


def comparisons(rates: DataFrame) -> DataFrame:
    """Each exposure's change between its periods; relative changes only over a base above zero."""
    wide = rates.groupBy("promotion_id", *CELL).pivot("period", ["PRE", "DURING", "POST"]).agg(F.first("units_per_day"))
    pairs = F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(a).alias("base"), F.col(b).alias("other")) for n, a, b in (("during_pre", "PRE", "DURING"), ("post_during", "DURING", "POST"), ("post_pre", "PRE", "POST"))])
    long = wide.select("promotion_id", *CELL, F.explode(pairs).alias("x")).select("promotion_id", *CELL, "x.*")
    base = F.col("base")
    return long.select("promotion_id", *CELL, "comparison", (F.col("other") - base).alias("change"), F.when(base > 0, F.round(F.col("other") / F.nullif(base, F.lit(0.0)) - 1, 6)).alias("relative_change"), (base == 0).alias("zero_baseline"))


@register("pr03_comparisons", oracle(f"WITH {_COMPARISON_SQL} SELECT * FROM cmp", "grid", "prices", "promotions"))
def pr03(spark: SparkSession, d: str) -> DataFrame:
    return comparisons(pr02(spark, d))


@register("pr04_promotion_summary", oracle(f"WITH {_COMPARISON_SQL} SELECT promotion_id, comparison, count(change) AS n_exposures, round(sum(change), 4) AS total_change, round(median(change), 6) AS median_change, round(avg((change > 0)::INT), 6) AS share_up FROM cmp GROUP BY ALL", "grid", "prices", "promotions"))
def pr04(spark: SparkSession, d: str) -> DataFrame:
    """Totals rebuilt from exposures; medians and shares are of the units series."""
    return pr03(spark, d).groupBy("promotion_id", "comparison").agg(F.count("change").alias("n_exposures"), F.round(F.sum("change"), 4).alias("total_change"), F.round(F.percentile("change", F.lit(0.5)), 6).alias("median_change"), F.round(F.avg((F.col("change") > 0).cast("int")), 6).alias("share_up"))


@register("pr06_weekday_composition", oracle(f"WITH {PROMOTION_DAILY_CTE} SELECT promotion_id, period, dayname(calendar_date) AS weekday, count(*) FILTER (WHERE is_observable) AS n_days, sum(realized_units)::BIGINT AS units FROM promo_daily GROUP BY ALL", "grid", "prices", "promotions"))
def pr06(spark: SparkSession, d: str) -> DataFrame:
    return ds07(spark, d).groupBy("promotion_id", "period", F.date_format("calendar_date", "EEEE").alias("weekday")).agg(F.count_if("is_observable").alias("n_days"), F.sum("realized_units").alias("units"))


@register("rp07_pooled_cycle", oracle(f"WITH {_PERIOD_RATES} SELECT promotion_id, period, sum(n_days)::BIGINT AS n_days, sum(units)::BIGINT AS units, round(sum(units) / nullif(sum(n_days), 0)::DOUBLE, 6) AS pooled_rate FROM pm GROUP BY ALL", "grid", "prices", "promotions"))
def rp07(spark: SparkSession, d: str) -> DataFrame:
    return pr02(spark, d).groupBy("promotion_id", "period").agg(F.sum("n_days").alias("n_days"), F.sum("units").alias("units"), F.round(F.sum("units") / F.nullif(F.sum("n_days"), F.lit(0)), 6).alias("pooled_rate"))



"""Cluster assignment, quality and naming for store segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.summaries import quantiles


def robust_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled", fit: DataFrame | None = None) -> DataFrame:
    """(x - median) / (p75 - p25) with exact linear quantiles of ``fit`` (``df`` itself by default); a spread of zero counts as one."""
    if fit is None:
        fit = df = df.persist()  # each quantile reads it several times
    scaled = {}
    for c in columns:
        low, middle, high = quantiles(fit, c, [0.25, 0.5, 0.75])
        scaled[f"{c}{suffix}"] = F.lit(None).cast("double") if low is None else (F.col(c) - middle) / ((high - low) or 1.0)
    return df.withColumns(scaled)


def nearest_centroid(points: DataFrame, centroids: DataFrame, row_id: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nearest centroid, its distance, and the margin to the second nearest.

    ``centroids``: cluster and the columns; a model has a few dozen, so they are broadcast whole.
    """
    named = centroids.select("cluster", *[F.col(c).alias(f"_c_{c}") for c in columns])
    held = named.agg(F.sort_array(F.collect_list(F.struct("cluster", *[f"_c_{c}" for c in columns]))).alias("_all"))
    distance = lambda x: F.sqrt(sum(F.pow(F.col(c) - x[f"_c_{c}"], 2) for c in columns))
    ranked = F.sort_array(F.transform("_all", lambda x: F.struct(distance(x).alias("distance"), x["cluster"].alias("cluster"))))
    near = points.crossJoin(F.broadcast(held)).withColumn("_r", ranked)
    return near.select(*row_id, F.col("_r")[0]["cluster"].alias("cluster"), F.round(F.col("_r")[0]["distance"], 6).alias("distance"), F.round(F.get("_r", F.lit(1))["distance"] - F.col("_r")[0]["distance"], 6).alias("margin"))


def profiles(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Mean and median of every feature in every cluster, and the mean in population deviations from the overall mean."""
    long = df.select(cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(cluster, "x.*")
    overall = long.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    mine = long.groupBy(cluster, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))
    z = (F.col("mean") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    level = F.when(z > 0.35, "high").when(z < -0.35, "low").otherwise("typical")
    return mine.join(F.broadcast(overall), "feature").select(cluster, "feature", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round(z, 4).alias("standardized"), level.alias("level"))


def cluster_quality(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from centroids, in two passes over the points.

    Pairs of points are not formed; the pairs below are of centroids.
    """
    centroids = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_c_{c}") for c in columns])
    centre = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in columns])
    square = lambda a, b: sum(F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in columns)
    joined = df.join(F.broadcast(centroids), cluster)
    spread = joined.groupBy(cluster).agg(F.sum(square("", "_c_")).alias("_w"), F.avg(F.sqrt(square("", "_c_"))).alias("_d"))
    c = centroids.join(spread, cluster).crossJoin(centre)
    ch = c.agg(F.sum(F.col("_n") * square("_c_", "_g_")).alias("b"), F.sum("_w").alias("w"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    a, b = c.select(F.col(cluster).alias("ca"), "_d", *[F.col(f"_c_{x}").alias(f"a_{x}") for x in columns]), c.select(F.col(cluster).alias("cb"), F.col("_d").alias("_d2"), *[F.col(f"_c_{x}").alias(f"b_{x}") for x in columns])
    gap = F.sqrt(sum(F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) for x in columns))
    db = a.join(F.broadcast(b), F.col("ca") != F.col("cb")).groupBy("ca").agg(F.max((F.col("_d") + F.col("_d2")) / gap).alias("worst")).agg(F.round(F.avg("worst"), 6).alias("davies_bouldin"))
    return ch.crossJoin(db).select("k", "n", F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 6).alias("calinski_harabasz"), "davies_bouldin")


def silhouette(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Mean silhouette by squared Euclidean distance, over all and by cluster (``cluster`` null for all).

    The mean squared distance to a cluster follows from its size, its centroid and its mean square, so no pairs are formed.
    A point alone in its cluster counts as 0.
    """
    norm = sum(F.pow(F.col(c), 2) for c in columns)
    sums = df.groupBy(F.col(cluster).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"), *[F.avg(c).alias(f"m_{c}") for c in columns])
    held = sums.agg(F.collect_list(F.struct("*")).alias("_all"))  # one row, some dozen clusters
    far = lambda x: norm - 2 * sum(F.col(c) * x[f"m_{c}"] for c in columns) + x["q"]
    points = df.crossJoin(F.broadcast(held))
    own = F.element_at(F.filter("_all", lambda x: x["k"] == F.col(cluster)), 1)
    points = points.withColumn("_own", own).withColumn("_b", F.array_min(F.transform(F.filter("_all", lambda x: x["k"] != F.col(cluster)), far)))
    points = points.withColumn("_a", far(F.col("_own")) * F.col("_own.n") / F.nullif(F.col("_own.n") - 1, F.lit(0)))
    s = F.when(F.col("_own.n") == 1, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0)))
    both = points.select(F.explode(F.array(F.col(cluster), F.lit(None))).alias("cluster"), s.alias("_s"))
    return both.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_s"), 6).alias("silhouette"))


def label_agreement(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """For each group: rows, the share with equal labels, and the adjusted Rand index, from the table of label pairs."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    table = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    both = table.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_same"), F.sum(pairs("n")).alias("_both"))
    for label, name in ((a, "_a"), (b, "_b")):
        margin = table.groupBy(*by, label).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs("n")).alias(name))
        both = both.join(margin, list(by))
    chance = F.col("_a") * F.col("_b") / F.nullif(pairs("n_rows"), F.lit(0.0))
    most = (F.col("_a") + F.col("_b")) / 2
    ari = F.when(most == chance, 1.0).otherwise((F.col("_both") - chance) / (most - chance))
    return both.select(*by, "n_rows", F.round(F.col("_same") / F.col("n_rows"), 6).alias("retention"), F.round(ari, 6).alias("adjusted_rand"))


def kmeans_segments(df: DataFrame, columns: Sequence[str], k: int, seeds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The best of several k-means runs, labels ordered along the first principal component of the centroids."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    models = [KMeans(featuresCol="_v", predictionCol="_p", k=k, seed=s, initSteps=5).fit(vectors) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(best.clusterCenters())], ["_p", *columns])
    flat = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(centres)
    first = PCA(k=1, inputCol="_v", outputCol="_pc").fit(flat).transform(flat).select("_p", vector_to_array("_pc")[0].alias("_x"), *columns)
    # The sign of a component is free: let the centroid with the largest first feature lie above.
    sign = first.orderBy(F.desc(columns[0])).limit(1).select(F.when(F.col("_x") < first.agg(F.avg("_x")).first()[0], -1).otherwise(1).alias("_s"))
    labels = first.crossJoin(sign).withColumn("segment", F.row_number().over(Window.orderBy(F.col("_x") * F.col("_s"))) - 1).select("_p", "segment")
    return best.transform(vectors).join(F.broadcast(labels), "_p").drop("_v", "_p")

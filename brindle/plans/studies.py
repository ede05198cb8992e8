"""Studies that keep what they decide: a frozen model selection, segments over the number of clusters, stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import clusters, selection, ward
from brindle.operators import summaries as A
from brindle.plans.analytics import _FEATURES, _SCALED, _latest, forecast_models
from brindle.plans.catalog import register
from brindle.plans.datasets import CELL, ds01
from brindle.plans.io_streams import shared_folder
from brindle.sources import roles
from brindle.sources.roles import oracle
from brindle.sources.runs import RunStore

SIMPLEST_FIRST = ("trailing_week", "ridge", "poisson", "boosted")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@register("fc05_frozen_selection")
def fc05(spark: SparkSession, d: str) -> DataFrame:
    """Candidates fitted on the first 60 percent of the calendar and selected by their error up to 80; the frozen winner and the baseline
    are then judged on the rest, which the selection never saw.  A week lies between the parts."""
    folder = shared_folder(spark)
    numbers = ("lag_1", "lag_7", "rolling_mean_7d", "rolling_std_7d", "scheduled_price")
    known = ds01(spark, d).filter("target_complete").select("d", *CELL, F.col("target_units_next_7d").cast("double").alias("y"), *[F.col(c).cast("double") for c in numbers], F.coalesce(F.col("sales_velocity_7d").cast("double"), F.lit(0.0)).alias("trailing_week"))
    frame = _written(known, f"{folder}/frame")
    first, second = (F.lit(roles.split_day(spark, d, share)).cast("date") for share in (0.6, 0.8))
    parts = {
        "train": frame.filter(F.col("d") <= first),
        "validation": frame.filter((F.col("d") > F.date_add(first, 7)) & (F.col("d") <= second)),
        "test": frame.filter(F.col("d") > F.date_add(second, 7)),
    }
    models = {name: pipeline.fit(parts["train"]) for name, pipeline in forecast_models(frame).items()}
    scored = lambda name, part: parts[part].withColumn("p", F.col("trailing_week")) if name == "trailing_week" else models[name].transform(parts[part]).withColumn("p", F.greatest("p", F.lit(0.0)))
    measures = lambda name, part: scored(name, part).agg(F.lit(part).alias("part"), F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"), *A.error_metrics(F.col("y"), F.col("p")))
    judged = [measures(name, "validation") for name in SIMPLEST_FIRST]
    errors = {row["model"]: row["wape"] for part in judged for row in part.collect()}
    held = {k: parts[k] for k in ("train", "validation")}
    selection.freeze(spark, f"{folder}/selection", {m: float("inf") if e is None else e for m, e in errors.items()}, SIMPLEST_FIRST, held)
    winner = selection.load(spark, f"{folder}/selection", held)["selected"]
    out = judged[0]
    for more in [*judged[1:], *(measures(name, "test") for name in dict.fromkeys(("trailing_week", winner)))]:
        out = out.unionByName(more)
    return out.withColumn("selected", F.col("model") == winner)


@register("sg03_ward_by_k")
def sg03_ward(spark: SparkSession, d: str) -> DataFrame:
    """Ward segments of the latest stores for two to five clusters: sizes, silhouette, and how many stores had the same segment a month
    earlier, by the nearest of the latest centroids."""
    folder, ks = shared_folder(spark), (2, 3, 4, 5)
    latest = _written(_latest(spark, d).select("store_id", *_FEATURES), f"{folder}/latest")
    labelled = _written(ward.ward_labels(clusters.robust_scale(latest, _FEATURES, fit=latest).select("store_id", *_SCALED), _SCALED, ks), f"{folder}/labelled")
    before = _written(clusters.robust_scale(_latest(spark, d, 1).select("store_id", *_FEATURES), _FEATURES, fit=latest).select("store_id", *_SCALED), f"{folder}/before")
    out = None
    for k in ks:
        mine = labelled.filter(F.col(f"ward_{k}").isNotNull()).withColumnRenamed(f"ward_{k}", "cluster")
        sizes = mine.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.lit(k).alias("k"), F.sum("n").alias("n_stores"), F.min("n").alias("smallest"))
        whole = clusters.silhouette(mine, "cluster", _SCALED).filter("cluster is null").select(F.lit(k).alias("k"), "silhouette")
        centres = mine.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in _SCALED])
        earlier = clusters.nearest_centroid(before, centres, ["store_id"], _SCALED).select("store_id", F.col("cluster").alias("a"))
        kept = clusters.label_agreement(earlier.join(mine.select("store_id", F.col("cluster").alias("b")), "store_id").withColumn("k", F.lit(k)), "a", "b", ["k"])
        row = sizes.join(F.broadcast(whole), "k").join(F.broadcast(kept.withColumnRenamed("n_rows", "n_both")), "k", "left")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@register("snk06_run_store", oracle("SELECT region_name, sum(units)::BIGINT AS units, count(*) AS n_lines, 2 AS run_number, 2 AS n_runs, (SELECT count(DISTINCT region_name) FROM sales) AS n_rows FROM sales GROUP BY 1", "sales"))
def snk06(spark: SparkSession, d: str) -> DataFrame:
    """Two stored runs and one that fails on the way: the latest is the second, and of the third nothing is left."""
    folder = shared_folder(spark)
    store = RunStore(spark, f"{folder}/runs")
    # Six tables are saved from it, so the joins of the sales are run once.
    regions = _written(roles.sales(spark, d).groupBy("region_name").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("n_lines")), f"{folder}/regions")
    for _ in range(2):
        store.save("regions", {"by_region": regions, "total": regions.agg(F.sum("units").alias("units"))})
    try:
        store.save("regions", {"by_region": regions, "broken": regions.withColumn("units", F.raise_error(F.lit("planned")))})
    except Exception as problem:
        if "planned" not in str(problem):
            raise
    facts = store.facts("regions")
    return store.load("regions", "by_region").select("*", F.lit(store.latest("regions")).alias("run_number"), F.lit(len(store.list("regions"))).alias("n_runs"), F.lit(facts["rows"]["by_region"]).cast("long").alias("n_rows"))

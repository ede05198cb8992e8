"""Aggregations with more than one step: profiles, quantile rules, correlations, error metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.sequences import running_sums


def quantiles(df: DataFrame, column: str, wanted: Sequence[float], buckets: int = 4096) -> list[float]:
    """Exact linear quantiles without one task that sees all values.

    Values are counted in equal buckets between the extremes (a bounded table), and only the few buckets that hold a wanted
    rank are put in order, each by itself.  Null and NaN values do not count; without values the quantiles are null.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).first()
    if not ends["n"]:
        return [None] * len(wanted)
    step = (ends["high"] - ends["low"]) / buckets or 1.0
    placed = x.withColumn("b", F.least(F.floor((F.col("x") - ends["low"]) / step), F.lit(buckets - 1)))
    below, before = 0, {}
    for r in sorted(placed.groupBy("b").count().collect(), key=lambda r: r["b"]):
        before[r["b"]] = (below, r["count"])
        below += r["count"]
    ranks = {int(k) for q in wanted for k in ((ends["n"] - 1) * q // 1, min((ends["n"] - 1) * q // 1 + 1, ends["n"] - 1))}
    places = [(b, k - start, k) for k in sorted(ranks) for b, (start, n) in before.items() if start <= k < start + n]
    offsets = df.sparkSession.createDataFrame(places, "b long, r long, k long")
    counted = placed.join(F.broadcast(offsets.select("b").distinct()), "b").groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    spans = counted.withColumn("end", F.sum("n").over(upto))
    hit = spans.join(F.broadcast(offsets), "b").filter("r < end and r >= end - n").select("k", "x").collect()
    at = {r["k"]: r["x"] for r in hit}
    out = []
    for q in wanted:
        rank = (ends["n"] - 1) * q
        low, high = at[int(rank // 1)], at[int(min(rank // 1 + 1, ends["n"] - 1))]
        out.append(low + (high - low) * (rank - rank // 1))
    return out


def group_quantiles(df: DataFrame, keys: Sequence[str], column: str, wanted: Mapping[str, float], buckets: int = 4096) -> DataFrame:
    """Exact linear quantiles (name: share) of each key.  Values are counted first, and counts are added up over ``buckets`` equal parts of
    the values' range, so neither the rows nor the different values of a key meet in one task.

    Null and NaN values do not count; a key without values has no row.  Infinite values are refused.
    """
    counts = df.select(*keys, F.col(column).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("_x").alias("low"), F.max("_x").alias("high")).first()
    span = (ends["high"] - ends["low"]) if ends["low"] is not None else 0.0
    if not math.isfinite(span):
        raise ValueError("quantiles of infinite values")
    summed = running_sums(counts, keys, "_x", ["n"], buckets / span if span else 1.0)
    ranked = summed.join(counts.groupBy(*keys).agg(F.sum("n").alias("_all")), list(keys))
    at = lambda rank: F.max(F.when((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")), F.col("_x")))
    out = []
    for name, q in wanted.items():
        rank = (F.col("_all") - 1) * q
        low, part = at(F.floor(rank)), F.max(rank - F.floor(rank))
        out.append((low + (at(F.ceil(rank)) - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, linear quantiles, population skew.  Quantiles by buckets, as above."""
    measures = []
    for c in columns:
        x = F.col(c).cast("double")
        q = F.array(*[F.lit(v).cast("double") for v in quantiles(df, c, (0.25, 0.5, 0.75, 0.95))])
        measures.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), q.alias("q"), F.max(x).alias("high"), F.skewness(x).alias("skew")).alias(c))
    flat = df.agg(*measures).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("s")).select("s.*")
    r = lambda c: F.round(c, 6)
    return flat.select("column_name", "n", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "low", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95"))], "high", r(F.col("skew")).alias("skew"))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: rows, nulls, and distinct values, null being one."""
    out = []
    for c in columns:
        out.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias("n_unique")).alias(f"_{c}"))
    return df.agg(*out).select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("s")).select("s.*")


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column, by count, then value; one job for all columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    counts = long.groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), F.col("value").asc_nulls_last())))
    return ranked.filter(F.col("_r") <= k).drop("_r")


def error_metrics(y: Column, p: Column) -> list[Column]:
    """WAPE (null where all y are zero), MAE, RMSE and signed bias, as aggregates."""
    e = p - y
    return [
        F.round(F.sum(F.abs(e)) / F.nullif(F.sum(F.abs(y)), F.lit(0)), 6).alias("wape"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.sum(e) / F.nullif(F.sum(F.abs(y)), F.lit(0)), 6).alias("bias"),
    ]


def sliced(df: DataFrame, dimensions: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """``measures`` for every value of every dimension, in one job: rows are listed once a dimension."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.withColumn("_slice", F.explode(pairs)).groupBy("_slice.dimension", "_slice.value").agg(F.count(F.lit(1)).alias("n_rows"), *measures)


def tukey_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: the quartiles and how many values lie beyond the fences."""
    low, high = quantiles(df, column, [0.25, 0.75])
    wide = (high - low) * factor if low is not None else None
    beyond = F.lit(False) if low is None else (F.col(column) < low - wide) | (F.col(column) > high + wide)
    return df.agg(F.lit(low).cast("double").alias("q1"), F.lit(high).cast("double").alias("q3"), F.count_if(beyond).alias("n_outliers"))


def weighted_quantiles(counts: DataFrame, value: str, weight: str, quantiles: Sequence[float], buckets: int = 4096) -> DataFrame:
    """The smallest value whose cumulative weight reaches each quantile of all weight.  ``counts``: one row a value.

    Weights are added up in equal buckets between the extremes (a bounded table), then within each bucket.
    """
    ends = counts.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, step = float(ends["low"] or 0), (float(ends["high"] or 0) - float(ends["low"] or 0)) / buckets or 1.0
    placed = counts.withColumn("_b", F.least(F.floor((F.col(value) - low) / step), F.lit(buckets - 1)))
    below, offsets = 0, []
    for r in sorted(placed.groupBy("_b").agg(F.sum(weight).alias("w")).collect(), key=lambda r: r["_b"]):
        offsets.append((r["_b"], below))
        below += r["w"]
    before = counts.sparkSession.createDataFrame(offsets, "_b long, _before long")
    upto = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cumulative = placed.join(F.broadcast(before), "_b").withColumn("_c", F.col("_before") + F.sum(weight).over(upto))
    wanted = cumulative.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).filter(F.col("_c") >= F.col("q") * below)
    return wanted.groupBy("q").agg(F.min(value).alias("quantile_value"))


def moment_skew(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """mean((x - m)**3) / s**3 with the sample deviation s."""
    m = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    third = df.join(m, list(keys)).groupBy(*keys).agg(F.avg(F.pow(F.col(column) - F.col("_m"), 3)).alias("_t"), F.first("_s").alias("_s"))
    return third.select(*keys, F.round(F.col("_t") / F.nullif(F.pow("_s", F.lit(3)), F.lit(0.0)), 6).alias("moment_skew"))

"""Operators over ordered rows of an entity, all by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_days(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Adds the days since the entity's row before."""
    return df.withColumn("gap_days", F.datediff(date, F.lag(date).over(Window.partitionBy(*keys).orderBy(date))))


def episodes(df: DataFrame, keys: Sequence[str], date: str, level: str) -> DataFrame:
    """Stockout episodes: a level at or below zero after one above (or at the start) opens, the first later one above closes.

    Duration is recovery less start, or, right-censored, last day less start plus one.
    """
    ordered = Window.partitionBy(*keys).orderBy(date)
    whole = Window.partitionBy(*keys)
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    marked = df.select(
        *keys, date, level,
        F.lag(level).over(ordered).alias("_before"),
        F.min(F.when(F.col(level) > 0, F.col(date))).over(later).alias("recovery_date"),
        F.max(date).over(whole).alias("_last"),
    )
    starts = marked.filter((F.col(level) <= 0) & (F.coalesce("_before", F.lit(1)) > 0))
    duration = F.when(F.col("recovery_date").isNotNull(), F.datediff("recovery_date", date)).otherwise(F.datediff("_last", date) + 1)
    return starts.select(*keys, F.col(date).alias("episode_start"), "recovery_date", duration.alias("duration_days"), F.col("recovery_date").isNull().alias("right_censored"))


def runs(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Maximal runs of consecutive days of an entity: run_start, run_end, run_days."""
    ordered = Window.partitionBy(*keys).orderBy(date)
    new = (F.datediff(date, F.lag(date).over(ordered)) != 1).cast("int")
    numbered = df.select(*keys, date).distinct().withColumn("_new", F.coalesce(new, F.lit(1)))
    numbered = numbered.withColumn("_run", F.sum("_new").over(ordered))
    return numbered.groupBy(*keys, "_run").agg(F.min(date).alias("run_start"), F.max(date).alias("run_end"), F.count(date).alias("run_days")).drop("_run")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of every key in ``order``."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def percent_rank(keys: Sequence[str], value: Column) -> Column:
    """Average rank of ties over the number of rows."""
    whole = Window.partitionBy(*keys)
    return (F.rank().over(whole.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2) / F.count(F.lit(1)).over(whole)


def running_sums(counts: DataFrame, by: Sequence[str], order: str, values: Sequence[str], width: float, descending: bool = False) -> DataFrame:
    """Adds ``cum_<value>``, the sum up to and with each row in ``order``, without sorting a key in one task.

    ``counts`` has one row for each (by, order).  Rows are put in buckets of ``1 / width`` of ``order``; the sums of whole
    buckets are added up over the buckets, those within a bucket over its rows.
    """
    direction = F.desc if descending else F.asc
    held = counts.withColumn("_bucket", F.floor(F.col(order) * width))
    whole = held.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_all_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_at"), *[F.coalesce(F.sum(f"_all_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in values])
    same = held["_bucket"].eqNullSafe(offsets["_at"])
    for c in by:
        same = same & held[c].eqNullSafe(offsets[f"_by_{c}"])
    within = Window.partitionBy(*by, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(offsets, same).withColumns({f"cum_{v}": F.sum(v).over(within) + F.col(f"_off_{v}") for v in values})
    return out.select(*counts.columns, *[f"cum_{v}" for v in values])


def value_ranks(df: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """(value, pct_rank): the average rank of each distinct value over the number of rows, from counts of values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    ranked = running_sums(counts, [], value, ["_n"], width).crossJoin(F.broadcast(total))
    return ranked.select(value, ((F.col("cum__n") - (F.col("_n") - 1) / 2) / F.col("_total")).alias("pct_rank"))


def rank_shares(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Adds ``share``, the average rank of ties over the rows of the key, ``n_below`` and ``n_all``, its rows below and in all.

    Rows are first counted by value, so no task sorts the rows of a key; ``width`` as in :func:`running_sums`.  Rows with a null key
    or value are left out.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).filter(F.col(value).isNotNull())
    summed = running_sums(counts, keys, value, ["n"], width).select(*keys, value, "n", (F.col("cum_n") - F.col("n")).alias("n_below"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    ranks = summed.join(whole, list(keys)).withColumn("share", (F.col("n_below") + (F.col("n") + 1) / 2) / F.col("n_all"))
    return df.join(ranks.drop("n"), [*keys, value])


def places(df: DataFrame, keys: Sequence[str], order: str, width: float) -> DataFrame:
    """Adds ``place``, from 1 in each key, by a column that is unique in it; sorted by buckets as in :func:`running_sums`."""
    counts = df.select(*keys, order, F.lit(1).cast("long").alias("place"))
    return df.join(running_sums(counts, keys, order, ["place"], width).select(*keys, order, F.col("cum_place").alias("place")), [*keys, order])


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: int) -> DataFrame:
    """About ``wanted`` rows of each key, spread evenly over its order."""
    ordered, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    step = F.greatest(F.floor(F.count(F.lit(1)).over(whole) / wanted), F.lit(1))
    marked = df.withColumn("_n", F.row_number().over(ordered) - 1).withColumn("_step", step)
    return marked.filter((F.col("_n") % F.col("_step") == 0) & (F.col("_n") / F.col("_step") < wanted)).drop("_n", "_step")


def kaplan_meier(subjects: DataFrame, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Survival after each duration.  Subjects are first counted by duration, so windows see a few rows a stratum."""
    counts = subjects.groupBy(*by, F.col(duration).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at_risk = F.sum("n").over(Window.partitionBy(*by)) - F.coalesce(F.sum("n").over(before), F.lit(0))
    table = counts.withColumn("at_risk", at_risk).withColumn("_p", 1 - F.col("events") / F.col("at_risk"))
    # A factor of zero ends all survival; the product of the others is a sum of logarithms.
    logs = F.sum(F.when(F.col("_p") > 0, F.log("_p")).otherwise(0.0)).over(upto)
    dead = F.max((F.col("_p") <= 0).cast("int")).over(upto)
    return table.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(logs))).drop("_p")

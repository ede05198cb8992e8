"""Price schedules, and statistics of donor tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.summaries import group_quantiles


def weekly_prices(bases: DataFrame, days: DataFrame, key: str, base: str) -> DataFrame:
    """A price for every ``key`` and week of the calendar ``days``, both ends of its validity inclusive; each third week 10 %
    lower, in cents."""
    ends = days.agg(F.min("d").alias("low"), F.max("d").alias("high"))
    weeks = ends.select(F.posexplode(F.expr("sequence(low, high, interval 7 days)")).alias("week", "valid_from"))  # one row a week
    price = F.when(F.col("week") % 3 == 2, F.floor(F.col(base) * 90) / 100).otherwise(F.floor(F.col(base) * 100) / 100)
    return bases.crossJoin(F.broadcast(weeks)).select(key, "valid_from", F.date_add("valid_from", 6).alias("valid_to"), price.alias("price"))


def donor_statistics(df: DataFrame, group: str, value: str, flag: str, price: str) -> DataFrame:
    """For each group: share of flagged rows and of rows above zero, quantiles of the values, mean of price over its top."""
    ratio = F.avg(price) / F.nullif(F.max(price), F.lit(0.0))
    facts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(flag).cast("int")), 6).alias("flag_rate"), F.round(F.avg((F.col(value) > 0).cast("int")), 6).alias("nonzero_rate"), F.round(ratio, 6).alias("price_ratio"))
    return facts.join(group_quantiles(df, [group], value, {"p50": 0.5, "p90": 0.9}), group, "left").select(group, "n", "flag_rate", "nonzero_rate", "p50", "p90", "price_ratio")

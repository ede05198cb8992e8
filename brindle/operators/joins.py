"""Temporal joins.  Each carries an equality on its keys, so plans hash or sort on the keys and test ranges as a residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day(date: Column | str) -> Column:
    """Days since 1970, the order of calendar range frames."""
    return F.unix_date(F.col(date) if isinstance(date, str) else date)


def days_window(keys: Sequence[str], date: str, first: int, last: int):
    """Rows of the same keys whose calendar day lies ``first``..``last`` days away (negative: before)."""
    return Window.partitionBy(*keys).orderBy(day(date)).rangeBetween(first, last)


def validity_join(left: DataFrame, right: DataFrame, keys: Sequence[str], date: str, start: str = "valid_from", end: str = "valid_to", how: str = "left", bucket_days: int = 32) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` whose inclusive interval holds the date.

    Intervals are listed under every ``bucket_days`` bucket they touch, so the join is an equality on keys and bucket and
    a long history of intervals of one key does not meet all its dates.
    """
    bucket = lambda c: F.floor(day(c) / bucket_days)
    held = right.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    mine = left.withColumn("_bucket", bucket(date))
    on = [mine[k].eqNullSafe(held[k]) for k in keys] + [mine["_bucket"] == held["_bucket"], mine[date].between(held[start], held[end])]
    rest = [held[c] for c in right.columns if c not in keys]
    return mine.join(held, on, how).select(*[mine[c] for c in left.columns], *rest)


def lag_days(df: DataFrame, keys: Sequence[str], date: str, value: str, offsets: Sequence[int], prefix: str = "lag_") -> DataFrame:
    """``value`` exactly so many calendar days before; null where that day has no row.  One window pass for all offsets."""
    return df.withColumns({f"{prefix}{k}": F.max(value).over(days_window(keys, date, -k, -k)) for k in offsets})


def expand_days(df: DataFrame, start: Column, end: Column, name: str = "calendar_date") -> DataFrame:
    """One row for each day from ``start`` to ``end``."""
    return df.withColumn(name, F.explode(F.sequence(start, end)))


def overlaps(df: DataFrame, keys: Sequence[str], row_id: str, start: str, end: str, bucket_days: int = 32) -> DataFrame:
    """Pairs (low, high) of rows of one key whose inclusive intervals share a day; none for null bounds or keys.

    Intervals are listed under the buckets of days that they touch, and a pair is found in the bucket where the later of the two
    starts, once.  So rows of one key that lie far apart never meet.  Ends are cut at the last start of all, which no overlap needs
    to pass, so open intervals are listed no further than the data go.
    """
    bucket = lambda c: F.floor(day(c) / bucket_days)
    known = df.select(*keys, F.col(row_id).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_s is not null and _e is not null")
    last = known.agg(F.max("_s").alias("_last"))  # one row
    cut = known.crossJoin(F.broadcast(last)).withColumn("_e", F.least("_e", "_last"))
    held = cut.withColumn("_bucket", F.explode(F.sequence(bucket("_s"), bucket("_e"))))
    a = held.select(*keys, "_bucket", F.col("_id").alias("low_id"), F.col("_s").alias("_s1"), F.col("_e").alias("_e1"))
    b = held.select(*keys, "_bucket", F.col("_id").alias("high_id"), F.col("_s").alias("_s2"), F.col("_e").alias("_e2"))
    met = a.join(b, [*keys, "_bucket"]).filter("low_id < high_id and _s1 <= _e2 and _s2 <= _e1")
    return met.filter(F.col("_bucket") == bucket(F.greatest("_s1", "_s2"))).select(*keys, "low_id", "high_id")


def with_episode(events: DataFrame, episodes: DataFrame, keys: Sequence[str], date: str, start: str = "episode_start", recovery: str = "recovery_date", bucket_days: int = 64) -> DataFrame:
    """``events`` with ``start`` and ``recovery`` of the episode that holds them (start <= date, and no recovery yet or date <
    recovery), null where none does.  The episodes of one key must not overlap, as stockout episodes cannot.

    As-of membership by a sorted union: the starts and the events of a key lie in one order, and each event takes the last start
    before it.  Ended episodes are listed under the buckets of days that they touch, so that the order is of a key and a bucket and no
    event meets more than one episode; a key has one open episode at most, which is joined by key.  Events with null keys or
    dates lie in none.
    """
    known = F.col(start).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    e = episodes.select(*keys, start, recovery).filter(known)
    number = lambda c: F.floor(day(c) / bucket_days)
    begin = F.date_from_unix_date((F.col("_bucket") * bucket_days).cast("int"))
    ended = e.filter(F.col(recovery) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(number(F.col(start)), number(F.date_sub(recovery, 1)))))
    held = F.struct(F.col(start).alias("s"), F.col(recovery).alias("r"))
    marks = ended.select(*keys, "_bucket", F.greatest(F.col(start), begin).alias("_at"), F.lit(0).alias("_kind"), held.alias("_e"), F.lit(None).cast(events.schema).alias("_row"))
    mine = events.select(*keys, number(F.col(date)).alias("_bucket"), F.col(date).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_e"].dataType).alias("_e"), F.struct(*events.columns).alias("_row"))
    order = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.unionByName(mine).withColumn("_e", F.last("_e", ignorenulls=True).over(order)).filter("_kind = 1")
    open_ones = e.filter(F.col(recovery).isNull()).select(*keys, F.col(start).alias("_open"))
    both = last.select("_row.*", "_e").join(open_ones, list(keys), "left")
    inside = F.col(date) < F.col("_e.r")
    at = F.when(inside, F.col("_e.s")).when(F.col("_open") <= F.col(date), F.col("_open"))
    return both.select(*events.columns, at.alias(start), F.when(inside, F.col("_e.r")).alias(recovery))


def in_episode(events: DataFrame, episodes: DataFrame, keys: Sequence[str], date: str, start: str = "episode_start", recovery: str = "recovery_date") -> DataFrame:
    """The events that an episode holds, with its start and recovery; see :func:`with_episode`."""
    return with_episode(events, episodes, keys, date, start, recovery).filter(F.col(start).isNotNull())


def in_one_episode(events: DataFrame, episodes: DataFrame, keys: Sequence[str], date: str, start: str = "episode_start", recovery: str = "recovery_date") -> DataFrame:
    """Events with their episode, refusing events that lie in no episode or in several, also where episodes overlap."""
    last = events.agg(F.max(date)).first()[0]
    ended = F.coalesce(F.date_sub(recovery, 1), F.greatest(F.col(start), F.lit(last)))
    held = episodes.select(*keys, start, recovery, ended.alias("_end")).filter(F.col("_end") >= F.col(start))
    joined = validity_join(events, held, keys, date, start, "_end", "inner").drop("_end")
    several = not joined.groupBy(*keys, date).count().filter("count > 1").isEmpty()
    if several or not events.join(joined.select(*keys, date), [*keys, date], "left_anti").isEmpty():
        raise ValueError("an event lies in several episodes" if several else "an event lies in no episode")
    return joined


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key, not null, has no parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def item_pairs(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b) with a < b for every two different items of a group, by way of the group's distinct items.

    A group is one basket; its items are distinct ids of one order, so arrays stay short.
    """
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    first = sets.select(group, "_items", F.posexplode("_items").alias("_i", "a"))
    return first.select(group, "a", F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("b"))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join that refuses duplicate keys on either side."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"duplicate keys on the {name} side")
    return left.join(right, list(keys), how)

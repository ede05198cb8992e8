"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / weight`` (u from a hash of its id, weight from its text's quality); smaller keys go
first.  A source's target is met by complete epochs of all its documents, then by the documents with the smallest keys up
to the budget that is left, the last one if at least half of it fits.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating; together they get 150 % of all words.  A target
stops at twice its source's size and the excess is shared again by weight among the others.

The budget's end is found without sorting a source: words are summed in bins of the key, then in bins of the bin where the
budget ends, and only the one of these where it ends is put in order, some 16 millionth of a source.  A null text has no words; documents without words are never taken.  A null id draws its key from the
text.  Rows that are alike in source, id, key and size stand or fall together.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpoint, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BINS = 4096
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of characters that are not markup symbols."""
    bare = F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.when(F.length(text) > 0, 0.25 + 0.75 * bare / F.length(text)).otherwise(0.25)


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, prefix: str = "", seed: str = SEED) -> DataFrame:
    """``docs`` with the columns size, key, tie and bin, their names behind ``prefix``."""
    text = F.col(text_col)
    tie = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    unit = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), tie).cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    key = -F.log(unit) / quality_weight(text)
    out = docs.withColumns({f"{prefix}size": words_in(text), f"{prefix}tie": tie, f"{prefix}key": key})
    # The mean of the keys' distributions for four weights: no bin holds much more than its share of a source.
    spread = sum(F.exp(-w * F.col(f"{prefix}key")) for w in (0.25, 0.5, 0.75, 1.0)) / 4
    return out.withColumn(f"{prefix}bin", F.least(F.floor((1 - spread) * BINS), F.lit(BINS - 1)).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from the sizes of the sources (one row each)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), place + 1))
    weighed = weighed.withColumn("full", F.when(F.col("w") > 0, EPOCHS * F.col("source_size") / F.col("w")))
    upward = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped, capped_w = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    level = (SHARE * F.sum("source_size").over(every) - EPOCHS * capped) / (F.sum("w").over(every) - capped_w)
    levels = weighed.withColumn("level", level).withColumn("at", F.row_number().over(upward))
    right = F.min(F.when(F.col("level") <= F.col("full"), F.struct("at", "level"))).over(every)["level"]
    target = F.least(F.lit(float(EPOCHS)) * F.col("source_size"), right * F.col("w"))
    return levels.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "target")


def _ends(bins: DataFrame, goals: DataFrame) -> DataFrame:
    """cut_source, cut_bin, below: the bin of a source where its ``rest`` ends, and the words before that bin.

    ``bins``: source, bin, words.  ``goals``: source, rest, and below, the words before the first bin.
    """
    in_order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.withColumn("sum", F.sum("words").over(in_order)).join(_sized(goals.select("source", "rest", F.col("below").alias("start"))), F.expr("goal_source <=> source"))
    ends = summed.withColumn("upto", F.col("start") + F.col("sum")).filter("upto >= rest and rest > 0")
    first = ends.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"))).alias("e"))
    return first.select(F.col("source").alias("cut_source"), F.col("e.bin").alias("cut_bin"), F.col("e.below").alias("below"))


def plan(rows: DataFrame) -> DataFrame:
    """For each source: target, epochs, the bin where the rest of the budget ends, and the last (key, tie, size) taken.

    ``rows``: source, size, key, tie, bin of every document.
    """
    bins = checkpoint(rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high")))
    goals = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs.cast("long"))
    goals = checkpoint(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    cuts = _ends(bins.select("source", "bin", "words"), goals.withColumn("below", F.lit(0)))
    spans = bins.join(cuts, F.expr("cut_source <=> source and cut_bin = bin")).select("source", "cut_bin", "below", "low", "high")
    spans = checkpoint(spans.join(_sized(goals.select("source", "rest")), F.expr("goal_source <=> source")).drop("goal_source"))
    # That bin again in bins, between its own extremes.  Rows that are alike stand or fall together, so they are one row.
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).otherwise(0)
    inside = rows.join(_sized(spans), F.expr("goal_source <=> source and bin = cut_bin"))
    inside = inside.groupBy("source", F.least(place, F.lit(BINS - 1)).cast("int").alias("bin"), "key", "tie", "size").agg(F.sum("size").alias("words"))
    inside = checkpoint(inside)
    finer = checkpoint(_ends(inside.groupBy("source", "bin").agg(F.sum("words").alias("words")), spans))
    last_bin = inside.join(_sized(spans.select("source", "rest")), F.expr("goal_source <=> source")).drop("goal_source")
    last_bin = last_bin.join(_sized(finer.withColumnRenamed("cut_source", "source")), F.expr("goal_source <=> source and bin = cut_bin"))
    walk = Window.partitionBy("source").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.sum("words").over(walk) - F.col("words") + F.col("below")
    taken = last_bin.withColumn("begin", begin).filter("begin + size / 2 <= rest")
    taken = taken.select("source", "key", "tie", "size").unionByName(_before(inside, finer))
    last = taken.groupBy("source").agg(F.max(F.struct("key", "tie", "size")).alias("last")).withColumnRenamed("source", "last_source")
    goals = goals.join(spans.select(F.col("source").alias("cut_source"), "cut_bin", "below"), F.expr("cut_source <=> source"), "left").drop("cut_source")
    return checkpoint(goals.join(last, F.expr("last_source <=> source"), "left").drop("last_source"))


def _before(inside: DataFrame, finer: DataFrame) -> DataFrame:
    """The rows in the finer bins before the one where the budget ends."""
    ends = finer.select(F.col("cut_source").alias("source"), "cut_bin")
    return inside.join(_sized(ends), F.expr("goal_source <=> source and bin < cut_bin")).select("source", "key", "tie", "size")


def _sized(goals: DataFrame, most: int = 10_000) -> DataFrame:
    """The per-source table for a join: broadcast if it has at most ``most`` rows, else left to the optimiser."""
    named = goals.withColumnRenamed("source", "goal_source")
    return F.broadcast(named) if goals.limit(most + 1).count() <= most else named


def copies(prefix: str = "", goal: str = "") -> Column:
    """How often a document is taken, from its keyed columns and its source's plan (names behind the prefixes)."""
    mine = F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("key", "tie", "size")])
    bin_, cut = F.col(f"{prefix}bin"), F.col(f"{goal}cut_bin")
    part = (bin_ < cut) | ((bin_ == cut) & F.coalesce(mine <= F.col(f"{goal}last"), F.lit(False)))
    return F.col(f"{goal}epochs") + F.coalesce(part, F.lit(False)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies x size) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = checkpoint(keyed(rows, "doc_id", "text", "source", seed=seed).drop("text"))
    mixed = rows.join(_sized(plan(rows.drop("doc_id"))), F.expr("goal_source <=> source")).withColumn("copies", copies())
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"), (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies`` (in the place of a column of that name)."""
    mine, theirs = fresh(docs, "_mix_"), fresh(docs, "_goal_")
    own = keyed(docs, id_col, text_col, source_col, mine, seed)
    rows = checkpoint(own.select(F.col(source_col).alias("source"), *[F.col(f"{mine}{c}").alias(c) for c in ("size", "key", "tie", "bin")]))
    goals = _sized(plan(rows)).select(*[F.col(c).alias(f"{theirs}{c}") for c in ("goal_source", "epochs", "cut_bin", "last")])
    joined = own.join(goals, F.col(f"{theirs}goal_source").eqNullSafe(F.col(source_col)))
    taken = joined.drop("copies").withColumn("copies", copies(mine, theirs))
    return taken.filter((F.col("copies") > 0) & (F.col(f"{mine}size") > 0)).select(*[c for c in docs.columns if c.lower() != "copies"], "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS tie,
         CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * length(regexp_replace(text, '[#*$%&|<>!]+', '', 'g')) / length(text)::DOUBLE ELSE 0.25::DOUBLE END AS weight
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || tie), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496::DOUBLE) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (SELECT *, 2 * source_size / w::DOUBLE AS full_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER u, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER u, 0))::DOUBLE AS level
  FROM f WINDOW u AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1)),
t AS (
  SELECT source, source_size, least(2 * source_size::DOUBLE, lv.level * w) AS target,
         CASE WHEN source_size > 0 THEN floor(least(2 * source_size::DOUBLE, lv.level * w) / source_size) ELSE 0 END::BIGINT AS epochs
  FROM l, lv),
r AS (
  SELECT k.*, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, tie, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, epochs + (cum - size / 2::DOUBLE <= rest AND rest > 0)::BIGINT AS copies FROM r)
SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN copies ELSE 0 END AS copies, (copies * size)::BIGINT AS taken FROM c
"""

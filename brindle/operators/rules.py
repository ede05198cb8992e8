"""Association rules between two items, their stability over time, and the same by frequent-pattern growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.joins import item_pairs
from brindle.operators.sequences import value_ranks


def pair_rules(rows: DataFrame, group: str, item: str, support: float, confidence: float, lift: float) -> DataFrame:
    """Rules a -> b of single items, from exact counts; ids are hashes of the canonical text."""
    present = rows.select(group, item).distinct()
    total = present.agg(F.count_distinct(group).alias("n_groups"))  # one row
    singles = present.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    pairs = item_pairs(rows, group, item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    both = pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "n_both").unionByName(pairs.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "n_both"))
    counted = both.join(singles.select(F.col(item).alias("antecedent"), F.col("n").alias("n_a")), "antecedent").join(singles.select(F.col(item).alias("consequent"), F.col("n").alias("n_b")), "consequent").crossJoin(F.broadcast(total))
    n = F.col("n_groups")
    rules = counted.select(
        "antecedent", "consequent", "n_both", (F.col("n_both") / n).alias("support"), (F.col("n_both") / F.col("n_a")).alias("confidence"), (F.col("n_both") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.substring(F.sha2(F.concat(F.col("antecedent").cast("string"), F.lit("->"), F.col("consequent").cast("string")), 256), 1, 16).alias("rule_id"),
    )
    return rules.filter((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def rules_by_period(rows: DataFrame, rules: DataFrame, group: str, item: str, period: str) -> DataFrame:
    """Support and confidence of each rule in each period, from the pairs that occur in it."""
    sizes = rows.select(group, period).distinct().groupBy(period).agg(F.count(F.lit(1)).alias("n_groups"))
    singles = rows.select(group, period, item).distinct().groupBy(period, F.col(item).alias("antecedent")).agg(F.count(F.lit(1)).alias("n_a"))
    periods = rows.select(group, period).distinct()
    pairs = item_pairs(rows, group, item).join(periods, group).groupBy(period, "a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    wanted = rules.select("rule_id", "antecedent", "consequent", F.least("antecedent", "consequent").alias("a"), F.greatest("antecedent", "consequent").alias("b"))
    # Every rule in every period: a few periods, so the product is the result's own size.
    cells = wanted.crossJoin(F.broadcast(sizes))
    found = cells.join(pairs, [period, "a", "b"], "left").join(singles, [period, "antecedent"], "left")
    n = F.coalesce("n_both", F.lit(0))
    return found.select("rule_id", period, F.round(n / F.col("n_groups"), 9).alias("period_support"), F.round(n / F.nullif(F.coalesce("n_a", F.lit(0)), F.lit(0)), 9).alias("period_confidence"))


def stability(by_period: DataFrame, value: str = "period_support", periods: int = 3, most: float = 0.25) -> DataFrame:
    """STABLE: seen in enough periods with a low coefficient of variation; SPARSE: in too few; else VARIABLE."""
    seen = by_period.groupBy("rule_id").agg(F.count_if(F.col(value) > 0).alias("n_periods"), F.round(F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0)), 6).alias("variation"))
    return seen.withColumn("stability", F.when(F.col("n_periods") < periods, "SPARSE").when(F.col("variation") <= most, "STABLE").otherwise("VARIABLE"))


def frequent_itemsets(rows: DataFrame, group: str, item: str, support: float, longest: int = 2) -> DataFrame:
    """Itemsets by FP-growth: items (sorted, joined by a bar) and frequency."""
    baskets = rows.groupBy(group).agg(F.collect_set(F.col(item).cast("string")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(baskets)
    found = model.freqItemsets.filter(F.size("items") <= longest)
    return found.select(F.array_join(F.array_sort("items"), "|").alias("itemset"), F.col("freq").alias("n"))


def counted_itemsets(rows: DataFrame, group: str, item: str, support: float) -> DataFrame:
    """The same up to two items, by counting."""
    present = rows.select(group, F.col(item).cast("string").alias("i")).distinct()
    n = present.agg(F.count_distinct(group).alias("n_groups"))
    singles = present.groupBy(F.col("i").alias("itemset")).agg(F.count(F.lit(1)).alias("n"))
    pairs = item_pairs(present, group, "i").groupBy(F.concat_ws("|", "a", "b").alias("itemset")).agg(F.count(F.lit(1)).alias("n"))
    return singles.unionByName(pairs).crossJoin(F.broadcast(n)).filter(F.col("n") >= F.col("n_groups") * support).select("itemset", "n")


def review_rank(df: DataFrame, *scores: str, k: int) -> DataFrame:
    """The ``k`` rows with the highest sum of percent ranks; ties by the row's first columns."""
    ranked, total = df, F.lit(0.0)
    for s in scores:
        own = value_ranks(df, s).select(F.col(s).alias(f"_v_{s}"), F.col("pct_rank").alias(f"_r_{s}"))
        ranked = ranked.join(own, F.col(s) == F.col(f"_v_{s}"))
        total = total + F.col(f"_r_{s}")
    out = ranked.withColumn("review_score", F.round(total, 9)).select(*df.columns, "review_score")
    return out.orderBy(F.desc("review_score"), *df.columns[:3]).limit(k)

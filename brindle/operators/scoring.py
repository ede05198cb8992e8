"""Exact ranking metrics, calibration and thresholds over (label, score) rows.

Scores are first counted, one row a distinct score; running sums go over buckets of scores and then within each bucket, so
no stratum is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.sequences import running_sums
from brindle.operators.summaries import quantiles

#: Buckets of scores between zero and one.
BUCKETS = 4096


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """For each distinct score: positives, negatives, and how many of each score at least as high."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    whole = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    table = running_sums(counts, by, "score", ["pos", "neg"], BUCKETS, descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    return table.join(whole, list(by)) if by else table.crossJoin(F.broadcast(whole))  # without strata one row


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC-AUC with ties at one half, Brier score and prevalence."""
    t = score_table(df, label, score, by)
    s, y = F.col("score"), F.col("pos")
    ap = F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp")))
    above = F.col("all_neg") - F.col("fp") + F.col("neg") / 2
    auc = F.sum(F.col("pos") * above) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))
    brier = F.sum(y * (1 - s) * (1 - s) + F.col("neg") * s * s) / F.sum(y + F.col("neg"))
    return t.groupBy(*by).agg(F.sum(y + F.col("neg")).alias("n"), F.round(ap, 6).alias("average_precision"), F.round(auc, 6).alias("roc_auc"), F.round(brier, 6).alias("brier"), F.round(F.sum(y) / F.sum(y + F.col("neg")), 6).alias("prevalence"))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision, recall, false-positive rate and F1 at every distinct score used as threshold."""
    t = score_table(df, label, score)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos"))
    return t.select(F.col("score").alias("threshold"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.col("fp") / F.nullif(F.col("all_neg"), F.lit(0)), 6).alias("fpr"), F.round(f1, 6).alias("f1"))


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold of the highest F1, the lowest among equals."""
    return curve(df, label, score).orderBy(F.desc("f1"), "threshold").limit(1)


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    y, said = F.col(label) == 1, F.col(score) >= threshold
    tp, fp, fn, tn = (F.count_if(c) for c in (y & said, ~y & said, y & ~said, ~y & ~said))
    r = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 8) -> DataFrame:
    """Mean score and observed rate in bins between the score's quantiles."""
    edges = F.array(*[F.lit(e) for e in quantiles(df, score, [k / bins for k in range(1, bins)])])
    binned = df.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(score))))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(label).cast("double")), 6).alias("observed_rate"))


def concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's C: over pairs of an event and a longer follow-up, the share with the higher risk on the event's side.

    Rows are first counted by (duration, event, risk); pairs run over these counts, joined on equal event durations.
    """
    counts = df.groupBy(F.col(duration).alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    times = counts.filter("e = 1").select(F.col("t").alias("at")).distinct()
    later = counts.join(F.broadcast(times), F.col("t") >= F.col("at")).filter("t > at or e = 0").select("at", F.col("r").alias("r2"), F.col("n").alias("n2"))
    by_risk = later.groupBy("at", "r2").agg(F.sum("n2").alias("n2"))
    pairs = counts.filter("e = 1").join(by_risk, F.col("t") == F.col("at"))
    w = F.col("n") * F.col("n2")
    won = F.sum(w * F.when(F.col("r") > F.col("r2"), 1.0).when(F.col("r") == F.col("r2"), 0.5).otherwise(0.0))
    return pairs.agg(F.sum(w).alias("n_pairs"), F.round(won / F.nullif(F.sum(w), F.lit(0)), 6).alias("c_index"))


def horizon_brier(df: DataFrame, duration: str, event: str, survival: str, horizon: int) -> DataFrame:
    """Brier score of survival beyond the horizon; null if a row is censored before it."""
    early = F.count_if(~F.col(event) & (F.col(duration) < horizon))
    alive = (~(F.col(event) & (F.col(duration) <= horizon))).cast("double")
    return df.agg(F.lit(horizon).alias("horizon"), early.alias("n_early_censored"), F.when(early == 0, F.round(F.avg(F.pow(alive - F.col(survival), 2)), 6)).alias("brier"))

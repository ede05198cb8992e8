"""Literal cases of the analytical operators."""

import math

import pytest
from pyspark.sql import functions as F

from brindle.operators import clusters, cox, forest, rules, scoring, selection
from brindle.operators import summaries as A
from brindle.plans import analytics


def test_error_metrics(spark):
    r = spark.createDataFrame([(1, 2), (3, 1)], "y int, p int").agg(*A.error_metrics(F.col("y"), F.col("p"))).first()
    assert (r.wape, r.mae, r.bias) == (0.75, 1.5, -0.25)
    assert spark.createDataFrame([(0, 2)], "y int, p int").agg(*A.error_metrics(F.col("y"), F.col("p"))).first().wape is None


def test_ranking_metrics_and_threshold(spark):
    r = scoring.ranking_metrics(spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, p double"), "y", "p").first()
    assert (r.average_precision, r.brier, r.roc_auc) == (1.0, 0.01, 1.0)
    best = scoring.best_threshold(spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.5), (1, 0.9)], "y int, p double"), "y", "p").first()
    assert (best.threshold, best.f1) == (0.5, 1.0)


def test_auc_counts_ties_half(spark):
    r = scoring.ranking_metrics(spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double"), "y", "p").first()
    assert r.roc_auc == 0.5


def test_concordance_and_horizon(spark):
    df = spark.createDataFrame([(1, True, 3.0), (2, True, 2.0), (3, True, 1.0)], "t int, e boolean, r double")
    assert scoring.concordance(df, "t", "e", "r").first().c_index == 1.0
    early = spark.createDataFrame([(2, False, 0.5), (5, True, 0.5)], "t int, e boolean, s double")
    r = scoring.horizon_brier(early, "t", "e", "s", 3).first()
    assert (r.n_early_censored, r.brier) == (1, None)


def test_pair_rules(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "o int, i int")
    got = {(r.antecedent, r.consequent): (r.n_both, round(r.support, 6), round(r.confidence, 6), round(r.lift, 6)) for r in rules.pair_rules(rows, "o", "i", 0.1, 0.1, 0.5).collect()}
    assert got == {(1, 2): (2, 0.666667, 0.666667, 1.0), (2, 1): (2, 0.666667, 1.0, 1.0)}


def test_itemsets_agree_by_both_ways(spark):
    rows = spark.range(400).select((F.col("id") % 90).alias("o"), (F.col("id") * 7 % 11).cast("string").alias("i"))
    a, b = rules.frequent_itemsets(rows, "o", "i", 0.05), rules.counted_itemsets(rows, "o", "i", 0.05)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() > 10


def test_stability_labels(spark):
    rows = [("a", 0.1), ("a", 0.1), ("a", 0.11), ("b", 0.1), ("b", 0.0), ("b", 0.2), ("c", 0.1), ("c", 0.5), ("c", 0.9)]
    got = {r.rule_id: r.stability for r in rules.stability(spark.createDataFrame(rows, "rule_id string, period_support double")).collect()}
    assert got == {"a": "STABLE", "b": "SPARSE", "c": "VARIABLE"}


def test_z_policy_with_zero_variance(spark):
    rows = [(f"2024-01-0{i}", 1, "x", u) for i, u in enumerate([2, 2, 2, 9], start=1)]
    df = spark.createDataFrame(rows, "d string, cell_id int, category string, event_units int").withColumn("d", F.to_date("d"))
    got = analytics.z_scores(df).orderBy("d").collect()
    assert [r.scorable for r in got] == [False, False, True, True] and got[2].direction == "NONE" and got[3].direction == "HIGH"


def test_robust_scaling_has_median_zero(spark):
    df = spark.range(101).select(F.pow("id", F.lit(2)).alias("x"), F.lit(5.0).alias("y"))
    r = clusters.robust_scale(df, ["x", "y"]).agg(F.percentile("x_scaled", F.lit(0.5)), F.max("y_scaled")).first()
    assert tuple(r) == (0.0, 0.0)


def test_model_selection_prefers_the_simpler():
    assert selection.select_model({"a": 1.004, "b": 1.0}, ("a", "b")) == "a"
    assert selection.select_model({"a": 1.01, "b": 1.0}, ("a", "b")) == "b"


def test_isolation_forest_finds_the_far_point(spark):
    df = spark.range(500).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y")).unionByName(spark.createDataFrame([(500.0, -90.0)], "x double, y double"))
    out = forest.isolation_scores(df, ["x", "y"], contamination=0.01)
    assert out.orderBy(F.desc("anomaly_score")).first().x == 500.0
    assert out.filter("is_anomaly").count() <= 6


@pytest.mark.parametrize("hot", [5.0, 6.0, 7.0])
def test_isolation_forest_samples_all_rows(spark, hot):
    # A third of all rows are one point, which must be in every tree as such.
    df = spark.range(30_000, numPartitions=5).select("id", *(F.when(F.col("id") % 3 == 0, hot).otherwise(F.rand(k)).alias(c) for k, c in enumerate("xy"))).cache()
    score = {r.h: r.s for r in forest.isolation_scores(df, ["x", "y"]).groupBy((F.col("id") % 3 == 0).alias("h")).agg(F.avg("anomaly_score").alias("s")).collect()}
    assert abs(score[True] - score[False]) < 0.05, score


def test_isolation_samples(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 3 > 0).cast("double").alias("x"))
    rows, size = forest.draw(df, ["x"], 20, 256, 7, ["id"])
    by_tree = {}
    for r in rows.collect():
        by_tree.setdefault(r.tree, []).append((r.turn, r.x))
    firsts = [sorted(by_tree[k])[:256] for k in range(20)]
    assert size == 256 and all(len(x) == 256 for x in firsts) and len({tuple(x) for x in firsts}) == 20
    assert all(0.5 < sum(v for _, v in x) / 256 < 0.8 for x in firsts)
    other, _ = forest.draw(df.repartition(7), ["x"], 20, 256, 7, ["id"])
    assert sorted(other.collect()) == sorted(rows.collect())


def test_cox_recovers_the_direction(spark):
    df = spark.range(600).select(((F.col("id") * 37) % 10 / 10).alias("x"), F.col("id")).withColumn("t", F.greatest(F.lit(1), (7 - F.col("x") * 5 + (F.col("id") * 13) % 3).cast("int"))).withColumn("e", F.col("id") % 5 != 0)
    beta = cox.fit_cox(df, "t", "e", ["x"])
    assert beta[0] > 1
    surv = cox.baseline_survival(df, "t", "e", ["x"], beta)
    values = [surv[t] for t in sorted(surv)]
    assert all(0 <= b <= a <= 1 for a, b in zip(values, values[1:]))


def test_kmeans_is_stable(spark):
    df = spark.range(60).select((F.col("id") % 3 * 10 + F.col("id") / 100).alias("a"), (F.col("id") % 3 * 5.0).alias("b"))
    a = clusters.kmeans_segments(df, ["a", "b"], 3).orderBy("a", "b").collect()
    assert a == clusters.kmeans_segments(df, ["a", "b"], 3).orderBy("a", "b").collect() and [r.segment for r in a] == sorted(r.segment for r in a)


@pytest.mark.parametrize("value,n", [(6, 0), (100, 1)])
def test_tukey(spark, value, n):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, value)], "x double")
    assert A.tukey_outliers(df, "x").first().n_outliers == n


def efron(rows, beta):
    """Efron's log likelihood, written out."""
    total = 0.0
    for t in {t for t, e, *_ in rows if e}:
        weight = lambda x: math.exp(sum(b * v for b, v in zip(beta, x)))
        dead = [x for s, e, *x in rows if s == t and e]
        at_risk, tied = sum(weight(x) for s, _, *x in rows if s >= t), sum(weight(x) for x in dead)
        total += sum(math.log(weight(x)) for x in dead) - sum(math.log(at_risk - k / len(dead) * tied) for k in range(len(dead)))
    return total - 0.05 * sum(b * b for b in beta)


def test_cox_is_at_the_top_of_efrons_likelihood(spark):
    rows = [(1 + i * 7 % 4, i % 3 != 0, (i * 37 % 10) / 10, (i * i % 7) / 7) for i in range(80)]
    df = spark.createDataFrame(rows, "t int, e boolean, a double, b double")
    beta, h = list(cox.fit_cox(df, "t", "e", ["a", "b"], penalty=0.1)), 1e-4
    for j in range(2):
        up, down = [b + h * (i == j) for i, b in enumerate(beta)], [b - h * (i == j) for i, b in enumerate(beta)]
        assert efron(rows, up) - efron(rows, down) == pytest.approx(0, abs=1e-7)
    tests = cox.proportionality(df, "t", "e", ["a", "b"], beta)
    assert all(n == sum(e for _, e, *_ in rows) and s >= 0 and 0 <= p <= 1 for _, n, s, p in tests)
    none = spark.createDataFrame([(1, False, 0.1, 0.2)], "t int, e boolean, a double, b double")
    assert list(cox.fit_cox(none, "t", "e", ["a", "b"])) == [0, 0] and cox.proportionality(none, "t", "e", ["a", "b"], [0, 0])[0][1] == 0


def test_inverse_sums_agree_beyond_the_direct_range():
    for a, d in ((10_500.5, 10_400), (30_000.0, 30_000), (1e6, 20_000)):
        x = [1 / (a - k) for k in range(d)]
        assert cox._inverse_sums(a, d) == pytest.approx((sum(x), sum(v * v for v in x)), rel=1e-9)


def test_proportionality_finds_a_trend(spark):
    # The effect of x turns its sign with time.
    rows = [(t, True, 1.0 if (i % 10 < 8) == (t <= 4) else 0.0) for t in range(1, 9) for i in range(40)]
    df = spark.createDataFrame(rows, "t int, e boolean, x double")
    (_, _, statistic, p), = cox.proportionality(df, "t", "e", ["x"], cox.fit_cox(df, "t", "e", ["x"]))
    assert statistic > 10 and p < 0.01


def test_lone_points_and_equal_labels(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 9.0)], "k int, x double")
    got = {r.cluster: (r.n, r.silhouette) for r in clusters.silhouette(df, "k", ["x"]).collect()}
    assert got[1] == (1, 0.0) and got[0] == (2, pytest.approx(((81 - 4) / 81 + (49 - 4) / 49) / 2, abs=1e-6)) and got[None][0] == 3
    same = spark.createDataFrame([("d", 1, 1), ("d", 2, 2), ("d", 2, 2)], "g string, a int, b int")
    assert clusters.label_agreement(same, "a", "b", ["g"]).first()[1:] == (3, 1.0, 1.0)

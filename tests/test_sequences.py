"""Literal cases and properties of the operators over ordered rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import joins as J
from brindle.operators import sequences as W

D = date(2024, 1, 1)


def day(n):
    return D + timedelta(days=n)


def test_episodes_close_or_stay_open(spark):
    rows = [(1, day(i), x) for i, x in enumerate([3, 0, 0, 2, 0, 0])]
    got = W.episodes(spark.createDataFrame(rows, "k int, d date, available int"), ["k"], "d", "available").orderBy("episode_start").collect()
    assert [(r.duration_days, r.right_censored) for r in got] == [(2, False), (2, True)]


def test_episode_at_the_first_row_counts(spark):
    got = W.episodes(spark.createDataFrame([(1, day(0), 0), (1, day(1), 5)], "k int, d date, available int"), ["k"], "d", "available").collect()
    assert [(r.episode_start, r.recovery_date) for r in got] == [(day(0), day(1))]


def test_runs_split_at_gaps(spark):
    rows = [(1, day(0)), (1, day(1)), (1, day(3)), (2, day(3))]
    got = {(r.k, r.run_start, r.run_end, r.run_days) for r in W.runs(spark.createDataFrame(rows, "k int, d date"), ["k"], "d").collect()}
    assert got == {(1, day(0), day(1), 2), (1, day(3), day(3), 1), (2, day(3), day(3), 1)}


def test_lags_go_by_calendar_not_by_row(spark):
    rows = [(1, day(0), 5), (1, day(2), 7), (1, day(3), 9)]
    got = {r.d: (r.lag_1, r.lag_2) for r in J.lag_days(spark.createDataFrame(rows, "k int, d date, x int"), ["k"], "d", "x", (1, 2)).collect()}
    assert got == {day(0): (None, None), day(2): (None, 5), day(3): (7, None)}


def test_windows_look_strictly_back(spark):
    rows = [(1, day(i), x) for i, x in enumerate([1, 3, 100, 5])]
    df = spark.createDataFrame(rows, "k int, d date, x int")
    mean = [r.m for r in df.withColumn("m", F.avg("x").over(J.days_window(["k"], "d", -7, -1))).orderBy("d").collect()]
    assert mean[:3] == [None, 1, 2]


def test_validity_join_takes_both_ends_and_spans_buckets(spark):
    left = spark.createDataFrame([(1, day(n)) for n in (0, 40, 99, 100, 101)], "k int, d date")
    right = spark.createDataFrame([(1, day(0), day(99), 1.0), (1, day(100), day(100), 2.0)], "k int, valid_from date, valid_to date, price double")
    got = {r.d: r.price for r in J.validity_join(left, right, ["k"], "d").collect()}
    assert got == {day(0): 1.0, day(40): 1.0, day(99): 1.0, day(100): 2.0, day(101): None}


def test_overlaps_and_episode_membership(spark):
    df = spark.createDataFrame([(1, "a", day(0), day(3)), (2, "a", day(3), day(5)), (3, "a", day(6), day(7)), (4, "b", day(0), day(9))], "id int, k string, s date, e date")
    assert [(r.low_id, r.high_id) for r in J.overlaps(df, ["k"], "id", "s", "e").collect()] == [(1, 2)]
    episodes = spark.createDataFrame([(1, day(2), day(4)), (1, day(8), None)], "k int, episode_start date, recovery_date date")
    events = spark.createDataFrame([(1, day(n)) for n in (1, 2, 3, 4, 9)], "k int, d date")
    assert sorted(r.d for r in J.in_episode(events, episodes, ["k"], "d").collect()) == [day(2), day(3), day(9)]


def test_item_pairs_count_each_pair_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (3, 3), (3, 1), (3, 2)], "o int, i int")
    assert sorted((r.o, r.a, r.b) for r in J.item_pairs(df, "o", "i").collect()) == [(1, 1, 2), (3, 1, 2), (3, 1, 3), (3, 2, 3)]


def test_one_to_one_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        J.one_to_one(df, df.select("k"), ["k"])


def test_kaplan_meier(spark):
    rows = [(1, True), (2, True), (2, False), (3, True)]
    got = {r.t: (r.at_risk, round(r.survival, 6)) for r in W.kaplan_meier(spark.createDataFrame(rows, "t int, e boolean"), "t", "e").collect()}
    assert got == {1: (4, 0.75), 2: (3, 0.5), 3: (1, 0.0)}


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 4)], "x int")
    assert sorted(r.p for r in df.select(W.percent_rank([], F.col("x")).alias("p")).collect()) == [0.25, 0.625, 0.625, 1.0]


def test_plans_of_range_joins_have_no_cartesian_product(spark):
    left = spark.range(100).select((F.col("id") % 5).alias("k"), F.date_add(F.lit(D), F.col("id").cast("int")).alias("d"))
    right = left.select("k", F.col("d").alias("valid_from"), F.date_add("d", 3).alias("valid_to"))
    plan = J.validity_join(left, right, ["k"], "d")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_running_sums_over_buckets_equal_plain_ones(spark):
    rows = [(k, ((i * 37) % 101) / 101, i % 5) for k in ("a", None) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    for down in (False, True):
        got = {(r.k, r.x): r.cum_n for r in W.running_sums(df, ["k"], "x", ["n"], 16, down).collect()}
        assert len(got) == 202
        for (k, x), total in got.items():
            assert total == sum(n for q, y, n in rows if q == k and (y >= x if down else y <= x))


def test_exact_quantiles(spark):
    from brindle.operators.summaries import quantiles

    for values in ([1.0], [1.0, 2.0], [5.0] * 9, [float(x * x % 97) for x in range(500)], [-3.0, 0.0, 1e9]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        want = df.filter("not isnan(x)").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.75), F.lit(1.0)))).first()[0]
        assert quantiles(df, "x", [0.1, 0.5, 0.75, 1.0], buckets=8) == pytest.approx(want)
    assert quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_events_must_lie_in_one_episode(spark):
    episodes = spark.createDataFrame([(1, day(2), day(4)), (1, day(3), None)], "k int, episode_start date, recovery_date date")
    for n, ok in ((2, True), (3, False), (0, False)):
        events = spark.createDataFrame([(1, day(n))], "k int, d date")
        if ok:
            assert J.in_one_episode(events, episodes, ["k"], "d").count() == 1
        else:
            with pytest.raises(ValueError):
                J.in_one_episode(events, episodes, ["k"], "d")


def test_frames_compare_with_repeats(spark):
    from brindle.operators import sets

    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    r = sets.differences(a, a.distinct().unionByName(spark.createDataFrame([(3, "y")], "k int, v string"))).first()
    assert tuple(r) == (1, 1)
    train = spark.createDataFrame([(1, "E1"), (2, None), (3, "E2")], "k int, g string")
    assert sorted(x.k for x in sets.purge_shared(train, spark.createDataFrame([("E1",)], "g string"), "g").collect()) == [2, 3]


def test_episode_membership_as_by_brute_force(spark):
    import random

    rng = random.Random(8)
    episodes, events = [], []
    for k in range(6):
        at = rng.randint(-400, 0)
        while at < 600:
            length = rng.choice([0, 1, 5, 63, 64, 65, 300])
            episodes.append((k, f"c{k % 2}", day(at), day(at + length)))
            at += length + rng.choice([0, 1, 30, 200])
        if k % 3 == 0:
            episodes.append((k, f"c{k % 2}", day(at), None))
    events = [(rng.randrange(7), f"c{rng.randrange(2)}", day(rng.randint(-450, 1200)), n) for n in range(2000)] + [(None, "c0", day(3), -1), (0, None, day(3), -2), (0, "c0", None, -3)]
    df = spark.createDataFrame(events, "k int, c string, d date, n int")
    ep = spark.createDataFrame(episodes + [(None, "c0", day(0), None)], "k int, c string, episode_start date, recovery_date date")
    want = set()
    for k, c, d, n in events:
        found = [(s, r) for a, b, s, r in episodes if (a, b) == (k, c) and d is not None and s <= d and (r is None or d < r)]
        assert len(found) < 2
        want.add((n, *(found[0] if found else (None, None))))
    got = J.with_episode(df, ep, ["k", "c"], "d")
    assert got.columns == ["k", "c", "d", "n", "episode_start", "recovery_date"]
    assert {(r.n, r.episode_start, r.recovery_date) for r in got.collect()} == want and got.count() == len(events)
    assert J.in_episode(df, ep, ["k", "c"], "d").count() == sum(s is not None for _, s, _ in want)


def test_overlaps_equal_all_pairs(spark):
    import random
    from datetime import date, timedelta

    r, first = random.Random(3), date(2020, 1, 1)
    rows = []
    for i in range(200):
        s = first + timedelta(r.randrange(2000))
        rows.append((i, r.choice(["a", "b", None]), s, r.choice([s, s + timedelta(r.randrange(300)), date(9999, 12, 31), None])))
    df = spark.createDataFrame(rows, "id int, k string, s date, e date")
    want = sorted((k, i, j) for i, k, s, e in rows for j, k2, s2, e2 in rows if k and k == k2 and i < j and e and e2 and s <= e2 and s2 <= e)
    assert sorted(map(tuple, J.overlaps(df, ["k"], "id", "s", "e").collect())) == want and len(want) > 100


def test_ranks_places_and_quantiles_by_buckets_equal_one_sort(spark):
    import random

    import numpy as np
    from brindle.operators import summaries as A

    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice([-7.5, 0.0, 2.25, *range(40)]) * 1.0, i) for i in range(500)] + [("c", 1.0, 500), ("c", None, 501)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    got = {q.i: q for q in W.places(W.rank_shares(df, ["k"], "x", 0.5), ["k", "x"], "i", 0.1).collect()}
    for k, x, i in rows:
        mine = [(y, j) for k2, y, j in rows if k2 == k and y is not None]
        if x is None:
            assert i not in got
            continue
        below, same = sum(y < x for y, _ in mine), sum(y == x for y, _ in mine)
        assert abs(got[i].share - (below + (same + 1) / 2) / len(mine)) < 1e-12 and (got[i].n_below, got[i].n_all) == (below, len(mine))
        assert got[i].place == sum(y == x and j <= i for y, j in mine)
    q = {g.k: (g.a, g.b) for g in A.group_quantiles(df, ["k"], "x", {"a": 0.5, "b": 0.9}, 16).collect()}
    for k in "abc":
        assert np.allclose(q[k], np.quantile([y for k2, y, _ in rows if k2 == k and y is not None], [0.5, 0.9]))
    assert A.group_quantiles(df.filter("i < 0"), ["k"], "x", {"a": 0.5}).count() == 0

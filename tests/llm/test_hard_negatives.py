import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import hard_negatives as hn

DDL = "vec_id long, embedding array<double>, label int, score int"


def brute(rows, n_pos=5, n_neg=3, low=50, high=95):
    ends = np.iinfo(np.int64)
    valid = []
    for i, v, label, _ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(valid):
        if i % 50:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(v, w)), ends.min), ends.max), j, x) for m, (j, w, x) in enumerate(valid) if m != n]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], s[1]))[:n_pos]:
            near = sorted((s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p), key=lambda s: (-s[0], s[1]))[:n_neg]
            out += [(i, j, r + 1, k, p, s) for r, (s, k, _) in enumerate(near)]
    return sorted(out)


def vectors(seed, n=600, scale=0.2):
    rng = random.Random(seed)
    # the label 3 holds a third; coarse components bring ties
    rows = [(i, [round(rng.gauss(0.1, scale), 1) for _ in range(8)], 3 if rng.random() < 0.33 else rng.randrange(10), i) for i in range(n)]
    odd = [(50, None, 1, 0), (100, [0.1, None], 1, 0), (150, [float("nan")] * 8, 1, 0), (200, [float("inf")] * 8, 1, 0), (None, [0.1] * 8, 1, 0), (250, [0.1] * 8, None, 0), (300, [], 3, 0), (350, [0.5, 0.5], 3, 0), (701, [0.5] * 12, 4, 0)]
    return rows[: n // 2] + odd + rows[n // 2 :] + rows[:120]  # repeated rows, anchors among them


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, DDL).repartition(5)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0, label_col=hn.noisy_label(), **options).collect())


@pytest.mark.parametrize("block", [8192, 4])
def test_as_by_brute_force(spark, block):
    rows = vectors(1)
    want = brute(rows)
    assert run(spark, rows, block=block) == want and len(want) > 100


def test_scores_that_take_several_digits(spark):
    rows = vectors(2, 300, 40.0)
    want = brute(rows)
    assert max(p for *_, p, _ in want) > 1 << 24
    assert run(spark, rows) == want


def test_huge_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1.0, 3e6, 1e9, -2e8, 1e300 if i == 60 else 0.5]) for _ in range(4)], i % 3, 0) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 1, 0)]) == []
    assert run(spark, [(50, [1.0], 1, 0), (51, [1.0], 1, 0)]) == []
    assert run(spark, [(50, [1.0], 1, 0), (51, [1.0], 1, 0), (52, [0.9], 2, 0)]) == [(50, 51, 1, 52, 65536, 58880)]


def test_best_of_groups():
    rng = np.random.default_rng(4)
    best, rows = hn.Best(5, 3), []
    for _ in range(20):
        g, s, i = rng.integers(0, 5, 30), rng.integers(-4, 4, 30), rng.integers(0, 1000, 30)
        best.add(g, s, i)
        rows += zip(g.tolist(), s.tolist(), i.tolist())
    want = [r for g in range(5) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:3]]
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist())) == want

"""Cox proportional hazards with few distinct durations: Newton steps on risk-set sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _risk(columns: Sequence[str], beta: Sequence[float]) -> Column:
    return F.exp(sum((F.col(c) * float(b) for c, b in zip(columns, beta)), F.lit(0.0)))


def _inverse_sums(a: float, d: int) -> tuple[float, float]:
    """The sums of 1 / (a - l) and of its square over l = 0 .. d - 1, where a >= d."""
    if d <= 10_000:
        x = 1.0 / (a - np.arange(d))
        return float(x.sum()), float((x * x).sum())

    def series(x: float) -> tuple[float, float]:  # digamma and trigamma
        first = second = 0.0
        while x < 12:
            first, second, x = first - 1 / x, second + 1 / x**2, x + 1
        return first + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4), second + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)

    (p1, q1), (p0, q0) = series(a + 1), series(a - d + 1)
    return float(p1 - p0), float(q0 - q1)


def _by_duration(df: DataFrame, duration: str, event: str, columns: Sequence[str], beta: np.ndarray) -> list[tuple]:
    """(duration, events, score, information) of every duration with an event, with Efron's treatment of ties.

    One aggregation to (distinct durations) x 2 (1 + p + p * p) sums, which is what reaches the driver.
    """
    p, w, at = len(columns), _risk(columns, beta), F.col(event)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.count_if(at).alias("d")] + [F.sum(F.when(at, F.col(c)).otherwise(0.0)).alias(f"x_{i}") for i, c in enumerate(columns)]
    for kind, mine in (("s", w), ("e", F.when(at, w).otherwise(0.0))):
        sums += [F.sum(mine).alias(f"{kind}0")] + [F.sum(mine * F.col(c)).alias(f"{kind}1_{i}") for i, c in enumerate(columns)]
        sums += [F.sum(mine * F.col(columns[i]) * F.col(columns[j])).alias(f"{kind}2_{i}_{j}") for i, j in upper]
    vector = lambda r, n: np.array([r[f"{n}_{i}"] for i in range(p)])
    matrix = lambda r, n: np.array([[r[f"{n}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    s0, s1, s2, out = 0.0, np.zeros(p), np.zeros((p, p)), []
    for r in sorted(df.groupBy(duration).agg(*sums).collect(), key=lambda r: -r[duration]):  # longest first: risk sets grow
        s0, s1, s2, d = s0 + r["s0"], s1 + vector(r, "s1"), s2 + matrix(r, "s2"), r["d"]
        if d:
            # The l-th tied event weighs the tied ones by 1 - l / d; its mean is m + rest / (its weight).
            m, square = vector(r, "e1") / r["e0"], matrix(r, "e2") / r["e0"]
            rest, rest2 = s1 - m * s0, s2 - square * s0
            h1, h2 = _inverse_sums(max(d * s0 / r["e0"], float(d)), d)
            h1, h2 = h1 * d / r["e0"], h2 * (d / r["e0"]) ** 2
            means = d * np.outer(m, m) + (np.outer(m, rest) + np.outer(rest, m)) * h1 + np.outer(rest, rest) * h2
            out.append((r[duration], d, vector(r, "x") - d * m - rest * h1, d * square + rest2 * h1 - means))
    return out


def fit_cox(df: DataFrame, duration: str, event: str, columns: Sequence[str], penalty: float = 0.1, steps: int = 12) -> np.ndarray:
    """Coefficients by Efron's likelihood with an L2 penalty, by Newton steps of one aggregation each."""
    p, beta = len(columns), np.zeros(len(columns))
    for _ in range(steps):
        parts = _by_duration(df, duration, event, columns, beta)
        g = sum((x[2] for x in parts), -penalty * beta)
        h = sum((x[3] for x in parts), penalty * np.eye(p))
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def proportionality(df: DataFrame, duration: str, event: str, columns: Sequence[str], beta: np.ndarray, penalty: float = 0.1) -> list[tuple[str, int, float, float]]:
    """(covariate, events, statistic, p) of the test that scaled Schoenfeld residuals have no trend in time.

    The statistic has one degree of freedom.  Only sums of residuals at each duration are needed.
    """
    parts = _by_duration(df, duration, event, columns, beta)
    n = sum(x[1] for x in parts)
    if not n:
        return [(c, 0, float("nan"), float("nan")) for c in columns]
    middle = sum(x[0] * x[1] for x in parts) / n
    spread = sum(x[1] * (x[0] - middle) ** 2 for x in parts)
    cover = np.linalg.inv(sum((x[3] for x in parts), penalty * np.eye(len(columns))))
    trend = n * cover @ sum((x[0] - middle) * x[2] for x in parts)
    out = []
    for j, c in enumerate(columns):
        value = float(trend[j] ** 2 / (n * cover[j, j] * spread)) if spread else float("nan")
        out.append((c, n, value, math.erfc(math.sqrt(value / 2)) if spread else float("nan")))
    return out


def baseline_survival(df: DataFrame, duration: str, event: str, columns: Sequence[str], beta: Sequence[float]) -> dict[int, float]:
    """Breslow baseline survival after each duration."""
    w = _risk(columns, beta)
    rows = sorted(df.groupBy(duration).agg(F.sum(w).alias("s0"), F.sum(F.col(event).cast("double")).alias("d")).collect(), key=lambda r: -r[duration])
    at_risk, steps = 0.0, []
    for r in rows:
        at_risk += r["s0"]
        steps.append((r[duration], r["d"] / at_risk))
    out, hazard = {}, 0.0
    for t, h in reversed(steps):
        hazard += h
        out[t] = float(np.exp(-hazard))
    return out


def add_risk(df: DataFrame, columns: Sequence[str], beta: Sequence[float], name: str = "risk") -> DataFrame:
    return df.withColumn(name, _risk(columns, beta))

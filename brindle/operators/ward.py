"""Ward's agglomerative clustering of any number of points, by way of a bounded tree of summaries.

Points become clustering features (number, sums), which merge by addition.  Where there are few different points, each is a
leaf and the result is exact; else leaves are the cells of a grid over all columns, and a coarser grid is made from the finer
one's summaries until ``most`` leaves are left, so the points are read once for all grids.  The leaves, at most ``most``, are then
merged on the driver along chains of nearest neighbours, the tree is cut at every number of clusters asked for, and the points get
their leaves' labels by a broadcast join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a column of the finest grid: 2 to this power.
FINEST = 20


def merges(centres: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, height) of each merge, by rising height; a merged cluster goes on under the smaller of its two numbers.

    Nearest-neighbour chains: two clusters that are each other's nearest are merged at once, which is what taking the nearest pair of
    all first would do in the end.  Ward's distance of two clusters follows from their centres and sizes.
    """
    c, n = centres.astype(float).copy(), sizes.astype(float).copy()
    alive, out, chain = np.ones(len(n), bool), [], []
    for _ in range(len(n) - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            far = n[a] * n / (n[a] + n) * ((c - c[a]) ** 2).sum(axis=1)
            far[~alive] = np.inf
            far[a] = np.inf
            b = int(far.argmin())
            if len(chain) > 1 and far[chain[-2]] <= far[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        low, high = min(a, b), max(a, b)
        out.append((low, high, float(far[b])))
        c[low] = (n[low] * c[low] + n[high] * c[high]) / (n[low] + n[high])
        n[low] += n[high]
        alive[high] = False
    # Chains find merges out of order; heights of one cluster only rise, so sorting keeps each merge behind those that it needs.
    return sorted(out, key=lambda m: m[2])


def cut(tree: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """The cluster of each of ``n`` leaves when ``k`` are left: the smallest leaf in it."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in tree[: max(n - k, 0)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def canonical(labels: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Labels 0, 1, .. along the first principal component of the leaves; the largest first column lies above."""
    middle = np.average(centres, axis=0, weights=sizes)
    _, _, axes = np.linalg.svd((centres - middle) * np.sqrt(sizes)[:, None], full_matrices=False)
    names = np.unique(labels)
    held = [labels == x for x in names]
    means = np.array([np.average(centres[h], axis=0, weights=sizes[h]) for h in held])
    at = (means - middle) @ axes[0]
    if at[means[:, 0].argmax()] < 0:
        at = -at
    place = np.empty(len(names), int)
    place[np.lexsort((names, np.round(at, 12)))] = np.arange(len(names))
    return place[np.searchsorted(names, labels)]


def leaves(points: DataFrame, columns: Sequence[str], most: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """``points`` with the columns that name its leaf, the leaves (those columns, n and sums), and the names."""
    names = [f"_leaf_{k}" for k in range(len(columns))]
    same = points.withColumns({name: F.col(c).cast("double") for name, c in zip(names, columns)})
    sums = lambda df: df.groupBy(*names).agg(F.sum("_n").alias("_n"), *[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(len(columns))])
    single = same.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)])
    if len(single.limit(most + 1).take(most + 1)) <= most:
        return same, single, names
    ends = points.agg(*[F.min(c).cast("double").alias(f"lo{k}") for k, c in enumerate(columns)], *[F.max(c).cast("double").alias(f"hi{k}") for k, c in enumerate(columns)]).first()
    steps = [((ends[f"hi{k}"] - ends[f"lo{k}"]) or 1.0) / (1 << FINEST) for k in range(len(columns))]
    cells = [F.least(F.floor((F.col(c) - ends[f"lo{k}"]) / steps[k]), F.lit((1 << FINEST) - 1)) for k, c in enumerate(columns)]
    finest = points.withColumns(dict(zip(names, cells)))
    grid = finest.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)]).persist()
    counts = grid.agg(*[F.count_distinct(*[F.shiftright(name, d) for name in names]).alias(f"d{d}") for d in range(FINEST + 1)]).first()
    level = next(d for d in range(FINEST + 1) if counts[f"d{d}"] <= most)
    coarse = {name: F.shiftright(name, level) for name in names}
    held = sums(grid.withColumns(coarse))
    return finest.withColumns(coarse), held, names


def ward_labels(points: DataFrame, columns: Sequence[str], ks: Sequence[int], most: int = 2000) -> DataFrame:
    """``points`` with the labels ``ward_<k>`` for each k; null where a column is null."""
    marked, summaries, names = leaves(points, columns, most)
    rows = summaries.orderBy(*names).collect()  # at most ``most``
    sizes = np.array([r["_n"] for r in rows], float)
    centres = np.array([[r[f"_s{k}"] / r["_n"] for k in range(len(columns))] for r in rows], float).reshape(len(rows), len(columns))
    tree = merges(centres, sizes)
    found = [canonical(cut(tree, len(rows), k), centres, sizes).tolist() if rows else [] for k in ks]
    held = [(*[r[name] for name in names], *[f[i] for f in found]) for i, r in enumerate(rows)]
    schema = ", ".join([f"{name} {marked.schema[name].dataType.simpleString()}" for name in names] + [f"ward_{k} int" for k in ks])
    labels = points.sparkSession.createDataFrame(held, schema)
    return marked.join(F.broadcast(labels), names, "left").drop(*names)

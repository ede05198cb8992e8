"""Isolation forest: each tree is grown in its own task on its own sample of all rows, and rows are scored where they are."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.summaries import quantiles

EULER = 0.5772156649015329


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A leaf (extra path length,), or (feature, cut, left, right)."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    if depth == 0 or len(x) <= 1 or not spread.any():
        return (_path(len(x)),)
    f = int(rng.choice(np.flatnonzero(spread)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    return f, cut, grow(x[low], rng, depth - 1), grow(x[~low], rng, depth - 1)


def flat(tree: tuple) -> tuple[np.ndarray, ...]:
    """feature, cut, left, right and extra path length of every node; a leaf leads to itself."""
    nodes: list[list] = []

    def add(node: tuple, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, depth + node[0] if len(node) == 1 else 0.0])
        if len(node) > 1:
            nodes[at][:2] = node[:2]
            nodes[at][2:4] = add(node[2], depth + 1), add(node[3], depth + 1)
        return at

    add(tree, 0)
    return tuple(np.array(x) for x in zip(*nodes))


def depths(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, length = tree
    rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    while True:
        step = np.where(x[rows, feature[at]] < cut[at], left[at], right[at])
        if (step == at).all():
            return length[at]
        at = step


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned longs, scattered."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def draw(df: DataFrame, columns: Sequence[str], trees: int, sample: int, seed: int, keys: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """(tree, turn, columns): rows drawn for each tree from all rows without nulls, and the rows a tree gets.

    Each row has a turn in each tree, a hash of its key (its place, where ``keys`` are none); a tree's sample are its first
    turns.  Only rows that may be among them are sent: so few that a tree lacks some with a chance under 1e-15.
    """
    key = F.xxhash64(*keys) if keys else F.monotonically_increasing_id()
    pool = df.select(*[F.col(c).cast("double") for c in columns], key.alias("_key")).dropna()
    n = pool.count()
    reach = np.uint64(min(1.0, (sample + 10 * np.sqrt(sample) + 50) / max(n, 1)) * (2**64 - 2048))
    salts = _mixed(np.arange(trees, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                ids = _mixed(batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64))
                turns = _mixed(ids[:, None] ^ salts[None, :])
                row, tree = np.nonzero(turns <= reach)
                picked = [batch.column(c).take(pa.array(row)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array((turns[row, tree] >> np.uint64(1)).astype(np.int64)), *picked], names=["tree", "turn", *columns])

    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("turn", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
    return pool.mapInArrow(run, schema), min(sample, n)


def isolation_scores(df: DataFrame, columns: Sequence[str], trees: int = 300, sample: int = 256, contamination: float = 0.02, seed: int = 7, keys: Sequence[str] | None = None) -> DataFrame:
    """``df`` with anomaly_score (higher: odder) and is_anomaly, the top ``contamination`` of all rows.

    Every tree has its own sample of all rows (see :func:`draw`); scoring is one pass; the cut is the exact quantile of all
    scores.  With ``keys``, columns that tell the rows apart, the trees do not depend on how the rows are dealt out.
    """
    drawn, size = draw(df, columns, trees, sample, seed, keys)
    size = max(size, 1)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["tree"].iloc[0])
        x = rows.sort_values(["turn", *columns]).head(size)[list(columns)].to_numpy(dtype=float)
        tree = grow(x, np.random.default_rng([seed, k]), int(np.ceil(np.log2(max(size, 2)))))
        return pd.DataFrame({"tree": [k], "model": [pickle.dumps(flat(tree))]})

    models = drawn.groupBy("tree").applyInPandas(one, "tree int, model binary").collect()
    grown = [pickle.loads(bytes(r["model"])) for r in sorted(models, key=lambda r: r["tree"])]
    shared = df.sparkSession.sparkContext.broadcast(grown)
    scale = _path(size) or 1.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            mean = sum(depths(t, x) for t in grown) / max(len(grown), 1) if grown else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(2.0 ** (-mean / scale), 9))], names=[*batch.schema.names, "anomaly_score"])

    scored = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("anomaly_score", T.DoubleType())]))
    scored = scored.persist()  # read for the cut and for the result
    cut = quantiles(scored, "anomaly_score", [1 - contamination])[0]
    return scored.withColumn("is_anomaly", F.lit(False) if cut is None else F.col("anomaly_score") > cut)

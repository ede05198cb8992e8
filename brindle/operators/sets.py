"""Comparisons of whole frames and of flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows, repeats counted, only the first and only the second frame has."""
    columns = sorted(a.columns)
    marked = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    net = marked.groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return net.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("n_only_first"), F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("n_only_second"))


def purge_shared(train: DataFrame, held_out: DataFrame, group: str) -> DataFrame:
    """Rows of ``train`` whose group does not occur in ``held_out``; rows without a group stay."""
    shared = held_out.select(group).filter(F.col(group).isNotNull()).distinct()
    return train.join(shared, group, "left_anti")


def jaccard(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return df.groupBy(*by).agg(both.alias("n_both"), either.alias("n_union"), F.round(both / F.nullif(either, F.lit(0)), 9).alias("jaccard"))

"""Dataset artifacts with metadata, published tables and a small store of runs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata(df: DataFrame, keys: Sequence[str], date_col: str | None, targets: Sequence[str] = ()) -> DataFrame:
    """One row: rows, columns, first and last day, duplicate keys, targets."""
    days = [F.lit(None).cast("string").alias("first_day"), F.lit(None).cast("string").alias("last_day")]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *([F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi")] if date_col else []))
    if date_col:
        days = [F.min("_lo").cast("string").alias("first_day"), F.max("_hi").cast("string").alias("last_day")]
    one = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicate_keys"), *days)
    return one.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_duplicate_keys", "first_day", "last_day", F.lit(",".join(targets)).alias("targets"))


def save_dataset(df: DataFrame, path: str, keys: Sequence[str], date_col: str | None = None, targets: Sequence[str] = (), version: str = "v1") -> dict:
    """Write Parquet (zstd) and its metadata beside it, both by Spark, so any file system serves."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    facts = metadata(df.sparkSession.read.parquet(path), keys, date_col, targets).first().asDict()
    facts |= {"version": version, "keys": list(keys), "schema": json.loads(df.schema.json())}
    save_document(df.sparkSession, facts, f"{path}.metadata")
    return facts


def save_document(spark: SparkSession, body: Mapping, path: str) -> None:
    spark.createDataFrame([(json.dumps(body, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def flat_row(spark: SparkSession, body: Mapping) -> DataFrame:
    """A document as one row; nested values become JSON text."""
    row = {k: json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else v for k, v in body.items()}
    return spark.createDataFrame([row])


def publish(tables: Mapping[str, DataFrame], core: str, database: str | None = None) -> DataFrame:
    """Replace ``<core>_<key>`` tables; the manifest of tables and row counts."""
    rows, spark = [], None
    for key, df in tables.items():
        spark = df.sparkSession
        name = f"{database + '.' if database else ''}{core}_{key}"
        df.write.mode("overwrite").saveAsTable(name)
        rows.append((core, name, spark.table(name).count()))
    return spark.createDataFrame(rows, "core string, table_name string, row_count long")

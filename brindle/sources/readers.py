"""Typed readers: files by suffix, mapped columns, bounded scans, pages and keyed lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def read_source(spark: SparkSession, source: DataFrame | str | Sequence[Mapping], schema: T.StructType | None = None) -> DataFrame:
    """A frame as it is, records of one key set, or a CSV, JSON or Parquet path.  CSV and JSON need a schema."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        keys = {frozenset(r) for r in source}
        if len(keys) > 1:
            raise SourceError("MISSING_FEATURE", "records differ in their keys")
        return spark.createDataFrame([dict(r) for r in source], schema)
    suffix = source.rstrip("/").rpartition(".")[2].lower()
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(source)
    if suffix in ("csv", "json"):
        if schema is None:
            raise SourceError("INVALID_SOURCE", f"{suffix} needs a schema")
        reader = spark.read.schema(schema)
        return reader.csv(source, header=True, nullValue="") if suffix == "csv" else reader.json(source)
    raise SourceError("INVALID_SOURCE", f"unknown suffix {suffix}")


def mapped(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Exactly the mapped columns under their new names."""
    missing = sorted(set(mapping) - set(df.columns))
    if missing:
        raise SourceError("MISSING_COLUMN", ", ".join(missing))
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns as null."""

    def tidy(c: str) -> Column:
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)

    return df.select(*[tidy(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int, most: int = 500) -> DataFrame:
    """Rows ``offset``.. in a total order, at most ``most`` of them."""
    if offset < 0 or not 0 < limit <= most:
        raise SourceError("INVALID_PAGE", f"offset {offset}, limit {limit}")
    return df.orderBy(*order).offset(offset).limit(limit)


def bounded(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """The first rows for a profile of a large file; a preview, not a sample."""
    return df.limit(rows)


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """At most one row with these keys."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.limit(1)


def table_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, position, column_name, data_type) of the catalog's tables and views."""
    rows = []
    for t in spark.catalog.listTables(database):
        for k, c in enumerate(spark.catalog.listColumns(t.name)):
            rows.append((t.name, k, c.name, c.dataType))
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")

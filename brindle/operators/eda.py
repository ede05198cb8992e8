"""Exploratory runs: profile, findings and readiness of a dataset, comparable between runs."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import summaries as A

NUMBERS = (T.NumericType,)


def fingerprint(df: DataFrame) -> dict:
    """Rows, a hash of the schema, and a hash of the rows that does not depend on their order."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": facts["n"], "schema": hashlib.sha256(df.schema.json().encode()).hexdigest(), "content": hashlib.sha256(str(facts["h"]).encode()).hexdigest()}


def run_eda(df: DataFrame, keys: Sequence[str], target: str | None = None, coverage: tuple[float, float] = (0.8, 0.5), top: int = 5) -> dict:
    """A run record.  Readiness: READY at the first coverage of the target, LIMITED at the second, else BLOCKED; a
    repeated key blocks as well."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NUMBERS) and f.name not in keys]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    record: dict = {"fingerprint": fingerprint(df), "columns": df.dtypes, "missing": [r.asDict() for r in A.missingness(df, df.columns).collect()]}
    record["numbers"] = [r.asDict() for r in A.numeric_profile(df, numbers).collect()] if numbers else []
    record["top_values"] = [r.asDict() for r in A.top_values(df, texts, top).collect()] if texts else []
    repeated = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0))).first()[0]
    rows = record["fingerprint"]["rows"]
    seen = 1.0 if target is None else (rows - next(m["n_null"] for m in record["missing"] if m["column_name"] == target)) / max(rows, 1)
    record["metrics"] = {"rows": rows, "repeated_keys": repeated, "target_coverage": seen}
    record["findings"] = [f"{m['column_name']} is null in {m['n_null']} of {rows} rows" for m in record["missing"] if m["n_null"] > rows / 2] + [f"{n['column_name']} is strongly skewed" for n in record["numbers"] if abs(n["skew"] or 0) > 3]
    record["readiness"] = "BLOCKED" if repeated or not rows or seen < coverage[1] else "READY" if seen >= coverage[0] else "LIMITED"
    return record


def compare_runs(old: Mapping, new: Mapping) -> dict:
    """Columns added, removed and changed in type, and the metrics' differences."""
    a, b = dict(old["columns"]), dict(new["columns"])
    deltas = {}
    for k in sorted(set(old["metrics"]) & set(new["metrics"])):
        x, y = old["metrics"][k], new["metrics"][k]
        deltas[k] = {"absolute": y - x, "relative": (y - x) / x if x else None}
    return {"added": sorted(set(b) - set(a)), "removed": sorted(set(a) - set(b)), "changed": sorted(c for c in set(a) & set(b) if a[c] != b[c]), "metrics": deltas}

"""Batch inference behind a contract: versions, input and output checks, feature lookup."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.contracts import ContractError, DomainPack, Signature
from brindle.operators.sequences import latest


@dataclass(frozen=True)
class Model:
    """A scoring function over a signature.  ``outputs``: column to kind, ``number``, ``probability`` or ``any``."""

    name: str
    version: str
    signature: Signature
    score: Callable[[DataFrame], DataFrame]
    outputs: Mapping[str, str] = field(default_factory=dict)


class Registry:
    """Models by name and version."""

    def __init__(self) -> None:
        self._models: dict[str, dict[str, Model]] = {}
        self._lock = threading.Lock()

    def add(self, model: Model) -> None:
        with self._lock:
            versions = self._models.setdefault(model.name, {})
            if model.version in versions:
                raise ContractError("MODEL_CONFLICT", f"{model.name} {model.version}")
            versions[model.version] = model

    def find(self, name: str, version: str | None = None) -> Model:
        versions = self._models.get(name, {})
        if not versions or version is not None and version not in versions:
            raise ContractError("MODEL_NOT_FOUND", f"{name} {version or ''}")
        if version is None and len(versions) > 1:
            raise ContractError("VERSION_REQUIRED", name)
        return versions[version] if version else next(iter(versions.values()))


@dataclass
class Engine:
    """``infer`` scores a frame of any size; ``infer_batch`` is the interactive form with a bound on rows."""

    registry: Registry
    packs: Mapping[str, DomainPack] = field(default_factory=dict)
    observers: Sequence[Callable[[dict], None]] = ()
    most_rows: int = 1000

    def validate(self, name: str, df: DataFrame, version: str | None = None, domain: str | None = None) -> DataFrame:
        model = self.registry.find(name, version)
        return self.packs[domain].normalize(df) if domain else model.signature.validate(df)

    def infer(self, name: str, df: DataFrame, version: str | None = None, domain: str | None = None) -> DataFrame:
        model = self.registry.find(name, version)
        out = model.score(self.validate(name, df, version, domain))
        lost = [c for c in model.outputs if c not in out.columns]
        if lost:
            raise ContractError("INVALID_OUTPUT", ", ".join(lost))
        return out

    def infer_rows(self, name: str, df: DataFrame, version: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Scores of the good rows, and codes for the bad ones, in a frame of any size.

        Columns: ``keep``, the model's outputs, ``faults``.  A row with faults has no outputs and never reaches the model; an output
        that breaks its kind is a fault of its row too, with code INVALID_OUTPUT, and is null.  The rows are read in two branches, the bad ones
        and those to be scored; nothing is collected, and the order of rows is free.
        """
        model = self.registry.find(name, version)
        judged = model.signature.faults(df, keep)
        features = [f.name for f in model.signature.features]
        good, bad = (judged.filter(F.size("faults") == 0), judged.filter(F.size("faults") > 0))
        scored = model.score(good.drop("faults"))
        lost = [c for c in [*keep, *model.outputs] if c not in scored.columns]
        if lost:
            raise ContractError("INVALID_OUTPUT", ", ".join(lost))
        wrong = {c: _breaks(F.col(c), kind) for c, kind in model.outputs.items() if kind != "any"}
        found = [F.when(w, F.struct(F.lit(c).alias("feature"), F.lit("INVALID_OUTPUT").alias("code"))) for c, w in wrong.items()]
        faults = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<struct<feature:string,code:string>>")
        outputs = [F.when(~wrong[c], F.col(c)).alias(c) if c in wrong else F.col(c) for c in model.outputs]
        kinds = dict(scored.dtypes)
        empty = [F.lit(None).cast(kinds[c]).alias(c) for c in model.outputs]
        return scored.select(*keep, *outputs, faults.alias("faults")).unionByName(bad.drop(*features).select(*keep, *empty, "faults"))

    def infer_batch(self, name: str, df: DataFrame, version: str | None = None, domain: str | None = None) -> tuple[list[dict], dict]:
        n = df.limit(self.most_rows + 1).count()
        if not 1 <= n <= self.most_rows:
            raise ContractError("INVALID_BATCH", f"{n} rows")
        model, out = self.registry.find(name, version), self.infer(name, df, version, domain)
        records = [r.asDict() for r in out.collect()]
        if len(records) != n:
            raise ContractError("INVALID_OUTPUT", f"{len(records)} rows for {n}")
        for column, kind in model.outputs.items():
            for r in records:
                x = r[column]
                if kind != "any" and (x is None or x != x or abs(x) == float("inf") or kind == "probability" and not 0 <= x <= 1):
                    raise ContractError("INVALID_OUTPUT", f"{column} = {x}")
        facts = {"model": model.name, "version": model.version, "rows": n}
        for tell in self.observers:
            tell(facts)
        return records, facts


def _breaks(x: Column, kind: str) -> Column:
    """Whether a value is no finite number, or no probability."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(bad | (x < 0) | (x > 1) if kind == "probability" else bad, F.lit(True))


def output_faults(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """One row: for each output, how many values break its kind; for frames too large to collect."""
    return df.agg(*[F.count_if(_breaks(F.col(c), k)).alias(c) for c, k in outputs.items() if k != "any"])


def resolve_features(df: DataFrame, keys: Mapping[str, object], date: str, outcomes: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """The latest row of one key as of a day, without the columns that only the future knows; NaN as null."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    if as_of is not None:
        df = df.filter(F.col(date) <= as_of)
    row = latest(df, list(keys), F.desc(date)).drop(*outcomes)
    return row.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in row.dtypes])


def fill_categories(df: DataFrame, columns: Sequence[str], value: str = "__MISSING__") -> DataFrame:
    return df.fillna(value, subset=list(columns))

"""Contracts of tables and of single features, as counts of violations or as a fault of each row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract is broken; ``code`` names how."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class TableContract:
    """Columns a table must have, its key, and those that may not be null."""

    name: str
    columns: tuple[str, ...]
    key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    checks: Mapping[str, str] = field(default_factory=dict)

    def validate(self, df: DataFrame) -> dict:
        """PASS or FAIL with missing and unexpected columns, null counts, duplicate keys and failed checks."""
        missing = [c for c in self.columns if c not in df.columns]
        report = {"contract": self.name, "missing": missing, "unexpected": [c for c in df.columns if c not in self.columns], "nulls": {}, "duplicates": 0, "checks": {}}
        if not missing:
            counts = violations(df, self.key, self.not_null, self.checks).collect()
            for r in counts:
                if r["violations"]:
                    kind, _, name = r["check_name"].partition(":")
                    if kind == "unique":
                        report["duplicates"] = r["violations"]
                    else:
                        report["nulls" if kind == "not_null" else "checks"][name] = r["violations"]
        report["status"] = "FAIL" if missing or report["nulls"] or report["duplicates"] or report["checks"] else "PASS"
        return report


def violations(df: DataFrame, key: Sequence[str], not_null: Sequence[str], checks: Mapping[str, str]) -> DataFrame:
    """(check_name, violations): rows beyond the first of their key, nulls by column, rows that fail each check."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in not_null] + [F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(f"check:{n}") for n, e in checks.items()]
    names = [f"not_null:{c}" for c in not_null] + [f"check:{n}" for n in checks]
    duplicates = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.lit("unique:" + ",".join(key)).alias("check_name"), F.coalesce(F.sum("extra"), F.lit(0)).alias("violations"))
    if not names:
        return duplicates
    one = df.agg(*counts)
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in names])).alias("x")).select("x.*")
    return long.unionByName(duplicates)


#: Feature kinds and the Spark types they arrive as without coercion.
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
MOMENTS = ("timestamp", "timestamp_ntz", "date")


@dataclass(frozen=True)
class Feature:
    """One input of a model.  Kinds: number, integer, string, boolean, datetime."""

    name: str
    kind: str = "number"
    nullable: bool = False
    categories: tuple[str, ...] = ()
    coerce: bool = False

    def fits(self, dtype: str) -> bool:
        """Whether a column of this type may be read as the kind at all.

        Without ``coerce`` the type must be one of the kind's own.  With it numbers, texts and dates are read from any type but
        boolean; a boolean is never made from another type, nor a number from a boolean.
        """
        own = {"number": dtype in NUMERIC or dtype.startswith("decimal"), "string": dtype == "string" or dtype.startswith(("varchar", "char")), "boolean": dtype == "boolean", "datetime": dtype in MOMENTS}
        own["integer"] = own["number"]
        return own[self.kind] or self.coerce and (self.kind == "string" or self.kind != "boolean" and dtype != "boolean")

    def value(self, dtype: str) -> Column:
        """The feature as its kind, null where it cannot be read as such."""
        c = F.col(f"`{self.name}`")
        kind = {"number": "double", "integer": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp"}[self.kind]
        if not self.fits(dtype):
            return F.lit(None).cast(kind)
        if self.kind == "datetime" and dtype in NUMERIC:
            return F.timestamp_seconds(c)
        return c.try_cast(kind) if self.coerce and dtype == "string" else c.cast(kind)

    def fault(self, dtype: str) -> Column:
        """Rows that break the feature's rules, as a code, or null."""
        c, v = F.col(f"`{self.name}`"), self.value(dtype)
        bad = v.isNull()
        if self.fits(dtype) and self.kind in ("number", "integer"):
            bad = bad | F.isnan(v) | (F.abs(v) == float("inf"))
            bad = bad | (v != F.floor(v)) if self.kind == "integer" else bad
        if self.fits(dtype) and self.categories:
            bad = bad | ~v.isin(*self.categories)
        empty = F.lit(False) if self.nullable else c.isNull()
        return F.when(empty, "NULL_FEATURE").when(F.coalesce(bad, F.lit(True)) & c.isNotNull(), "INVALID_FEATURE")


@dataclass(frozen=True)
class Signature:
    """The features of a model, and columns it must never see."""

    features: tuple[Feature, ...]
    forbidden: tuple[str, ...] = ()

    def check_columns(self, df: DataFrame) -> None:
        """The columns' names, by the first broken rule."""
        if len(set(df.columns)) != len(df.columns):
            raise ContractError("INVALID_SCHEMA", "column names repeat")
        names = [f.name for f in self.features]
        for code, found in (("FORBIDDEN_FEATURE", [c for c in df.columns if c in self.forbidden]), ("MISSING_FEATURE", [n for n in names if n not in df.columns]), ("UNEXPECTED_FEATURE", [c for c in df.columns if c not in names])):
            if found:
                raise ContractError(code, ", ".join(sorted(found)))

    def _read(self, df: DataFrame) -> list[Column]:
        types = dict(df.dtypes)
        return [(f.value(types[f.name]).cast("long") if f.kind == "integer" else f.value(types[f.name])).alias(f.name) for f in self.features]

    def validate(self, df: DataFrame) -> DataFrame:
        """``df`` with its features read as their kinds; the first broken rule raises."""
        self.check_columns(df)
        types = dict(df.dtypes)
        counts = [F.count_if(f.fault(types[f.name]) == code).alias(f"{i}:{code}") for i, f in enumerate(self.features) for code in ("NULL_FEATURE", "INVALID_FEATURE")]
        found = df.agg(*counts).first().asDict()
        for key, n in found.items():
            if n:
                i, _, code = key.partition(":")
                raise ContractError(code, f"{self.features[int(i)].name} in {n} rows")
        return df.select(*self._read(df))

    def faults(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``df`` with its features read as their kinds and ``faults``, the (feature, code) of every rule that a row breaks.

        One projection, lazy, so a frame of any size is judged row by row as it is read; only its column names can raise.  A
        feature at fault is null unless it can be read.  Columns of ``keep`` (a row's key) are carried along and are no features.
        """
        clash = sorted({*keep, "faults"} & {f.name for f in self.features} | set(keep) & {"faults"})
        if clash:
            raise ContractError("INVALID_SCHEMA", f"reserved: {', '.join(clash)}")
        self.check_columns(df.drop(*keep))
        types = dict(df.dtypes)
        found = [F.when(f.fault(types[f.name]).isNotNull(), F.struct(F.lit(f.name).alias("feature"), f.fault(types[f.name]).alias("code"))) for f in self.features]
        return df.select(*[F.col(f"`{k}`") for k in keep], *self._read(df), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("faults"))


@dataclass(frozen=True)
class DomainPack:
    """How a customer's table becomes a signature's: rename, scale, transform, validate."""

    signature: Signature
    mapping: Mapping[str, str] = field(default_factory=dict)
    scale: Mapping[str, float] = field(default_factory=dict)
    transform: object = None

    def normalize(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.mapping if c not in df.columns]
        if missing:
            raise ContractError("MISSING_FEATURE", ", ".join(missing))
        kept = [c for c in df.columns if c not in self.mapping]
        if len(set(self.mapping.values())) != len(self.mapping) or set(kept) & set(self.mapping.values()):
            raise ContractError("MAPPING_COLLISION", "two columns would share a name")
        out = df.withColumnsRenamed(dict(self.mapping))
        out = self.signature.validate(out)
        out = out.withColumns({c: F.col(c) * float(k) for c, k in self.scale.items()}) if self.scale else out
        return self.signature.validate(self.transform(out)) if self.transform else out


def capabilities(required: Mapping[str, Sequence[str]], supplied: Mapping[str, bool], blocked: Sequence[str] = (), experimental: Sequence[str] = ()) -> dict[str, str]:
    """What can run on the supplied contracts (name: valid or not)."""
    out = {}
    for name, needs in required.items():
        if name in blocked:
            out[name] = "BLOCKED_SCIENTIFICALLY"
        elif any(n in supplied and not supplied[n] for n in needs):
            out[name] = "INVALID_CONTRACT"
        elif any(n not in supplied for n in needs):
            out[name] = "UNAVAILABLE_MISSING_CONTRACT"
        else:
            out[name] = "ACTIVE_EXPERIMENTAL" if name in experimental else "AVAILABLE"
    return out

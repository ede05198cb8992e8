"""Model selection that is frozen before the test rows are looked at.

The record of a selection names the candidates, their validation errors, the winner and the fingerprints of the frames that
it was made from, and a hash of all that.  It is written once: a second selection under the same path is refused.  The test
evaluation loads it, refuses one that was changed, and refuses frames other than those of the selection.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from brindle.operators.eda import fingerprint


class SelectionError(Exception):
    """``code``: ALREADY_FROZEN, RECORD_CHANGED, INPUT_CHANGED or MALFORMED_RECORD."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def _digest(body: Mapping) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def select_model(errors: Mapping[str, float], simplest_first: Sequence[str], tolerance: float = 0.005) -> str:
    """The lowest error, or a simpler model within the tolerance of it."""
    low = min(errors.values())
    return next(m for m in simplest_first if errors[m] <= low * (1 + tolerance))


def freeze(spark: SparkSession, path: str, errors: Mapping[str, float], simplest_first: Sequence[str], inputs: Mapping[str, DataFrame], tolerance: float = 0.005) -> dict:
    """Select by validation errors and write the record; the path must be new."""
    body = {
        "errors": {m: float(e) for m, e in errors.items()}, "simplest_first": list(simplest_first), "tolerance": tolerance,
        "selected": select_model(errors, simplest_first, tolerance), "inputs": {name: fingerprint(df) for name, df in inputs.items()},
    }
    record = body | {"sha256": _digest(body)}
    try:
        spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    except AnalysisException as problem:
        if "PATH_ALREADY_EXISTS" in str(problem):
            raise SelectionError("ALREADY_FROZEN", path) from problem
        raise
    return record


def load(spark: SparkSession, path: str, inputs: Mapping[str, DataFrame]) -> dict:
    """The record, if it is as it was written and made from these frames."""
    rows = [r.value for r in spark.read.text(path).collect()]  # one line
    try:
        record = json.loads("\n".join(rows))
        body = {k: v for k, v in record.items() if k != "sha256"}
        written, selected, frames = record["sha256"], record["selected"], record["inputs"]
    except (ValueError, KeyError, AttributeError) as problem:
        raise SelectionError("MALFORMED_RECORD", path) from problem
    if _digest(body) != written or selected != select_model(record["errors"], record["simplest_first"], record["tolerance"]):
        raise SelectionError("RECORD_CHANGED", path)
    for name, df in inputs.items():
        if frames.get(name) != fingerprint(df):
            raise SelectionError("INPUT_CHANGED", name)
    return record

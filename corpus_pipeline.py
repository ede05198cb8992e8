"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; its result is written and read
again as the next one's ``docs``.  All stages but the last return the columns of ``docs``.  Null texts fail the quality
rules and go in the first stage.  Repeated rows are near copies of each other, so one stays, and so are rows of one text with
different ids; ties fall to the smallest id, then to the first row in the files.  A null id is like any other but for that it
comes last.  Empty tables give an empty result.  Further columns of any name are kept as they are.  Very long texts are one row
of a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, mixing, near_copies, quality_rules, secrets
from brindle.llm.common import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every class of near copies."""
    return near_copies.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that mostly consist of such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mask in the place of every secret."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how often (``copies``)."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix),
]

#: Fingerprint components, the automaton's repeated cuts and the models of random strings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that come out of all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

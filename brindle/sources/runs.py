"""A store of runs: tables and facts that appear as a whole or not at all.

A run is staged in a hidden folder, and one rename makes it visible under ``<root>/<name>/<number>``; a failure on the way removes the
staged folder.  Numbers rise; two writers of one name cannot both get a number, for the second rename finds the folder taken
and tries the next.  All goes through Hadoop's file systems; the rename is as atomic as theirs is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from brindle.sources import sinks


class RunError(Exception):
    """``code``: NO_SUCH_RUN, INVALID_NAME or NOT_STORED."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> list[str]:
        at = self._path(path)
        if not self._files.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(at) if s.isDirectory() and s.getPath().getName()[0] not in "._")

    def save(self, name: str, tables: Mapping[str, DataFrame], facts: Mapping | None = None) -> int:
        """Store a run and return its number."""
        if not name or name[0] in "._" or "/" in name or any(not t or t[0] in "._" or "/" in t or t == "facts" for t in tables):
            raise RunError("INVALID_NAME", f"{name}: {', '.join(tables)}")
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        try:
            rows = {}
            for key, df in tables.items():
                df.write.option("compression", "zstd").parquet(f"{staged}/{key}")
                rows[key] = self.spark.read.parquet(f"{staged}/{key}").count()
            sinks.save_document(self.spark, {"facts": dict(facts or {}), "rows": rows}, f"{staged}/facts")
            self._files.mkdirs(self._path(f"{self.root}/{name}"))
            for _ in range(100):
                number = max(self.list(name), default=0) + 1
                target = self._path(f"{self.root}/{name}/{number:08d}")
                if self._files.exists(target) or not self._files.rename(self._path(staged), target):
                    continue
                inside = f"{target.toString()}/{staged.rpartition('/')[2]}"
                if not self._files.exists(self._path(inside)):
                    return number
                staged = inside  # another writer took the number in between: out of its folder again
            raise RunError("NOT_STORED", name)
        except BaseException:
            self._files.delete(self._path(staged), True)
            raise

    def names(self) -> list[str]:
        return self._folders(self.root)

    def list(self, name: str) -> list[int]:
        """The numbers of a name's runs, rising."""
        return [int(f) for f in self._folders(f"{self.root}/{name}") if f.isdigit()]

    def latest(self, name: str) -> int:
        numbers = self.list(name)
        if not numbers:
            raise RunError("NO_SUCH_RUN", name)
        return numbers[-1]

    def facts(self, name: str, number: int | None = None) -> dict:
        """{"facts": as saved, "rows": by table} of a run, the latest one by default."""
        number = self.latest(name) if number is None else number
        if number not in self.list(name):
            raise RunError("NO_SUCH_RUN", f"{name} {number}")
        return sinks.load_document(self.spark, f"{self.root}/{name}/{number:08d}/facts")

    def load(self, name: str, table: str, number: int | None = None) -> DataFrame:
        number = self.latest(name) if number is None else number
        if table not in self.facts(name, number)["rows"]:
            raise RunError("NO_SUCH_RUN", f"{name} {number}: {table}")
        return self.spark.read.parquet(f"{self.root}/{name}/{number:08d}/{table}")

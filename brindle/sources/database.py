"""Relational databases over JDBC: extracts read in parallel by key ranges, and loads that appear as a whole or not at all.

Tables are read and written by Spark's JDBC source, so filters and column lists reach the database.  The statements beside it are
of the standard's core, as PostgreSQL and Derby have them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import closing, contextmanager
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.joins import orphans

#: Counts of a key range that one statement returns.
BUCKETS = 4096


class DatabaseError(Exception):
    """``code``: ORPHANS, CYCLE, NOT_STAGED or NOT_RECONCILED."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


class Database:
    """A database by its JDBC ``url``; ``properties`` hold user, password and driver."""

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str] | None = None):
        self.spark, self.url, self.properties = spark, url, dict(properties or {})

    def rows(self, select: str) -> list:
        """The rows of a statement whose result is small."""
        return self.spark.read.jdbc(self.url, f"({select}) brindle_q", properties=self.properties).collect()

    @contextmanager
    def _transaction(self):
        """A function that runs statements; all of them take effect, or none."""
        jvm = self.spark.sparkContext._jvm
        facts = jvm.java.util.Properties()
        for k, v in self.properties.items():
            facts.setProperty(k, v)
        with closing(jvm.java.sql.DriverManager.getConnection(self.url, facts)) as connection:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            try:
                yield statement.executeUpdate
                connection.commit()
            except BaseException:
                connection.rollback()
                raise

    # ---- extracts

    def ranges(self, table: str, key: str, most_rows: int = 1_000_000) -> list[str]:
        """Conditions on a whole-numbered key that part the table, each of ``most_rows`` rows at most, or of one key.

        Equal steps between the smallest and the largest key would put nearly all rows in one task where keys are sparse.  So the
        database counts the keys in equal buckets, buckets with too many rows are counted again in finer ones, and neighbours are
        joined while they fit.  Rows without a key have a condition of their own.
        """
        end = self.rows(f"SELECT min({key}) AS low, max({key}) AS high, count(*) AS n, count({key}) AS known FROM {table}")[0]
        low, high, n, known = (None if v is None else int(v) for v in end)
        found, start, held = [], low, 0
        for first, _, count in self._counts(table, key, low, high, known, most_rows) if known else []:
            if held and held + count > most_rows:
                found.append(f"{key} >= {start} AND {key} < {first}")
                start, held = first, 0
            held += count
        if known:
            found.append(f"{key} >= {start}")
        return found + ([f"{key} IS NULL"] if n > known else [])

    def _counts(self, table: str, key: str, low: int, high: int, n: int, most: int):
        """(first key, last key, rows) in order, none with over ``most`` rows but for single keys."""
        if n <= most or low == high:
            yield low, high, n
            return
        width = max(1, -(-(high - low + 1) // BUCKETS))
        # Quotients of whole numbers are whole in SQL; the shift keeps them positive, so that they are floors.
        inner = f"SELECT (CAST({key} AS BIGINT) - {low}) / {width} AS b FROM {table} WHERE {key} >= {low} AND {key} <= {high}"
        counts = self.rows(f"SELECT b, count(*) AS n FROM ({inner}) x GROUP BY b")
        for b, rows in sorted((int(r[0]), int(r[1])) for r in counts):
            first = low + b * width
            yield from self._counts(table, key, first, min(first + width - 1, high), rows, most)

    def extract(self, table: str, key: str, most_rows: int = 1_000_000) -> DataFrame:
        """A table, one task for each of its :meth:`ranges`.  An empty table is one empty task."""
        parts = self.ranges(table, key, most_rows)
        if not parts:
            return self.spark.read.jdbc(self.url, table, properties=self.properties)
        return self.spark.read.jdbc(self.url, table, predicates=parts, properties=self.properties)

    def replicate(self, keys: Mapping[str, str], folder: str, most_rows: int = 1_000_000) -> DataFrame:
        """Tables (name: key) as Parquet under ``folder``; the manifest (table_name, row_count, columns, path).

        A table whose copy has other than the database's number of rows raises NOT_RECONCILED.
        """
        out = []
        for table, key in keys.items():
            path = f"{folder}/{table.lower()}"
            self.extract(table, key, most_rows).write.mode("overwrite").option("compression", "zstd").parquet(path)
            copy = self.spark.read.parquet(path)
            want, got = int(self.rows(f"SELECT count(*) AS n FROM {table}")[0][0]), copy.count()
            if want != got:
                raise DatabaseError("NOT_RECONCILED", f"{table}: {want} rows, {got} copied")
            out.append((table, got, copy.columns, path))
        return self.spark.createDataFrame(out, "table_name string, row_count long, columns array<string>, path string")

    # ---- loads

    def load(self, tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, str, str]] = (), identities: Mapping[str, str] | None = None) -> dict[str, int]:
        """Replace the rows of existing tables by those of frames; the number of rows of each, parents first.

        ``references``: (child, column, parent, column); both tables are loaded.  ``identities``: table to the generated key that
        goes on after the largest loaded one.  The frames are staged by all tasks, in tables beside the real ones; one transaction
        then empties children before parents and fills parents before children.  Orphans stop a load before it begins (null
        references are none), and so does a staged table whose number of rows is not its frame's, as after a task that was
        repeated.  A load that is repeated leaves the same rows.
        """
        order = load_order(tables, references)
        lost = {f"{child}.{column}": orphans(tables[child], tables[parent], column, key).count() for child, column, parent, key in references}
        if any(lost.values()):
            raise DatabaseError("ORPHANS", ", ".join(f"{k}: {n}" for k, n in lost.items() if n))
        staged = {t: f"{t}_staged" for t in order}
        made = []
        try:
            for t in order:
                with self._transaction() as run:
                    run(f"CREATE TABLE {staged[t]} AS SELECT * FROM {t} WITH NO DATA")
                made.append(staged[t])
                tables[t].write.mode("append").jdbc(self.url, staged[t], properties=self.properties)
            counts = {t: int(self.rows(f"SELECT count(*) AS n FROM {staged[t]}")[0][0]) for t in order}
            wrong = {t: n for t, n in counts.items() if n != tables[t].count()}
            if wrong:
                raise DatabaseError("NOT_STAGED", ", ".join(f"{t}: {n}" for t, n in wrong.items()))
            with self._transaction() as run:
                for t in reversed(order):
                    run(f"DELETE FROM {t}")
                for t in order:
                    names = ", ".join(tables[t].columns)
                    run(f"INSERT INTO {t} ({names}) SELECT {names} FROM {staged[t]}")
                for t, key in (identities or {}).items():
                    last = self.rows(f"SELECT max({key}) AS k FROM {staged[t]}")[0][0]
                    run(f"ALTER TABLE {t} ALTER COLUMN {key} RESTART WITH {int(last or 0) + 1}")
            return counts
        finally:
            for name in made:
                with self._transaction() as run:
                    run(f"DROP TABLE {name}")


def load_order(tables: Sequence[str] | Mapping, references: Sequence[tuple[str, str, str, str]]) -> list[str]:
    """Tables with every parent before its children, else as given; a table may refer to itself."""
    parents: dict[str, list[str]] = {t: [] for t in tables}
    for child, _, parent, _ in references:
        if parent != child:
            parents[child].append(parent)
    try:
        return list(TopologicalSorter(parents).static_order())
    except CycleError as problem:
        raise DatabaseError("CYCLE", ", ".join(problem.args[1])) from None

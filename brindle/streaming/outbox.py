"""A stream over a table of messages in a database, whose place is kept there and moves on after a batch is written.

``spark.dataSource.register(Outbox)``, then ``spark.readStream.format("outbox")`` with the options

* ``driver``: a Python module with ``connect`` (``sqlite3``, ``psycopg``, ...), and ``database``, what ``connect`` is given;
* ``table``, ``key`` (whole numbers, handed out in the order in which writers commit) and ``body`` (text);
* ``consumer``: the name under which the place is kept, in the table ``<table>_places (consumer, place)``;
* ``most_rows``: rows of one task, 100,000 unless given, and ``batch_rows``: keys of one batch, ten times as many unless given.

The place of a consumer that has none is the start.  It moves only after Spark has finished the batch before it, so a run that fails between
write and commit, or loses its checkpoint, reads those messages again; sinks must bear that (:func:`brindle.streaming.replay.sink`
does).
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator, Mapping
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class Keys(InputPartition):
    """Messages with ``after < key <= upto``."""

    after: int
    upto: int


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "key long, raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return OutboxReader(dict(self.options))


class OutboxReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.driver, self.database = options["driver"], options["database"]
        self.table, self.key, self.body, self.consumer = (options[k] for k in ("table", "key", "body", "consumer"))
        for name in (self.table, self.key, self.body, self.consumer):  # they stand in statements as they are
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name):
                raise ValueError(f"not a plain name: {name}")
        self.most = int(options.get("most_rows", 100_000))
        self.batch = int(options.get("batch_rows", 10 * self.most))
        self.seen = None

    def _connect(self):
        return closing(importlib.import_module(self.driver).connect(self.database))

    def _one(self, statement: str) -> int | None:
        with self._connect() as connection:
            cursor = connection.cursor()
            cursor.execute(statement)
            row = cursor.fetchone()
        return None if row is None or row[0] is None else int(row[0])

    def initialOffset(self) -> dict:
        """The consumer's place."""
        place = self._one(f"SELECT place FROM {self.table}_places WHERE consumer = '{self.consumer}'")
        if place is None:
            place = (self._one(f"SELECT min({self.key}) FROM {self.table}") or 1) - 1
        return {"key": place}

    def latestOffset(self) -> dict:
        """The end of the next batch: ``batch_rows`` messages on from the last one, or the table's end."""
        after = self.initialOffset()["key"] if self.seen is None else self.seen
        end = self._one(f"SELECT max(k) FROM (SELECT {self.key} AS k FROM {self.table} WHERE {self.key} > {after} ORDER BY {self.key} LIMIT {self.batch}) x")
        self.seen = after if end is None else end
        return {"key": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        """The batch in parts of ``most_rows`` messages; their bounds are counted, so gaps between keys do no harm."""
        after, upto = int(start["key"]), int(end["key"])
        self.seen = max(upto, self.seen or upto)
        out = []
        while after < upto:
            last = self._one(f"SELECT max(k) FROM (SELECT {self.key} AS k FROM {self.table} WHERE {self.key} > {after} AND {self.key} <= {upto} ORDER BY {self.key} LIMIT {self.most}) x")
            if last is None:
                break
            out.append(Keys(after, last))
            after = last
        return out

    def read(self, partition: Keys) -> Iterator[tuple]:
        with self._connect() as connection:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {self.key}, {self.body} FROM {self.table} WHERE {self.key} > {partition.after} AND {self.key} <= {partition.upto}")
            while rows := cursor.fetchmany(1000):
                yield from ((int(k), None if raw is None else str(raw)) for k, raw in rows)

    def commit(self, end: dict) -> None:
        """Keep the place; it never goes back."""
        place = int(end["key"])
        with self._connect() as connection:
            cursor = connection.cursor()
            cursor.execute(f"DELETE FROM {self.table}_places WHERE consumer = '{self.consumer}' AND place < {place}")
            cursor.execute(f"INSERT INTO {self.table}_places (consumer, place) SELECT '{self.consumer}', {place} WHERE NOT EXISTS (SELECT 1 FROM {self.table}_places WHERE consumer = '{self.consumer}')")
            connection.commit()

"""A stream from a database whose place moves on after the write: crashes, lost checkpoints, gaps between keys."""

import json
import sqlite3
import uuid

import pytest

from brindle.streaming import outbox, replay
from tests.test_replay import GOOD


@pytest.fixture()
def messages(spark, tmp_path):
    """240 sales with gaps between their keys, the first 40 sent twice, and 6 broken messages, two of them alike."""
    path = str(tmp_path / "box.db")
    events = [json.dumps(GOOD | {"event_id": str(uuid.UUID(int=k))}) for k in range(240)]
    bodies = events[:200] + [f"{{bad {k % 5}" for k in range(6)] + events[:40] + events[200:]
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE box (id INTEGER PRIMARY KEY, body TEXT)")
        c.execute("CREATE TABLE box_places (consumer TEXT, place INTEGER)")
        c.executemany("INSERT INTO box VALUES (?, ?)", [(10 + 7 * k + 10**9 * (k > 150), b) for k, b in enumerate(bodies)])
    spark.dataSource.register(outbox.Outbox)
    return path


def stream(spark, path, batch_rows=100):
    options = {"driver": "sqlite3", "database": path, "table": "box", "key": "id", "body": "body", "consumer": "replay", "most_rows": 30, "batch_rows": batch_rows}
    return spark.readStream.format("outbox").options(**options).load().select("raw")


def run(spark, path, folder, checkpoint, crash_in=None, name=None):
    """Drain the box; ``crash_in``: the batch after whose write the run fails."""
    write = replay.sink(f"{folder}/ledger", f"{folder}/dead", replay.stream_name(name or checkpoint))

    def written_then_crashed(batch, n):
        write(batch, n)
        if n == crash_in:
            raise RuntimeError("lost between write and commit")

    query = stream(spark, path).writeStream.foreachBatch(written_then_crashed).option("checkpointLocation", f"{folder}/{checkpoint}").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def state(spark, folder):
    ledger, dead = (spark.read.parquet(f"{folder}/{n}") for n in ("ledger", "dead"))
    return ledger.count(), ledger.select("event_id").distinct().count(), dead.count()


def place(path):
    with sqlite3.connect(path) as c:
        return c.execute("SELECT place FROM box_places WHERE consumer = 'replay'").fetchone()


def test_a_crash_between_write_and_commit_is_made_good(spark, messages, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(Exception, match="lost between write and commit"):
        run(spark, messages, folder, "checkpoint", crash_in=1)
    keys = sorted(k for (k,) in sqlite3.connect(messages).execute("SELECT id FROM box"))
    # The second batch was written and not committed: the place is the end of the first at most.
    assert place(messages) is None or place(messages)[0] <= keys[99]
    run(spark, messages, folder, "checkpoint")
    assert state(spark, folder) == (240, 240, 6)
    run(spark, messages, folder, "checkpoint")
    assert state(spark, folder) == (240, 240, 6)


def test_a_lost_checkpoint_resumes_at_the_place(spark, messages, tmp_path):
    folder = str(tmp_path)
    run(spark, messages, folder, "first")
    kept = place(messages)[0]
    with sqlite3.connect(messages) as c:
        c.execute("INSERT INTO box VALUES (5000000000, ?)", (json.dumps(GOOD | {"event_id": str(uuid.UUID(int=999))}),))
        c.execute("INSERT INTO box VALUES (5000000001, '{worse')")
    run(spark, messages, folder, "second")  # batches are numbered from 0 again and must not overwrite those of before
    assert state(spark, folder) == (241, 241, 7)
    assert place(messages)[0] >= kept


def test_parts_are_counted_and_names_are_plain(messages):
    options = {"driver": "sqlite3", "database": messages, "table": "box", "key": "id", "body": "body", "consumer": "replay", "most_rows": 30, "batch_rows": 10**6}
    reader = outbox.OutboxReader(options)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    sizes = [len(list(reader.read(p))) for p in parts]
    assert sum(sizes) == 286 and max(sizes) == 30 and len(sizes) == 10
    reader.commit({"key": 50})
    reader.commit({"key": 40})
    assert reader.initialOffset() == {"key": 50}
    with pytest.raises(ValueError):
        outbox.OutboxReader(options | {"table": "box; drop table box"})

"""Envelopes, the idempotent ledger and streaming windows."""

import json

from pyspark.sql import functions as F

from brindle.streaming import replay

GOOD = {"event_id": "12345678-1234-1234-1234-123456789abc", "event_type": "sale", "event_time": "2024-01-01T23:59:59Z", "source": "x", "schema_version": 1, "payload": {"sale_id": 1, "store_id": 2, "sku_id": 3, "quantity_units": "4", "unit_price": "1.5"}}


def reason(spark, body):
    raw = body if isinstance(body, str) else json.dumps(body)
    return replay.validate(spark.createDataFrame([(raw,)], "raw string")).first().reason


def test_first_broken_rule_is_the_reason(spark):
    assert reason(spark, GOOD) is None
    assert reason(spark, "{nonsense") == "invalid_json"
    assert reason(spark, {"bad": True}).startswith("missing_envelope_fields:event_id")
    assert reason(spark, GOOD | {"event_id": "x"}) == "invalid_event_id"
    assert reason(spark, GOOD | {"event_time": "yesterday"}) == "invalid_event_time"
    assert reason(spark, GOOD | {"event_id": None}) == "invalid_event_id" and reason(spark, GOOD | {"event_id": "{12345678123412341234123456789ABC}"}) is None
    assert reason(spark, GOOD | {"schema_version": 2}) == "unsupported_schema_version"
    assert reason(spark, GOOD | {"payload": {"sale_id": 1}}).startswith("missing_payload_fields:store_id")
    assert reason(spark, GOOD | {"payload": GOOD["payload"] | {"unit_price": "x"}}) == "invalid_number"
    assert reason(spark, GOOD | {"payload": GOOD["payload"] | {"quantity_units": -1}}) == "negative_value"
    assert reason(spark, GOOD | {"payload": GOOD["payload"] | {"quantity_units": None}}) == "invalid_number"
    assert reason(spark, GOOD | {"schema_version": None}) == "unsupported_schema_version"
    # Other types of events have payloads of their own, and a field that is there may be null.
    assert reason(spark, GOOD | {"event_type": "restock", "payload": {"a": -1}}) is None
    assert reason(spark, GOOD | {"event_type": None, "source": None, "payload": None}) is None
    assert reason(spark, GOOD | {"payload": [1]}).startswith("missing_payload_fields:sale_id")


def test_built_events_are_accepted(spark):
    sales = spark.createDataFrame([(1, 2, 3, "4", "1.5", "2024-01-01")], "sale_id long, store_id long, sku_id long, quantity_units string, unit_price string, sale_date string")
    row = replay.accepted(replay.validate(replay.sale_event(sales))).first()
    assert (row.sale_id, float(row.unit_price)) == (1, 1.5)


def test_replayed_files_leave_the_ledger_alone(spark, tmp_path):
    bodies = [json.dumps(GOOD | {"event_id": GOOD["event_id"][:-1] + str(k % 4)}) for k in range(8)] + ["{bad"]
    spark.createDataFrame([(b,) for b in bodies], "raw string").repartition(3).write.parquet(str(tmp_path / "in"))
    counts = []
    for k in (1, 2):
        stream = spark.readStream.schema("raw string").parquet(str(tmp_path / "in"))
        replay.drain(stream, str(tmp_path / "ledger"), str(tmp_path / "dead"), str(tmp_path / f"checkpoint{k}"))
        counts.append((spark.read.parquet(str(tmp_path / "ledger")).count(), spark.read.parquet(str(tmp_path / "dead")).count()))
    assert counts == [(4, 1), (4, 1)]


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = replay.tumbling(stream, late="1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, replay.tumbling(events).collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want
    assert replay.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_a_filter_on_the_reason_copies_no_parsing(spark):
    raw = spark.createDataFrame([('{"event_id":"x"}',), ("{bad",)], "raw string")
    plan = replay.rejected(replay.validate(raw)).groupBy("reason").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2 and plan.count("sonObjectKeys") <= 2  # the envelope's and the payload's


def test_every_fifth_message_comes_twice(spark, tmp_path):
    from brindle.plans.io_streams import _messages

    spark.range(1, 16).selectExpr("id AS event_id", "id AS user_id", "timestamp_ntz'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(r["k"] for r in _messages(spark, str(tmp_path)).select("k").collect())
    assert found == sorted([*range(1, 16), 5, 10, 15])

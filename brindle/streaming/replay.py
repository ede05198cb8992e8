"""Event replay: envelope validation, an idempotent ledger, dead letters, and windowed counts.

A message is a JSON envelope.  The first rule that it breaks is its reason; without a reason it is accepted.  Accepted
events reach the ledger once however often they are replayed: each micro-batch drops ids that it repeats and those that the
ledger holds, and a batch that is run again overwrites its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FIELDS = ("event_id", "event_type", "event_time", "source", "schema_version", "payload")
SALE_FIELDS = ("sale_id", "store_id", "sku_id", "quantity_units", "unit_price")
#: The type of the events whose payload is checked.
SALE = "sale"


def kafka_messages(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic from its start as ``raw``; offsets are kept by the query's checkpoint.  Needs the Kafka package on the class path."""
    stream = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}).load()
    return stream.select(F.col("value").cast("string").alias("raw"))


def produce(messages: DataFrame, servers: str, topic: str) -> None:
    """Write ``raw`` to a topic, keyed by the event's id, so that a repeated write lands in the same partition."""
    keyed = messages.select(F.get_json_object("raw", "$.event_id").alias("key"), F.col("raw").alias("value"))
    keyed.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def sale_event(sales: DataFrame) -> DataFrame:
    """Envelopes (column ``raw``) of sales: the id is a hash of the sale's, the time the end of its day."""
    h = F.sha1(F.concat(F.lit("sale:"), F.col("sale_id").cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    uid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    at = F.concat(F.col("sale_date").cast("string"), F.lit("T23:59:59+00:00"))
    payload = F.struct(*SALE_FIELDS)
    body = F.struct(uid.alias("event_id"), F.lit(SALE).alias("event_type"), at.alias("event_time"), F.lit("replay").alias("source"), F.lit(1).alias("schema_version"), payload.alias("payload"))
    return sales.select(F.to_json(body).alias("raw"))


def worked_out(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row.

    Filters and later columns otherwise take copies of the expressions that they name, so a filter on a column that names another
    ten times computes that one ten times, and all that it names in turn.  They take none through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def validate(messages: DataFrame) -> DataFrame:
    """Adds the parsed envelope ``e``, a sale's payload ``p``, and ``reason``, the first broken rule or null.

    A field that is there is not missing, even if null.  Only sales must have a sale's payload.
    """
    parsed = F.from_json("raw", "event_id string, event_type string, event_time string, source string, schema_version string, payload string", {"mode": "PERMISSIVE"})
    body = worked_out(messages, parsed.alias("e"), F.json_object_keys("raw").alias("_keys"))
    body = worked_out(body, F.from_json("e.payload", ", ".join(f"{f} string" for f in SALE_FIELDS)).alias("p"), F.json_object_keys("e.payload").alias("_sale_keys"))
    without = lambda fields, keys: F.array_except(F.array(*map(F.lit, fields)), F.coalesce(keys, F.array().cast("array<string>")))
    missing, lost = without(FIELDS, "_keys"), without(SALE_FIELDS, "_sale_keys")
    number = lambda f: F.col(f"p.{f}").try_cast("decimal(38,6)")
    digits = F.regexp_replace(F.regexp_replace(F.lower("e.event_id"), "urn:|uuid:|-", ""), "^[{}]+|[{}]+$", "")
    untrue = lambda c: ~F.coalesce(c, F.lit(False))
    sale = F.coalesce(F.col("e.event_type") == SALE, F.lit(False))
    reason = (
        F.when(F.col("_keys").isNull(), "invalid_json")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_envelope_fields:"), F.array_join(missing, ",")))
        .when(untrue(digits.rlike("^[0-9a-f]{32}$")), "invalid_event_id")
        .when(F.try_to_timestamp(F.col("e.event_time")).isNull(), "invalid_event_time")
        .when(untrue(F.col("e.schema_version") == "1"), "unsupported_schema_version")
        .when(sale & (F.size(lost) > 0), F.concat(F.lit("missing_payload_fields:"), F.array_join(lost, ",")))
        .when(sale & (number("quantity_units").isNull() | number("unit_price").isNull()), "invalid_number")
        .when(sale & ((number("quantity_units") < 0) | (number("unit_price") < 0)), "negative_value")
    )
    return worked_out(body, reason.alias("reason")).drop("_keys", "_sale_keys")


def accepted(validated: DataFrame) -> DataFrame:
    p = lambda f, t: F.col(f"p.{f}").cast(t).alias(f)
    good = validated.filter("reason is null")
    return good.select(F.lower("e.event_id").alias("event_id"), "e.event_type", F.to_timestamp("e.event_time").alias("event_time"), p("sale_id", "long"), p("store_id", "long"), p("sku_id", "long"), p("quantity_units", "decimal(18,4)"), p("unit_price", "decimal(18,4)"))


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter("reason is not null").select("raw", "reason")


def upsert_new(batch: DataFrame, ledger: DataFrame | None, key: str = "event_id") -> DataFrame:
    """The batch's rows whose key is new, one each."""
    fresh = batch.dropDuplicates([key])
    return fresh if ledger is None else fresh.join(ledger.select(key), key, "left_anti")


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier batches of all streams have written."""
    try:
        return spark.read.parquet(path)
    except Exception as problem:  # an empty or missing ledger has no schema to read
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def stream_name(checkpoint: str) -> str:
    """The name of a stream in the folders of its sink: one for each checkpoint, whose batches are numbered from 0."""
    return "s" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def sink(ledger_path: str, dead_path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for messages ``raw``: ledger and dead letters, one folder for each batch of each stream.

    A batch that is run again, after a failure between write and commit, overwrites its own folder.  Under a fresh checkpoint batches
    are numbered from 0 again, so streams have folders of their own; messages that they read again add nothing: the ledger
    drops known events, and dead letters those that another stream has rejected (one stream keeps all its copies).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = validate(batch).persist()
        folder, own = f"stream={stream}/batch_id={batch_id}", (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
        held = _held(spark, ledger_path)
        fresh = upsert_new(accepted(checked), None if held is None else held.filter(~own))
        fresh.write.mode("overwrite").parquet(f"{ledger_path}/{folder}")
        dead, known = rejected(checked), _held(spark, dead_path)
        if known is not None:
            others = known.filter(F.col("stream") != stream).select(F.col("raw").alias("_raw")).distinct()
            dead = dead.join(others, F.col("raw").eqNullSafe(F.col("_raw")), "left_anti")
        dead.write.mode("overwrite").parquet(f"{dead_path}/{folder}")
        checked.unpersist()

    return write


def drain(messages: DataFrame, ledger_path: str, dead_path: str, checkpoint: str) -> StreamingQuery:
    """Process all there is and stop."""
    write = sink(ledger_path, dead_path, stream_name(checkpoint))
    query = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counters(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if(F.col("reason").isNull()).alias("n_accepted"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; ``late`` sets the watermark of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    by = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("session_start"), F.expr(f"session_window.end - interval {gap}").alias("last_event"), "n")

"""Sources, sinks and streams as queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.catalog import register
from brindle.sources import readers, roles, sinks
from brindle.sources.roles import oracle, table
from brindle.streaming import replay


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the session's checkpoint folder; a session of one machine (tests) may do without that."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.mkdtemp()}/{uuid.uuid4().hex}"


@register("src01_read_by_suffix", "SELECT r_regionkey, r_name FROM region")
def src01(spark: SparkSession, d: str) -> DataFrame:
    """Parquet written as CSV and read again under a schema."""
    path = f"{shared_folder(spark)}.csv"
    region = readers.read_source(spark, f"{d}/region.parquet")
    region.select("r_regionkey", "r_name").write.csv(path, header=True)
    return readers.read_source(spark, path, region.select("r_regionkey", "r_name").schema)


@register("src02_mapped_columns", "SELECT c_custkey AS store_id, c_name AS store_name FROM customer")
def src02(spark: SparkSession, d: str) -> DataFrame:
    return readers.mapped(table(spark, d, "customer"), {"c_custkey": "store_id", "c_name": "store_name"})


@register("src07_query_by_path", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def src07(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT n_regionkey, count(*) AS n FROM parquet.`{d}/nation.parquet` GROUP BY n_regionkey")


@register("src08_registered_frame", "SELECT v.code, count(*) AS n FROM (VALUES ('AUTOMOBILE'), ('BUILDING')) v(code) JOIN customer ON c_mktsegment = v.code GROUP BY 1")
def src08(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("brindle_customer")
    return spark.sql("SELECT v.code, count(*) AS n FROM VALUES ('AUTOMOBILE'), ('BUILDING') AS v(code) JOIN brindle_customer ON c_mktsegment = v.code GROUP BY v.code")


@register("src10_finite_or_null", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events")
def src10(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return readers.finite_or_null(table(spark, d, "events").select("event_id", odd.alias("value")))


@register("src11_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 200")
def src11(spark: SparkSession, d: str) -> DataFrame:
    return readers.page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 200, 100)


@register("src15_keyed_lookup", "SELECT o_orderkey, o_totalprice, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS age_days FROM orders WHERE o_orderkey = 5")
def src15(spark: SparkSession, d: str) -> DataFrame:
    row = readers.lookup(table(spark, d, "orders"), o_orderkey=5)
    return row.select("o_orderkey", "o_totalprice", F.datediff(F.to_date(F.lit("2002-01-01")), F.to_date("o_orderdate")).alias("age_days"))


@register("snk01_dataset_metadata", oracle("SELECT count(*) AS n_rows, 7 AS n_columns, count(*) - count(DISTINCT (d, cell_id, category)) AS n_duplicate_keys, min(d)::VARCHAR AS first_day, max(d)::VARCHAR AS last_day, 'units' AS targets FROM grid", "grid"))
def snk01(spark: SparkSession, d: str) -> DataFrame:
    return sinks.metadata(roles.grid(spark, d), ["d", "cell_id", "category"], "d", ["units"])




def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of the events: every 11th negative, every 13th malformed, every 17th without its id, every 5th twice."""
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("sale_id"), F.col("user_id").alias("store_id"), (F.col("event_id") % 7).alias("sku_id"), (F.col("event_id") % 50).cast("string").alias("quantity_units"), F.when(F.col("event_id") % 11 == 0, "-1").otherwise("2.5").alias("unit_price"), F.to_date("ts").alias("sale_date"))
    raw = replay.worked_out(replay.sale_event(e), F.get_json_object("raw", "$.payload.sale_id").cast("long").alias("k"))
    spoilt = F.when(F.col("k") % 13 == 0, F.concat(F.lit("{bad"), F.col("raw"))).when(F.col("k") % 17 == 0, F.regexp_replace("raw", '"event_id":"[^"]*",', "")).otherwise(F.col("raw"))
    twice = F.explode(F.when(F.col("k") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return raw.select("k", spoilt.alias("raw"), twice.alias("copy")).drop("copy")


_REASON = "CASE WHEN event_id % 13 = 0 THEN 'invalid_json' WHEN event_id % 17 = 0 THEN 'missing_envelope_fields:event_id' WHEN event_id % 11 = 0 THEN 'negative_value' END"
_TWICE = "(SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 5 = 0)"


@register("st01_envelope_reasons", f"SELECT coalesce({_REASON}, 'accepted') AS reason, count(*) AS n FROM {_TWICE} GROUP BY 1")
def st01(spark: SparkSession, d: str) -> DataFrame:
    return replay.validate(_messages(spark, d)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("st03_idempotent_ledger", f"SELECT event_id AS sale_id, count(*) AS n_rows FROM events WHERE ({_REASON}) IS NULL GROUP BY 1")
def st03(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of the same messages: every accepted sale once.  The messages are checked once and stored."""
    stored = f"{shared_folder(spark)}/accepted"
    replay.accepted(replay.validate(_messages(spark, d))).write.parquet(stored)
    batch = spark.read.parquet(stored)
    first = replay.upsert_new(batch, None)
    again = replay.upsert_new(batch, first)
    return first.unionByName(again).groupBy("sale_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("st04_dead_letters", f"SELECT {_REASON} AS reason, count(*) AS n FROM {_TWICE} WHERE ({_REASON}) IS NOT NULL GROUP BY 1")
def st04(spark: SparkSession, d: str) -> DataFrame:
    return replay.rejected(replay.validate(_messages(spark, d))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("st06_stream_drain", f"SELECT count(*) FILTER (WHERE ({_REASON}) IS NULL) AS n_ledger, (SELECT count(*) FROM {_TWICE} WHERE ({_REASON}) IS NOT NULL) AS n_dead FROM events")
def st06(spark: SparkSession, d: str) -> DataFrame:
    """The messages as a stream of files, drained twice under fresh checkpoints: the second pass adds nothing to ledger and dead letters."""
    folder = shared_folder(spark)
    _messages(spark, d).select("raw").write.parquet(f"{folder}/in")
    # As many files as the events have splits, so that no task's share grows with them; two batches, for each reads the ledger.
    half = max(-(-len(spark.read.parquet(f"{folder}/in").inputFiles()) // 2), 1)
    for k in (1, 2):
        stream = spark.readStream.schema("raw string").option("maxFilesPerTrigger", half).parquet(f"{folder}/in")
        replay.drain(stream, f"{folder}/ledger", f"{folder}/dead", f"{folder}/checkpoint{k}")
    return spark.read.parquet(f"{folder}/ledger").agg(F.count(F.lit(1)).alias("n_ledger")).crossJoin(spark.read.parquet(f"{folder}/dead").agg(F.count(F.lit(1)).alias("n_dead")))


@register("st07_counters", f"SELECT count(*) FILTER (WHERE ({_REASON}) IS NULL) AS n_accepted, count(*) FILTER (WHERE ({_REASON}) IS NOT NULL) AS n_rejected FROM {_TWICE}")
def st07(spark: SparkSession, d: str) -> DataFrame:
    return replay.counters(replay.validate(_messages(spark, d)))


@register("st10_tumbling_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st10(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts: an extension, in its batch form."""
    return replay.tumbling(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("st11_session_windows", "SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true))::INT AS fresh FROM events)) GROUP BY user_id, s")
def st11(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users: an extension, in its batch form."""
    out = replay.sessions(table(spark, d, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_event")})

"""The event log read as a stream to its end, by state variables; the SQL reads it at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators.lineage import shared_dir
from rentgrid.plans.stand_in import table
from rentgrid.streaming import processors


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream; by a pattern, as a table may be one file, which can't be a stream's folder."""
    df = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"} or {"event_id": F.col("event_id")})


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as listings: an error is a snapshot without them, any other event shows them at a price."""
    seen = F.col("event_type") != "error"
    rows = stream(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("event_at"), seen.alias("seen"), F.when(seen, F.floor(F.col("value") / 40) * 40).cast("double").alias("rent_eur"))
    out = processors.listing_events(rows)
    return processors.replayed(out, _folder(spark), out).select("listing_id", F.unix_micros("event_at").alias("at"), "event_type", "old_value", "new_value")


STREAMED_EVENTS = """
WITH o AS (SELECT user_id, event_id, ts, event_type <> 'error' AS seen, CASE WHEN event_type <> 'error' THEN floor(value / 40) * 40 END::BIGINT AS p FROM events),
 h AS (SELECT *, coalesce(bool_or(seen) OVER w, false) AS known, lag(seen) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, last_value(p IGNORE NULLS) OVER w AS q FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT user_id, ts, 'disappeared' AS event_type, '1' AS old_value, '0' AS new_value FROM h WHERE NOT seen AND known AND was UNION ALL SELECT user_id, ts, 'new', NULL, p::VARCHAR FROM h WHERE seen AND NOT known
  UNION ALL SELECT user_id, ts, 'reappeared', '0', '1' FROM h WHERE seen AND known AND NOT was UNION ALL SELECT user_id, ts, 'price_changed', q::VARCHAR, p::VARCHAR FROM h WHERE seen AND known AND p <> q)
SELECT user_id::VARCHAR AS listing_id, epoch_us(ts) AS at, event_type, old_value, new_value FROM e"""


def streamed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources, every event a check; without a cool-down each further check in the same trouble repeats it."""
    e = stream(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("source"), F.col("ts").alias("checked_at"), (F.col("value") < 60).alias("attention"), (F.col("value") / 30).cast("int").cast("string").alias("status_key"))
    out = processors.health_transitions(rows, 0)
    return processors.replayed(out, _folder(spark), out).select("source", F.unix_micros("checked_at").alias("at"), "kind")


STREAMED_HEALTH = """
WITH c AS (SELECT user_id::VARCHAR AS source, ts, event_id, value < 60 AS bad, trunc(value / 30)::INT AS label FROM events),
 h AS (SELECT *, coalesce(lag(bad) OVER w, false) AS was, lag(label) OVER w AS old FROM c WINDOW w AS (PARTITION BY source ORDER BY ts, event_id))
SELECT source, epoch_us(ts) AS at, CASE WHEN bad AND (NOT was OR label <> old) THEN 'new_bad' WHEN bad THEN 'repeated' ELSE 'recovered' END AS kind FROM h WHERE bad OR was"""

QUERIES = {f.__name__: f for f in (streamed_events, streamed_health)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

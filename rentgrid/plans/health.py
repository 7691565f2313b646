"""Freshness, run logs, transitions, volume guards and activity over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators import coverage, health, windows, writes
from rentgrid.plans.stand_in import LISTING_SQL, RUN_SQL, listings, runs, table

REFERENCE = "2024-01-31 12:00:00"
EXPECTED = ["click", "error", "heartbeat", "purchase", "signup", "view"]


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.expr("case event_type when 'error' then interval 5 days when 'signup' then interval 2 days else interval 0 days end")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts") - late)
    stats = health.source_stats(e, "event_type", "ts", F.col("user_id") % 10 != 0, F.when(F.col("value") > 5, "img"))
    out = health.classify_sources(stats, EXPECTED, F.lit(REFERENCE).cast("timestamp"), ["error", "heartbeat"], ["signup"])
    return out.select("source", "total_rows", "active_rows", "active_with_image", "age_hours", "status", "severity", "is_critical")


SOURCE_HEALTH = """
WITH e AS (SELECT event_type, user_id, value, ts - CASE event_type WHEN 'error' THEN INTERVAL 5 DAY WHEN 'signup' THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS ts FROM events),
 s AS (SELECT event_type AS source, count(*) AS total_rows, count(*) FILTER (user_id % 10 <> 0) AS active_rows,
        count(*) FILTER (user_id % 10 <> 0 AND value > 5) AS active_with_image, max(ts) AS seen FROM e GROUP BY 1),
 x AS (SELECT n.source, coalesce(total_rows, 0) AS total_rows, coalesce(active_rows, 0) AS active_rows, coalesce(active_with_image, 0) AS active_with_image,
        round_even(epoch_us(TIMESTAMP '2024-01-31 12:00:00') / 3.6e9 - epoch_us(seen) / 3.6e9, 2) AS age_hours
       FROM (SELECT unnest(['click','error','heartbeat','purchase','signup','view']) AS source) n LEFT JOIN s USING (source)),
 y AS (SELECT *, CASE WHEN active_rows = 0 THEN 'empty' WHEN age_hours IS NULL THEN 'unknown' WHEN age_hours <= 36 THEN 'fresh' WHEN age_hours <= 96 THEN 'aging' ELSE 'stale' END AS status,
        source IN ('error', 'heartbeat') AS is_critical FROM x)
SELECT source, total_rows, active_rows, active_with_image, age_hours, status, is_critical,
 CASE WHEN source = 'signup' AND status IN ('aging', 'stale') THEN 'high' WHEN status IN ('empty', 'unknown') THEN 'medium' WHEN status = 'fresh' THEN 'ok'
      WHEN status = 'aging' THEN 'warning' WHEN is_critical THEN 'high' ELSE 'warning' END AS severity FROM y"""


def source_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = source_health(spark, sf_dir)
    state = now.select(
        "source", (F.col("source").isin("error", "view")).alias("attention"), F.when(F.col("source") == "error", "stale|high").otherwise("fresh|ok").alias("status_key"),
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("last_alerted_at"),
    )
    now = now.withColumn("is_critical", F.col("source").isin("error", "heartbeat", "view"))
    return health.transitions(now, state, F.lit(REFERENCE).cast("timestamp"), 6).select("source", "status", "severity", "kind", "attention")


SOURCE_TRANSITIONS = (
    "WITH h AS (" + SOURCE_HEALTH + """),
 c AS (SELECT source, status, severity, source IN ('error', 'heartbeat', 'view') AND severity <> 'ok' AS attention, status || '|' || severity AS k,
        source IN ('error', 'view') AS was, CASE WHEN source = 'error' THEN 'stale|high' ELSE 'fresh|ok' END AS old FROM h)
SELECT source, status, severity, attention, CASE WHEN attention AND (NOT was OR k <> old) THEN 'new_bad' WHEN attention THEN 'repeated' WHEN was THEN 'recovered' END AS kind FROM c"""
)


def run_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.run_alerts(runs(spark, sf_dir), [*EXPECTED], F.lit("2024-02-01 00:00:00").cast("timestamp"), 30, collapse=0.1)


RUN_ALERTS = f"""
WITH {RUN_SQL}, n AS (SELECT unnest(['click','error','heartbeat','purchase','signup','view']) AS source),
 r AS (SELECT *, statut = 'ok' AND n_rows > 0 AS ok, row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) AS rn FROM run),
 g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) AS k FROM r WHERE ok),
 a AS (SELECT source, max(ran_at) FILTER (k = 1) AS ok_at, max(structure_hash) FILTER (k = 1) AS h, max(n_rows) FILTER (k = 1) AS nr,
        list(structure_hash) FILTER (k BETWEEN 2 AND 14) AS hs, median(n_rows) FILTER (k BETWEEN 2 AND 14) AS med FROM g GROUP BY 1),
 z AS (SELECT n.source, l.ok AS latest_ok, l.source IS NULL AS none, a.* EXCLUDE (source) FROM n LEFT JOIN (SELECT * FROM r WHERE rn = 1) l ON l.source = n.source LEFT JOIN a ON a.source = n.source)
SELECT source, 'no_runs' AS kind FROM z WHERE none UNION ALL SELECT source, 'latest_not_ok' FROM z WHERE NOT none AND NOT latest_ok
UNION ALL SELECT source, 'no_ok_runs' FROM z WHERE ok_at IS NULL UNION ALL SELECT source, 'stale_ok_run' FROM z WHERE epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ok_at) > 30 * 3.6e9
UNION ALL SELECT source, 'structure_hash_changed' FROM z WHERE h IS NOT NULL AND len(hs) > 0 AND NOT list_contains(hs, h)
UNION ALL SELECT source, 'n_rows_collapse' FROM z WHERE med > 0 AND nr < med * 0.9"""


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writes.latest(runs(spark, sf_dir), ["source"], [F.desc("ran_at"), F.desc("id")], keep=3)
    return out.select("source", "id", "n_rows", "statut")


LATEST_RUNS = f"WITH {RUN_SQL} SELECT source, id, n_rows, statut FROM run QUALIFY row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) <= 3"


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.keep_latest(runs(spark, sf_dir), "source", "ran_at", "id", 5).select("source", "id")


RETENTION = f"WITH {RUN_SQL} SELECT source, id FROM run QUALIFY row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) > 5"


def volume_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return writes.volume_guard(rows, rows.where("not (source_site = 'src3' and rooms > 2) and not (source_site = 'src4' and rooms = 1)"), "source_site", ["src3", "src4"])


VOLUME_GUARD = f"""
WITH {LISTING_SQL}, b AS (SELECT source_site AS source, count(*) AS before, count(*) FILTER (NOT (source_site = 'src3' AND rooms > 2) AND NOT (source_site = 'src4' AND rooms = 1)) AS after FROM listing GROUP BY ROLLUP (source_site)),
 d AS (SELECT *, greatest(0.0, (before - after) * 100.0 / before) AS drop_pct FROM b)
SELECT source, before, after, drop_pct, CASE WHEN source IS NULL THEN drop_pct > 15 WHEN source IN ('src3', 'src4') THEN drop_pct > 35 ELSE false END AS refused FROM d"""


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "signup", F.col("ts")).alias("opened"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("closed"))
    return coverage.daily_activity(e, "opened", "closed", F.lit("2024-02-03")).select(F.col("day").cast("string").alias("day"), "entries", "exits")


DAILY_ACTIVITY = """
SELECT CAST(d AS VARCHAR) AS day, (SELECT count(*) FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) = d) AS entries,
 (SELECT count(*) FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = d) AS exits
FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS d)"""


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return coverage.movements(u, "first", "last", F.col("user_id") % 3 != 0, F.lit("2024-02-01 00:00:00"), days=7, long_days=25)


MOVEMENTS = """
WITH u AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1), t AS (SELECT TIMESTAMP '2024-02-01' AS now)
SELECT count(*) FILTER (f >= now - INTERVAL 7 DAY) AS "new", count(*) FILTER (user_id % 3 = 0) AS gone, count(*) FILTER (user_id % 3 = 0 AND l >= now - INTERVAL 7 DAY) AS gone_recently,
 count(*) FILTER (user_id % 3 <> 0) AS active, count(*) FILTER (user_id % 3 <> 0 AND f < now - INTERVAL 25 DAY) AS long_running FROM u, t"""


def per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = coverage.per_source(e, "event_type", F.col("user_id") % 4 != 0, F.col("value") > 10, "ts")
    return out.select("event_type", "total", "active", "detail_read", F.unix_micros("latest").alias("latest"))


PER_SOURCE = "SELECT event_type, count(*) AS total, count(*) FILTER (user_id % 4 <> 0) AS active, count(*) FILTER (value > 10) AS detail_read, epoch_us(max(ts)) AS latest FROM events GROUP BY 1"


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("w.start").alias("start"), "event_type", "n")


HOURLY_COUNTS = "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def props_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON path with a type guard: what is no number or no JSON counts as missing."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"), F.max(k).alias("max_k"))


PROPS_BY_TYPE = "SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, count(k) AS n_k, max(k) AS max_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (source_health, source_transitions, run_alerts, latest_runs, retention, volume_guard, daily_activity, movements, per_source, hourly_counts, props_by_type)
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

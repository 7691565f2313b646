"""Snapshots, journals and table writes over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.operators import history, writes
from rentgrid.plans.stand_in import table

AT = "2024-02-01 00:00:00"

#: The table before (every order but each fifth, each seventh inactive) and the snapshot (every order but
#: each eighth, each third dearer, each eleventh without a price).
OLD = {"id": "cast(o_orderkey as string)", "active": "o_orderkey % 7 <> 0", "rent_eur": "cast(o_totalprice as bigint)"}
NEW = {"id": "cast(o_orderkey as string)", "rent_eur": "case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 0 then cast(o_totalprice as bigint) + 50 else cast(o_totalprice as bigint) end"}
_SQL = f"""old AS (SELECT {', '.join(f'{e} AS {n}' for n, e in OLD.items())} FROM orders WHERE o_orderkey % 5 <> 0), nu AS (SELECT {', '.join(f'{e} AS {n}' for n, e in NEW.items())} FROM orders WHERE o_orderkey % 8 <> 0),
 j AS (SELECT coalesce(o.id, n.id) AS id, o.id IS NOT NULL AS known, n.id IS NOT NULL AS seen, coalesce(o.active, false) AS was, o.rent_eur AS op, n.rent_eur AS np FROM old o FULL JOIN nu n ON o.id = n.id),
 e AS (SELECT id, 'new' AS t, NULL::VARCHAR AS a, np::VARCHAR AS b FROM j WHERE seen AND NOT known UNION ALL SELECT id, 'reappeared', '0', '1' FROM j WHERE seen AND known AND NOT was
  UNION ALL SELECT id, 'price_changed', op::VARCHAR, np::VARCHAR FROM j WHERE seen AND known AND op <> np UNION ALL SELECT id, 'disappeared', '1', '0' FROM j WHERE NOT seen AND was)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.floor("o_totalprice"))
    state = o.where("o_orderkey % 5 <> 0").selectExpr(*[f"{e} AS {n}" for n, e in OLD.items()], "timestamp'2024-01-01' AS first_seen_at", "timestamp'2024-01-01' AS last_seen_at")
    batch = o.where("o_orderkey % 8 <> 0").selectExpr(*[f"{e} AS {n}" for n, e in NEW.items()])
    return history.snapshot(state, batch, F.lit(AT).cast("timestamp"))


_FLOOR = _SQL.replace("cast(o_totalprice as bigint)", "cast(floor(o_totalprice) as bigint)")


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.events_of(_diff(spark, sf_dir)).select("listing_id", "event_type", "old_value", "new_value")


SNAPSHOT_EVENTS = f"WITH {_FLOOR} SELECT id AS listing_id, t AS event_type, a AS old_value, b AS new_value FROM e"


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.snapshot_counts(_diff(spark, sf_dir))


SNAPSHOT_COUNTS = f"""WITH {_FLOOR} SELECT (SELECT count(*) FROM j WHERE seen) AS processed, count(*) FILTER (t = 'new') AS "new", count(*) FILTER (t = 'price_changed') AS price_changed, count(*) FILTER (t = 'reappeared') AS reappeared,
 count(*) FILTER (t = 'disappeared') AS disappeared, (SELECT count(*) FROM j WHERE seen AND known AND NOT coalesce(op <> np, false)) AS unchanged FROM e"""


def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.next_state(_diff(spark, sf_dir))
    return out.select("id", "active", "rent_eur", F.unix_micros("first_seen_at").alias("first_seen"), F.unix_micros("last_seen_at").alias("last_seen"))


SNAPSHOT_STATE = f"""WITH {_FLOOR}, k AS (SELECT epoch_us(TIMESTAMP '2024-01-01') AS t0, epoch_us(TIMESTAMP '{AT}') AS t1)
SELECT id, seen AS active, CASE WHEN seen THEN np ELSE op END AS rent_eur, CASE WHEN known THEN t0 ELSE t1 END AS first_seen, CASE WHEN seen THEN t1 ELSE t0 END AS last_seen FROM j, k"""

#: The event log as a journal: purchases change a price, errors are disappearances, signups reappearances.
JOURNAL = {
    "event_id": "event_id", "listing_id": "cast(user_id as string)", "event_at": "ts",
    "event_type": "case event_type when 'purchase' then 'price_changed' when 'error' then 'disappeared' when 'signup' then 'reappeared' else 'new' end",
    "old_value": "cast(cast(floor(value * 10) as bigint) as string)", "new_value": "cast(cast(floor(value * 10) as bigint) + (event_id * 7) % 21 - 10 as string)",
}
_J = "ev AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in JOURNAL.items()) + " FROM events), sh AS (SELECT * FROM ev WHERE event_type <> 'new')"


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in JOURNAL.items()]).where("event_type <> 'new'")


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.lifecycle(_journal(spark, sf_dir))
    return out.select(
        "event_id", F.unix_micros("last_disappeared_at").alias("gone_at"), F.unix_micros("last_reappeared_at").alias("back_at"), F.unix_micros("next_reappeared_at").alias("next_at"),
        "status_event_count", "price_event_count", "offline_days", "near_event_id",
    )


LIFECYCLE = f"""
WITH {_J}, w AS (SELECT *, last_value(CASE WHEN event_type = 'disappeared' THEN event_at END IGNORE NULLS) OVER b AS gone, last_value(CASE WHEN event_type = 'reappeared' THEN event_at END IGNORE NULLS) OVER b AS back,
  first_value(CASE WHEN event_type = 'reappeared' THEN event_at END IGNORE NULLS) OVER a AS nxt, count(*) FILTER (event_type <> 'price_changed') OVER p AS s, count(*) FILTER (event_type = 'price_changed') OVER p AS c
  FROM sh WINDOW b AS (PARTITION BY listing_id ORDER BY event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY listing_id ORDER BY event_at, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY listing_id)),
 n AS (SELECT x.event_id, arg_min(y.event_id, (abs(epoch_us(x.event_at) - epoch_us(y.event_at)), y.event_id)) AS near FROM sh x JOIN sh y ON x.listing_id = y.listing_id AND y.event_type = 'price_changed' AND x.event_type <> 'price_changed'
  AND abs(epoch_us(x.event_at) - epoch_us(y.event_at)) <= 72 * 3600 * 1000000::BIGINT GROUP BY 1)
SELECT w.event_id, epoch_us(gone) AS gone_at, epoch_us(back) AS back_at, epoch_us(CASE WHEN nxt > event_at THEN nxt END) AS next_at, s AS status_event_count, c AS price_event_count,
 CASE WHEN event_type = 'reappeared' THEN round_even((epoch_us(event_at) - epoch_us(gone)) / 1e6 / 86400, 2) END AS offline_days, near AS near_event_id FROM w LEFT JOIN n USING (event_id)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 80 events, then by priority: the limit is the feature."""
    return history.journal(_journal(spark, sf_dir)).select("event_id", "event_type", "delta_eur", "direction", "severity", "priority")


JOURNAL_SQL = f"""
WITH {_J}, n AS (SELECT *, new_value::BIGINT - old_value::BIGINT AS d FROM sh ORDER BY event_at DESC, event_id DESC LIMIT 80),
 m AS (SELECT n.*, EXISTS (SELECT 1 FROM sh y WHERE y.listing_id = n.listing_id AND y.event_type = 'price_changed' AND abs(epoch_us(y.event_at) - epoch_us(n.event_at)) <= 72 * 3600 * 1000000::BIGINT) AS near FROM n)
SELECT event_id, event_type, CASE WHEN event_type = 'price_changed' THEN d END AS delta_eur, CASE WHEN event_type <> 'price_changed' THEN NULL WHEN d < 0 THEN 'down' WHEN d > 0 THEN 'up' ELSE 'same' END AS direction,
 CASE WHEN event_type = 'price_changed' AND d < 0 THEN 'positive' WHEN event_type = 'disappeared' THEN 'watch' ELSE 'info' END AS severity,
 CASE WHEN event_type = 'price_changed' AND d < 0 THEN 0 WHEN event_type = 'price_changed' THEN 1 WHEN event_type = 'reappeared' AND near THEN 2 WHEN event_type = 'reappeared' THEN 3 ELSE 4 END AS priority FROM m"""


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in JOURNAL.items()])
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(N.as_int(F.col("new_value")) - N.as_int(F.col("old_value"))).alias("delta"))


EVENT_COUNTS = f"WITH {_J} SELECT event_type, count(*) AS n, CAST(sum(new_value::BIGINT - old_value::BIGINT) AS BIGINT) AS delta FROM ev GROUP BY 1"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table of customers, and a batch with repeated keys in which every fourth name is empty."""
    c = table(spark, sf_dir, "customer")
    base = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS site_id", "c_name AS title", "c_acctbal AS prix", "timestamp'2024-01-01' AS first_seen_at", "timestamp'2024-01-01' AS updated_at")
    twice = c.where("c_custkey % 4 <> 1").withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2))))
    return base, twice.selectExpr("case when c_custkey % 50 = 2 then null else c_custkey end AS site_id", "case when c_custkey % 4 = 0 then '' else concat(c_name, '/', cast(pos as string)) end AS title", "case when c_custkey % 6 = 0 then null else c_acctbal + pos end AS prix", "pos")


_T = """b AS (SELECT c_custkey AS k, c_name AS t, c_acctbal AS p FROM customer WHERE c_custkey % 3 <> 0),
 n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || '/2' END AS t, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal + 2 END AS p FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 50 <> 2)"""


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = _tables(spark, sf_dir)
    out = writes.upsert(base, batch, ["site_id"], F.lit(AT).cast("timestamp"), "pos")
    return out.select("site_id", "title", "prix", F.unix_micros("first_seen_at").alias("first_seen"), F.unix_micros("updated_at").alias("updated"))


UPSERT = f"""WITH {_T}, k AS (SELECT epoch_us(TIMESTAMP '2024-01-01') AS t0, epoch_us(TIMESTAMP '{AT}') AS t1)
SELECT coalesce(b.k, n.k) AS site_id, CASE WHEN n.k IS NULL THEN b.t ELSE n.t END AS title, CASE WHEN n.k IS NULL THEN b.p ELSE n.p END AS prix, CASE WHEN b.k IS NULL THEN t1 ELSE t0 END AS first_seen,
 CASE WHEN n.k IS NULL THEN t0 ELSE t1 END AS updated FROM b FULL JOIN n ON b.k = n.k, k"""


def upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = _tables(spark, sf_dir)
    one = writes.latest(batch.dropna(subset=["site_id"]), ["site_id"], [F.desc("pos")])
    digest = lambda d, p: d.withColumn("content_hash", F.sha2(F.coalesce(p.cast("decimal(18,2)").cast("string"), F.lit("")), 256))
    out = writes.upsert_status(digest(base, F.col("prix")), digest(one, F.when(F.col("site_id") % 2 == 0, F.col("prix")).otherwise(F.col("prix") - 2)), ["site_id"])
    return out.groupBy("status").agg(F.count("*").alias("n"))


UPSERT_STATUS = f"""WITH {_T} SELECT CASE WHEN b.k IS NULL THEN 'new' WHEN n.k % 2 = 1 AND n.p IS NOT NULL THEN 'seen' ELSE 'changed' END AS status, count(*) AS n FROM n LEFT JOIN b ON b.k = n.k GROUP BY 1"""


def upsert_richer(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = _tables(spark, sf_dir)
    one = writes.latest(batch.dropna(subset=["site_id"]), ["site_id"], [F.desc("pos")]).drop("pos")
    return writes.upsert_richer(base.drop("first_seen_at", "updated_at"), one, ["site_id"])


UPSERT_RICHER = f"WITH {_T} SELECT coalesce(b.k, n.k) AS site_id, coalesce(nullif(n.t, ''), b.t) AS title, coalesce(n.p, b.p) AS prix FROM b FULL JOIN n ON b.k = n.k"


def deactivate_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS source_site", "c_custkey AS source_id", "case when c_custkey % 9 = 0 then cast(null as int) else 1 end AS is_active")
    seen = c.where("source_id % 4 <> 0")
    return writes.deactivate_unseen(c, seen, "MACHINERY").groupBy("source_site", "is_active").agg(F.count("*").alias("n"))


DEACTIVATE_UNSEEN = "SELECT c_mktsegment AS source_site, CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 4 = 0 THEN 0 ELSE 1 END AS is_active, count(*) AS n FROM customer GROUP BY 1, 2"


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return writes.insert_new(c.where("c_custkey % 3 = 0").select("c_custkey"), c.unionByName(c).select("c_custkey", "c_name"), ["c_custkey"])


INSERT_NEW = "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0"


def upsert_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.skipped(_tables(spark, sf_dir)[1], ["site_id"])


UPSERT_SKIPPED = "SELECT 2 * count(*) AS processed, 2 * count(*) FILTER (c_custkey % 50 = 2) AS skipped FROM customer WHERE c_custkey % 4 <> 1"

QUERIES = {
    f.__name__: f
    for f in (
        snapshot_events, snapshot_counts, snapshot_state, lifecycle, journal, event_counts, upsert, upsert_status, upsert_richer, deactivate_unseen, insert_new, upsert_skipped,
    )
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n != "journal"} | {"journal": JOURNAL_SQL}

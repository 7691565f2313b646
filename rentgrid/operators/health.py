"""Freshness of sources, run logs and alerts on their changes of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N

FRESH_HOURS, STALE_HOURS = 36, 96


def source_stats(df: DataFrame, source: str = "source_site", seen: str = "seen_last_at", active: Column | None = None, image: Column | None = None) -> DataFrame:
    """Per source: total, active and active-with-image rows, and the last time anything was seen."""
    on = F.coalesce(active, F.lit(True)) if active is not None else F.lit(True)
    pic = on & F.coalesce(F.trim(image) != "", F.lit(False)) if image is not None else F.lit(False)
    return df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("total_rows"), F.count_if(on).alias("active_rows"), F.count_if(pic).alias("active_with_image"), F.max(seen).alias("last_seen_at")
    )


def classify_sources(stats: DataFrame, expected: list[str], now: Column, critical: list[str], watched: list[str] | None = None) -> DataFrame:
    """Sources with age, status and severity; expected ones that have no row are empty.

    fresh up to 36 hours, aging up to 96, then stale; stale is high for critical sources, and aging or
    stale is high for the watched ones."""
    spark = stats.sparkSession
    names = spark.createDataFrame([(s,) for s in expected], "source string") if expected else stats.select("source").limit(0)
    s = stats.join(F.broadcast(names), "source", "full_outer")
    age = N.half_even((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))) / 3.6e9, 2)
    rows = F.coalesce("active_rows", F.lit(0)).cast("long")
    s = s.withColumns({"total_rows": F.coalesce("total_rows", F.lit(0)).cast("long"), "active_rows": rows, "active_with_image": F.coalesce("active_with_image", F.lit(0)).cast("long"), "age_hours": age})
    a = F.col("age_hours")
    status = F.when(F.col("active_rows") == 0, "empty").when(a.isNull(), "unknown").when(a <= FRESH_HOURS, "fresh").when(a <= STALE_HOURS, "aging").otherwise("stale")
    is_critical = F.col("source").isin(*critical) if critical else F.lit(False)
    s = s.withColumns({"status": status, "is_critical": is_critical})
    high = F.col("source").isin(*watched) & F.col("status").isin("aging", "stale") if watched else F.lit(False)
    severity = (
        F.when(high, "high").when(F.col("status").isin("empty", "unknown"), "medium").when(F.col("status") == "fresh", "ok")
        .when(F.col("status") == "aging", "warning").when(F.col("is_critical"), "high").otherwise("warning")
    )
    return s.withColumn("severity", severity).select("source", "total_rows", "active_rows", "active_with_image", "last_seen_at", "age_hours", "status", "severity", "is_critical")


def smoke_status(tested: DataFrame, covered: DataFrame, health: DataFrame) -> DataFrame:
    """Health rows with how their source was last tested: by its own test, only in a report, or not at all."""
    c = covered.select("source", F.lit(True).alias("_c"))
    ids = tested.agg(F.array_join(F.collect_set("id"), " ").alias("_ids"))  # ids of test runs: a short list
    direct = F.contains(F.lower("_ids"), F.lower("source"))
    status = F.when(F.col("_c"), "covered-by-db-report").when(direct, "directly-tested").otherwise("not-tested")
    return health.join(F.broadcast(c), "source", "left").crossJoin(F.broadcast(ids)).withColumn("smoke_status", status).drop("_c", "_ids")


def needs_attention(df: DataFrame) -> Column:
    bad = F.col("status").isin("stale", "aging", "empty", "unknown") | F.col("severity").isin("high", "medium", "warning")
    return F.coalesce(F.col("is_critical") & bad & (F.col("severity") != "ok"), F.lit(False))


def transitions(health: DataFrame, state: DataFrame, now: Column, cooldown_hours: int) -> DataFrame:
    """Health against the previous state: kind (new_bad, recovered, repeated or null) and the next state.

    state: (source, attention, status_key, last_alerted_at).  A source stays quiet within the cooldown
    while nothing changes."""
    key = F.concat_ws("|", "status", "severity")
    cur = health.withColumns({"now_bad": needs_attention(health), "key": key})
    j = cur.join(state.select("source", F.col("attention").alias("was_bad"), F.col("status_key").alias("old_key"), "last_alerted_at"), "source", "left")
    was = F.coalesce("was_bad", F.lit(False))
    cool = F.col("last_alerted_at").isNull() | (N.seconds_between(F.col("last_alerted_at"), now) >= cooldown_hours * 3600)
    kind = (
        F.when(F.col("now_bad") & (~was | ~F.col("key").eqNullSafe(F.col("old_key"))), "new_bad").when(F.col("now_bad") & cool, "repeated")
        .when(~F.col("now_bad") & was, "recovered")
    )
    j = j.withColumn("kind", kind)
    alerted = F.when(F.col("kind").isNotNull(), now.cast("timestamp")).otherwise(F.col("last_alerted_at"))
    return j.select("source", "status", "severity", "kind", F.col("now_bad").alias("attention"), F.col("key").alias("status_key"), alerted.alias("last_alerted_at"))


def quiet_repeats(changes: DataFrame) -> DataFrame:
    """What is sent: new and recovered sources, and repeated ones only if there is nothing else."""
    any_new = changes.agg(F.count_if(F.col("kind").isin("new_bad", "recovered")).alias("_n"))
    return changes.where("kind is not null").crossJoin(F.broadcast(any_new)).where((F.col("kind") != "repeated") | (F.col("_n") == 0)).drop("_n")


def run_alerts(runs: DataFrame, sources: list[str], now: Column, max_age_hours: float, collapse: float = 0.5, keep: int = 14) -> DataFrame:
    """(source, kind): dead-man checks on the run log (id, source, ran_at, statut, n_rows, structure_hash).

    no_runs, latest_not_ok, no_ok_runs, stale_ok_run, structure_hash_changed and n_rows_collapse, the last
    two of the newest good run against the up to ``keep`` - 1 before it."""
    spark: SparkSession = runs.sparkSession
    named = spark.createDataFrame([(s,) for s in sources], "source string")
    good = (F.col("statut") == "ok") & (F.col("n_rows") > 0)
    order = [F.desc("ran_at"), F.desc("id")]
    w = Window.partitionBy("source")
    r = runs.join(F.broadcast(named), "source", "left_semi").withColumns({"ok": F.coalesce(good, F.lit(False)), "rn": F.row_number().over(w.orderBy(*order))})
    r = r.withColumn("ok_rn", F.when(F.col("ok"), F.sum(F.col("ok").cast("int")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))))
    newest, before = F.col("ok_rn") == 1, F.col("ok_rn").between(2, keep)
    s = r.groupBy("source").agg(
        F.bool_or((F.col("rn") == 1) & ~F.col("ok")).alias("bad_latest"), F.max(F.when(newest, F.col("ran_at"))).alias("ok_at"), F.max(F.when(newest, F.col("structure_hash"))).alias("hash"),
        F.max(F.when(newest, F.col("n_rows"))).alias("n"), F.collect_set(F.when(before, F.col("structure_hash"))).alias("hashes"), F.median(F.when(before, F.col("n_rows"))).alias("median"), F.count("*").alias("runs"),
    )
    s = F.broadcast(named).join(s, "source", "left")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ok_at").cast("timestamp"))) / 3.6e9
    kinds = F.array(
        F.when(F.col("runs").isNull(), "no_runs").when(F.col("bad_latest"), "latest_not_ok"), F.when(F.col("ok_at").isNull(), "no_ok_runs").when(age > max_age_hours, "stale_ok_run"),
        F.when(F.col("hash").isNotNull() & (F.size("hashes") > 0) & ~F.array_contains("hashes", F.col("hash")), "structure_hash_changed"), F.when((F.col("median") > 0) & (F.col("n") < F.col("median") * (1 - collapse)), "n_rows_collapse"),
    )
    return s.select("source", F.explode(F.array_compact(kinds)).alias("kind"))

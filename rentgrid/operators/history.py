"""Snapshot differences, the event journal and its lifecycle view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.operators import windows as W

NO_EVENTS = "array<struct<event_type:string,old_value:string,new_value:string>>"


def _events(known: Column, seen: Column, active: Column, old: Column, new: Column) -> Column:
    """The events of one id, in the order in which they are recorded."""
    ev = lambda t, a, b: F.struct(F.lit(t).alias("event_type"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))
    none = F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            F.when(seen & ~known, ev("new", none, new)),
            F.when(seen & known & ~active, ev("reappeared", F.lit(0), F.lit(1))),
            F.when(seen & known & (old != new), ev("price_changed", old, new)),
            F.when(~seen & known & active, ev("disappeared", F.lit(1), F.lit(0))),
        )
    )


def snapshot(state: DataFrame, batch: DataFrame, at: Column, id_col: str = "id", price: str = "rent_eur") -> DataFrame:
    """State and snapshot side by side: id, known, seen, old and new price, was_active, events.

    One full outer join on the id.  A batch's last row of an id counts (by all columns, largest);
    blank ids are skipped.  A price change needs both prices; a reappearing row may change price too."""
    ids = F.nullif(F.trim(F.col(id_col).cast("string")), F.lit(""))
    one = batch.select(ids.alias("id"), F.col(price).cast("long").alias("new_price")).where("id is not null").groupBy("id").agg(F.max("new_price").alias("new_price"))
    s = state.select(F.col("id"), F.col("active").cast("boolean").alias("was_active"), F.col(price).cast("long").alias("old_price"), "first_seen_at", "last_seen_at")
    j = s.withColumn("known", F.lit(True)).join(one.withColumn("seen", F.lit(True)), "id", "full_outer")
    j = j.withColumns({"known": F.coalesce("known", F.lit(False)), "seen": F.coalesce("seen", F.lit(False)), "was_active": F.coalesce("was_active", F.lit(False)), "at": at})
    return j.withColumn("events", _events(F.col("known"), F.col("seen"), F.col("was_active"), F.col("old_price"), F.col("new_price")))


def next_state(diff: DataFrame, price: str = "rent_eur") -> DataFrame:
    """The state after a snapshot: seen rows are active with the new price, a null one included."""
    return diff.select(
        "id", F.col("seen").alias("active"), F.when(F.col("seen"), F.col("new_price")).otherwise(F.col("old_price")).alias(price),
        F.coalesce("first_seen_at", "at").alias("first_seen_at"), F.when(F.col("seen"), F.col("at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def events_of(diff: DataFrame) -> DataFrame:
    """(listing_id, event_type, event_at, old_value, new_value) to append to the journal."""
    return diff.select(F.col("id").alias("listing_id"), F.col("at").alias("event_at"), F.inline("events")).select("listing_id", "event_type", "event_at", "old_value", "new_value")


def snapshot_counts(diff: DataFrame) -> DataFrame:
    """One row: processed, new, price_changed, reappeared, disappeared and unchanged rows.

    Unchanged are the seen known rows without a change of price, reappeared ones included."""
    has = lambda t: F.count_if(F.exists("events", lambda e: e["event_type"] == t)).alias(t)
    same = F.col("seen") & F.col("known") & ~F.exists("events", lambda e: e["event_type"] == "price_changed")
    return diff.agg(F.count_if("seen").alias("processed"), has("new"), has("price_changed"), has("reappeared"), has("disappeared"), F.count_if(same).alias("unchanged"))


def lifecycle(events: DataFrame, hours: int = 72) -> DataFrame:
    """Events with what surrounds them: last disappearance and reappearance before, next reappearance
    after, days offline, the nearest change of price, and counts of the listing's events.

    events: (event_id, listing_id, event_type, event_at, old_value, new_value)."""
    is_ = lambda t: F.col("event_type") == t
    of = lambda t, forward=False: W.as_of(events, ["listing_id"], "event_at", "event_id", is_(t), F.col("event_at"), forward)
    from pyspark.sql import Window

    all_of = Window.partitionBy("listing_id")
    # later events at the very same time are not after the event
    out = events.withColumns(
        {
            "last_disappeared_at": of("disappeared"), "last_reappeared_at": of("reappeared"), "_next": of("reappeared", True),
            "status_event_count": F.count_if(is_("disappeared") | is_("reappeared")).over(all_of), "price_event_count": F.count_if(is_("price_changed")).over(all_of),
        }
    )
    out = out.withColumn("next_reappeared_at", F.when(F.col("_next") > F.col("event_at"), F.col("_next"))).drop("_next")
    out = out.withColumns(
        {
            "offline_days": F.when(is_("reappeared"), N.days_between(F.col("last_disappeared_at"), F.col("event_at"))),
            "offline_days_until_next": F.when(is_("disappeared"), N.days_between(F.col("event_at"), F.col("next_reappeared_at"))),
        }
    )
    prices = events.where(is_("price_changed")).select("event_id", "listing_id", "event_at", "old_value", "new_value")
    # the nearest other change: an event never is its own neighbour
    others = out.where(~is_("price_changed"))
    near = W.nearest_within(others, prices, "listing_id", "event_at", "event_at", ["event_id", "old_value", "new_value"], hours, "event_id", "event_id")
    rest = out.where(is_("price_changed"))
    return near.unionByName(rest, allowMissingColumns=True)


def classify(events: DataFrame) -> DataFrame:
    """Events with delta, direction, severity, mixed (a reappearance near a change of price) and display priority."""
    old, new = N.as_int(F.col("old_value")), N.as_int(F.col("new_value"))
    changed = F.col("event_type") == "price_changed"
    delta = F.when(changed, new - old)
    direction = F.when(delta < 0, "down").when(delta > 0, "up").when(delta == 0, "same")
    mixed = (F.col("event_type") == "reappeared") & F.col("near_event_id").isNotNull() if "near_event_id" in events.columns else F.lit(False)
    out = events.withColumns({"delta_eur": delta, "direction": direction, "mixed": mixed})
    down = F.col("direction") == "down"
    return out.withColumns(
        {
            "severity": F.when(changed & down, "positive").when(F.col("event_type") == "disappeared", "watch").otherwise("info"),
            "priority": F.when(changed & down, 0).when(changed, 1).when(F.col("mixed"), 2).when(F.col("event_type") == "reappeared", 3).otherwise(4),
        }
    )


def journal(events: DataFrame, limit: int = 80) -> DataFrame:
    """The newest ``limit`` events without the new ones, then by priority and recency.

    The limit is taken before the re-sort; the history of just the listings it shows is read."""
    shown = events.where("event_type in ('price_changed', 'disappeared', 'reappeared')")
    newest = shown.orderBy(F.desc("event_at"), F.desc("event_id")).limit(limit).select("event_id", "listing_id")
    history = shown.join(F.broadcast(newest.select("listing_id").distinct()), "listing_id", "left_semi")  # ``limit`` rows at most
    view = classify(lifecycle(history)).join(F.broadcast(newest.select("event_id")), "event_id", "left_semi")
    return view.orderBy("priority", F.desc("event_at"), F.desc("event_id"))

"""Stateful streams: listing snapshots to events, source health to transitions, notices exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "listing_id string, event_at timestamp, event_type string, old_value string, new_value string"


def _step(known: bool, active: bool, price: float | None, seen: bool, new: float | None) -> list[tuple[str, str | None, str | None]]:
    """The events of one observation of one listing."""
    text = lambda v: None if v is None else str(int(v))
    if not seen:
        return [("disappeared", "1", "0")] if known and active else []
    if not known:
        return [("new", None, text(new))]
    out = [] if active else [("reappeared", "0", "1")]
    return out + ([("price_changed", text(price), text(new))] if price is not None and new is not None and price != new else [])


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, active, price = state.exists, False, None
    if known:
        active, price = state.get
    rows = pd.concat(list(batches)).sort_values("event_at", kind="stable")
    out = []
    for at, seen, new in zip(rows["event_at"], rows["seen"], rows["rent_eur"]):
        new = None if pd.isna(new) else float(new)
        out += [(key[0], at, *e) for e in _step(known, active, price, bool(seen), new)]
        if seen:
            known, active, price = True, True, new
        elif known:
            active = False
    if known:
        state.update((active, price))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])


def listing_events(stream: DataFrame) -> DataFrame:
    """Events of a stream of observations (id, event_at, seen, rent_eur); seen is false for a listing that a
    snapshot no longer has.

    The state of a listing is its flag and last price, so memory grows with the number of listings, not
    with their history.  Observations of one batch are taken in time order."""
    return stream.groupBy(F.col("id").cast("string").alias("id")).applyInPandasWithState(_follow, EVENTS, "active boolean, price double", "append", GroupStateTimeout.NoTimeout)


def _changes(cooldown_s: float) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, old, last = state.get if state.exists else (False, "", None)
        out = []
        rows = pd.concat(list(batches)).sort_values("checked_at", kind="stable")
        for at, bad, label in zip(rows["checked_at"], rows["attention"], rows["status_key"]):
            stamp = at.timestamp()
            kind = None
            if bad:
                kind = "new_bad" if not was or label != old else "repeated" if last is None or stamp - last >= cooldown_s else None
            elif was:
                kind = "recovered"
            if kind:
                out.append((key[0], at, kind))
                last = stamp
            was, old = bool(bad), label
        state.update((was, old, last))
        yield pd.DataFrame(out, columns=["source", "checked_at", "kind"])

    return run


def health_transitions(stream: DataFrame, cooldown_hours: float) -> DataFrame:
    """(source, checked_at, kind) of a stream of checks (source, checked_at, attention, status_key)."""
    schema = "source string, checked_at timestamp, kind string"
    return stream.groupBy("source").applyInPandasWithState(_changes(cooldown_hours * 3600), schema, "was boolean, label string, last double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n): counts in windows of event time; rows later than the watermark are dropped by it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def ledger_writer(ledger_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends the pairs a ledger table has not.

    A batch that is replayed after a failure finds its pairs there already, so no pair is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(ledger_path).select(*keys)
        fresh = batch.dropDuplicates(keys).join(old, keys, "left_anti").withColumn("batch", F.lit(number).cast("long"))
        fresh.write.mode("append").parquet(ledger_path)

    return write

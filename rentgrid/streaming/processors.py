"""Stateful streams by state variables with timers: listing events, source health, notices.

State is a value or map for each key in the state store; timers in event time report a silence and clear what has been
quiet for long.  Steps are those of the batch operators, so a stream that is replayed gives
what the batch gives.  Processors see times as microseconds, which mean the same in every worker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rentgrid.streaming.state import EVENTS, _step

#: The state store that keeps state variables.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class ListingEvents(StatefulProcessor):
    """Events of a listing's observations; the state is its flag, its last price and when it went.

    A listing that has been gone for ``forget`` microseconds is forgotten: seen again, it is new.  Its state is cleared by a timer
    in event time, so memory follows the listings that are still of interest."""

    def __init__(self, forget: int | None = None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listed = handle.getValueState("listed", "active boolean, price double, gone long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.listed.exists()
        active, price, gone = self.listed.get() if known else (False, None, None)
        for r in sorted(rows, key=lambda r: r.us):
            if self.forget and known and not active and r.us - gone >= self.forget:
                known, price = False, None
            for kind, old, new in _step(known, active, price, bool(r.seen), r.rent_eur):
                yield Row(listing_id=key[0], us=r.us, event_type=kind, old_value=old, new_value=new)
            if r.seen:
                known, active, price, gone = True, True, r.rent_eur, None
            elif known and active:
                active, gone = False, r.us
        if self.forget:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if not known:
            self.listed.clear()
            return
        self.listed.update((active, price, gone))
        if self.forget and not active:
            self.handle.registerTimer((gone + self.forget) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.listed.clear()
        return iter(())


class HealthTransitions(StatefulProcessor):
    """New, repeated and recovered troubles of a source; a trouble without news is repeated after the cool-down.

    With timers, silence counts as well: a source that is in trouble and is not checked any more is reported when its timer
    fires (in event time, at the watermark)."""

    def __init__(self, cooldown: int, timed: bool = False):
        self.cooldown, self.timed = cooldown, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "bad boolean, label string, alerted long")

    def _wake(self, alerted: int) -> None:
        if self.timed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((alerted + self.cooldown) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        was, old, last = self.last.get() if self.last.exists() else (False, "", None)
        for r in sorted(rows, key=lambda r: r.us):
            kind = None
            if r.attention:
                kind = "new_bad" if not was or r.status_key != old else "repeated" if last is None or r.us - last >= self.cooldown else None
            elif was:
                kind = "recovered"
            if kind:
                last = r.us
                yield Row(source=key[0], us=r.us, kind=kind)
            was, old = bool(r.attention), r.status_key
        self.last.update((was, old, last))
        if was and last is not None:
            self._wake(last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.last.exists():
            was, old, _ = self.last.get()
            if was:
                us = expiredTimerInfo.getExpiryTimeInMs() * 1000
                self.last.update((was, old, us))
                self._wake(us)
                yield Row(source=key[0], us=us, kind="silent")


class Notices(StatefulProcessor):
    """Each (watch, listing) pair once, at most ``most`` a watch and batch, the first by time and listing.

    What goes over the number stays pending in a map and is sent with the next rows of the watch."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "listing_id string", "us long")
        self.pending = handle.getMapState("pending", "listing_id string", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            one = (r.listing_id,)
            if not self.sent.containsKey(one) and not (self.pending.containsKey(one) and self.pending.getValue(one)[0] <= r.us):
                self.pending.updateValue(one, (r.us,))
        waiting = sorted((v[0], k[0]) for k, v in self.pending.iterator())
        for us, listing in waiting[: self.most]:
            self.pending.removeKey((listing,))
            self.sent.updateValue((listing,), (us,))
            yield Row(watch_id=key[0], listing_id=listing, us=us)


def _timed(out: DataFrame, at: str) -> DataFrame:
    """Microseconds as the time they mean, in their place."""
    return out.select(*[F.timestamp_micros("us").alias(at) if c == "us" else F.col(c) for c in out.columns])


def listing_events(stream: DataFrame, forget_hours: float | None = None, late: str = "1 hour") -> DataFrame:
    """Events of observations (id, event_at, seen, rent_eur), as ``state.listing_events``; ``late``: the watermark's delay,
    if listings are to be forgotten."""
    _stateful(stream)
    timed = stream if forget_hours is None else stream.withWatermark("event_at", late)
    rows = timed.select(F.col("id").cast("string").alias("id"), "event_at", F.unix_micros("event_at").alias("us"), "seen", F.col("rent_eur").cast("double").alias("rent_eur"))
    forget = None if forget_hours is None else int(forget_hours * 3_600_000_000)
    schema = EVENTS.replace("event_at timestamp", "us long")
    return _timed(rows.groupBy("id").transformWithState(ListingEvents(forget), schema, "append", "EventTime" if forget else "None"), "event_at")


def health_transitions(stream: DataFrame, cooldown_hours: float, late: str | None = None) -> DataFrame:
    """(source, checked_at, kind) of checks (source, checked_at, attention, status_key); with a watermark delay ``late``
    also ``silent``: in trouble, and no check for the cool-down."""
    _stateful(stream)
    timed = stream.withWatermark("checked_at", late) if late else stream
    rows = timed.withColumn("us", F.unix_micros("checked_at"))
    processor = HealthTransitions(int(cooldown_hours * 3_600_000_000), bool(late))
    return _timed(rows.groupBy("source").transformWithState(processor, "source string, us long, kind string", "append", "EventTime" if late else "None"), "checked_at")


def notices(stream: DataFrame, most: int = 20) -> DataFrame:
    """(watch_id, listing_id, matched_at) of matches (watch_id, listing_id, matched_at), each pair once for good."""
    _stateful(stream)
    rows = stream.select("watch_id", "listing_id", F.unix_micros("matched_at").alias("us"))
    return _timed(rows.groupBy("watch_id").transformWithState(Notices(most), "watch_id string, listing_id string, us long", "append", "None"), "matched_at")


def replayed(stream: DataFrame, folder: str, schema_of: DataFrame) -> DataFrame:
    """Run a stream to the end of what its source has, into Parquet below ``folder``, and read what it gave.

    The checkpoint is there too: a second run goes on where the first one stopped."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return schema_of.sparkSession.read.schema(schema_of.schema).parquet(f"{folder}/out")

"""Streams by state variables: recovery from the checkpoint, cool-downs, timers, time to live, notices once."""

import datetime

import pytest
from pyspark.sql import functions as F

from rentgrid.streaming import processors

T0 = datetime.datetime(2024, 1, 1)
OBSERVED = "id string, event_at timestamp, seen boolean, rent_eur double"


def hour(h):
    return T0 + datetime.timedelta(hours=h)


def feed(spark, folder, number, rows, schema):
    """A further file of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_events_over_a_restart_are_those_of_one_run(spark, tmp_path):
    first = [("a", hour(0), True, 500.0), ("b", hour(0), True, 700.0), ("a", hour(1), False, None), ("c", hour(1), False, None)]
    second = [("a", hour(2), True, 450.0), ("b", hour(2), True, 700.0), ("b", hour(3), True, None), ("b", hour(4), True, 710.0), ("c", hour(4), True, None)]
    want = {("a", "new", None, "500"), ("b", "new", None, "700"), ("a", "disappeared", "1", "0"), ("a", "reappeared", "0", "1"), ("a", "price_changed", "500", "450"), ("c", "new", None, None)}
    halves, whole = str(tmp_path / "halves"), str(tmp_path / "whole")
    for k, part in enumerate((first, second)):
        out = processors.listing_events(feed(spark, halves, k, part, OBSERVED))
        got = processors.replayed(out, halves, out)  # stops at the end; the second run starts from the checkpoint
    out = processors.listing_events(feed(spark, whole, 0, first + second, OBSERVED))
    once = processors.replayed(out, whole, out)
    fields = ("listing_id", "event_type", "old_value", "new_value")
    read = lambda df: sorted((tuple(r) for r in df.select(*fields).collect()), key=str)
    assert read(got) == read(once) == sorted(want, key=str)
    again = processors.listing_events(spark.readStream.schema(OBSERVED).parquet(f"{halves}/in"))
    assert read(processors.replayed(again, halves, again)) == read(once)  # nothing new, nothing twice


def test_a_listing_gone_for_long_is_forgotten(spark, tmp_path):
    folder = str(tmp_path / "s")
    parts = ([("a", hour(0), True, 5.0), ("a", hour(1), False, None), ("b", hour(0), True, 5.0), ("b", hour(1), False, None)], [("b", hour(20), True, 6.0), ("c", hour(30), True, 1.0)], [("a", hour(31), True, 6.0)])
    for k, part in enumerate(parts):
        out = processors.listing_events(feed(spark, folder, k, part, OBSERVED), forget_hours=24)
        got = processors.replayed(out, folder, out)
    kinds = sorted((r.listing_id, r.event_type) for r in got.collect())
    # b came back in time, a's state was cleared by its timer
    assert kinds == [("a", "disappeared"), ("a", "new"), ("a", "new"), ("b", "disappeared"), ("b", "new"), ("b", "price_changed"), ("b", "reappeared"), ("c", "new")]


CHECKED = "source string, checked_at timestamp, attention boolean, status_key string"


def test_health_cools_down_and_reports_silence(spark, tmp_path):
    folder = str(tmp_path / "h")
    first = [("s", hour(0), True, "x"), ("s", hour(1), True, "x"), ("s", hour(2), True, "y"), ("s", hour(9), True, "y"), ("ok", hour(3), False, "f")]
    out = processors.health_transitions(feed(spark, folder, 0, first, CHECKED), 6, late="1 hour")
    got = processors.replayed(out, folder, out)
    assert sorted((r.source, r.checked_at, r.kind) for r in got.collect()) == [("s", hour(0), "new_bad"), ("s", hour(2), "new_bad"), ("s", hour(9), "repeated")]
    # the other source moves the watermark past the cool-down of the first, which was not heard of again
    for k, part in enumerate(([("ok", hour(17), False, "f")], [("ok", hour(18), True, "z"), ("ok", hour(19), False, "f")])):
        out = processors.health_transitions(feed(spark, folder, k, part, CHECKED), 6, late="1 hour")
        got = processors.replayed(out, folder, out)
    kinds = sorted((r.source, r.kind) for r in got.collect())
    assert ("s", "silent") in kinds and ("ok", "new_bad") in kinds and ("ok", "recovered") in kinds


@pytest.mark.parametrize("most", [1, 20])
def test_each_notice_is_sent_once(spark, tmp_path, most):
    folder, schema = str(tmp_path / "n"), "watch_id string, listing_id string, matched_at timestamp"
    parts = ([("w", "l2", hour(1)), ("w", "l1", hour(0)), ("w", "l1", hour(0)), ("v", "l1", hour(5))], [("w", "l1", hour(3)), ("w", "l3", hour(2))], [("w", "l9", hour(8))])
    for k, part in enumerate(parts):
        out = processors.notices(feed(spark, folder, k, part, schema), most)
        got = processors.replayed(out, folder, out)
    sent = sorted((r.watch_id, r.listing_id) for r in got.collect())
    assert sent == ([("v", "l1"), ("w", "l1"), ("w", "l2"), ("w", "l3")] + ([("w", "l9")] if most == 20 else []))
    assert got.select(F.count_distinct("watch_id", "listing_id")).head()[0] == len(sent)

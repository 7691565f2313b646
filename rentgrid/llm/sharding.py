"""Shards of equal size by sampled splitters.

Keys are drawn with a probability in proportion to their size, the quantiles of the sample split
the key space into many ranges, and every record goes to its range.  The ranges are then measured
exactly: a range that holds more than twice the rows it should (one key with many records, or an
unlucky sample) is subdivided by a hash of the record, so no range outgrows a task.  Prefix sums
over the measured ranges and within each give every record its place in the whole order, and the
places are cut into shards of equal size.

By default the key is a hash of the text, so that equal texts are neighbours; a group of equal keys
goes to the shard it begins in, if it takes no more than ``tolerance`` of a shard's size and its
range was not subdivided; any larger group is cut where the shard ends.

Bounds: ``MAX_RANGES`` ranges and ``SAMPLE`` keys reach the driver, whatever the input.

Defined results: a null text has the size ``overhead`` and the checksum of the empty text; sizes
are equal up to the tolerance and one record; repeated rows each get a slot; with fewer records than shards some
shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm._common import cut, ship, small, stored

MAX_RANGES, SAMPLE, RANGE_ROWS = 50_000, 200_000, 20_000


def splitters(sample: list[tuple], ranges: int) -> list:
    """Boundaries at the weighted quantiles of (key, weight); equal ones once."""
    sample = sorted(sample)
    total, at, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        at += w
        if at * ranges / total >= len(out) + 1 and len(out) < ranges - 1:
            out += [key] * (min(int(at * ranges / total), ranges - 1) - len(out))
    return sorted(set(out))


def shard(
    docs: DataFrame, n_shards: int = 40, key: Column | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 0.005, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, shards from 0, slots gapless from 0 in each."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), (F.xxhash64(text) if key is None else key).alias("key"),
        )
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).head()
    ranges = min(MAX_RANGES, max(4 * n_shards, -(-n // range_rows)))
    rate = F.col("size") * F.lit(min(SAMPLE, 64 * ranges) / max(total, 1))
    draw = F.pmod(F.xxhash64("uid", "key", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where((draw < rate) & F.col("key").isNotNull()).select("key", F.greatest(rate, F.lit(1.0)).alias("w")).collect()
    bounds = splitters([(r.key, r.w) for r in sample], ranges)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [0 if k is None else bisect.bisect_right(bounds, k) for k in b.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.int32())], [*b.schema.names, "range"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", range int"
    ranged = stored(rows.mapInArrow(assign, schema))
    held = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("parts", F.when(F.col("n") > 2 * range_rows, F.ceil(F.col("n") / range_rows)).otherwise(1))
    ranged = ranged.join(F.broadcast(held.select("range", "parts")), "range")  # MAX_RANGES rows at most
    ranged = ranged.withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
    # subdivided ranges add no more cells than the rows have RANGE_ROWS
    cells = cut(ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"))
    within = Window.partitionBy("range", "part").orderBy("key", "doc_id", "uid")
    group = Window.partitionBy("range", "part", "key")
    placed = ranged.join(small(starts), ["range", "part"]).withColumns(
        {"row": F.col("row0") + F.row_number().over(within) - 1, "at": F.col("byte0") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")}
    )
    placed = placed.withColumns({"g_at": F.min("at").over(group), "g_size": F.sum("size").over(group)})
    whole = (F.col("parts") == 1) & (F.col("g_size") <= F.lit(tolerance * total / n_shards))
    middle = F.when(whole, F.col("g_at") + F.col("g_size") / 2).otherwise(F.col("at") + F.col("size") / 2)
    number = F.least(F.floor(middle * n_shards / max(total, 1)), F.lit(n_shards - 1)).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", number.alias("shard"), "row"))
    first = F.broadcast(cut(placed.groupBy("shard").agg(F.min("row").alias("row0"))))  # n_shards rows
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("row0")).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **more) -> None:
    """``docs`` as one folder of Parquet files a shard; ids must be unique.  Large shards are split over tasks."""
    plan = shard(docs, id_col=id_col, **more).select(F.col("doc_id").alias("_rg_id"), "shard", "slot")
    out = docs.join(plan, docs[id_col] == plan["_rg_id"]).drop("_rg_id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

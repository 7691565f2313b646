"""Exact order statistics and numbers by ranges, whatever the share of one key.

Groups of up to ``BIG`` values are ranked where they are gathered.  A larger one is bracketed first: a sketch whose
error is bounded gives two values between which a wanted rank must lie, the values below are counted, and only those
between are counted one by one, in ranges whose sums tell which range holds the rank.  So the result is exact, large groups are scanned
but never sorted or gathered, and what is shuffled of them is a few ten-thousandths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.operators.lineage import cut

#: Values of a group that one task may rank; and of a sketch, ranks are off by one in ``ACCURACY`` at most.
BIG, ACCURACY = 1_000_000, 10_000
#: Wanted ranks (from 0) of a group, from its number of values; all within two ranks of the share that is their key.
Wanted = dict[float, Callable[[Column], Column]]


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in ranges of an order, with their numbers, stored so that all readers see the same ranges."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a table of one row a key; null keys meet."""
    named = table.select(*[F.col(k).alias(f"_k{i}") if k in keys else F.col(k) for i, k in enumerate([*keys, *[c for c in table.columns if c not in keys]])])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(named), on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _bracketed(rows: DataFrame, keys: list[str], wanted: Wanted) -> DataFrame:
    """``at_ranks`` of large groups: (keys, _v) rows."""
    shares, margin = list(wanted), 3 / ACCURACY + 4 / BIG  # the sketch's error, and some ranks of a group over BIG
    ends = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-margin, margin)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.percentile_approx("_v", ends, F.lit(ACCURACY)).alias("_ends"))
    held = cut(found)  # a row for each group of over BIG values
    part = lambda i: F.struct(F.lit(i).alias("i"), F.get("_ends", F.lit(2 * i)).alias("low"), F.get("_ends", F.lit(2 * i + 1)).alias("high"))
    near = _beside(rows, held.select(*keys, F.array(*[part(i) for i in range(len(shares))]).alias("_parts")), keys)
    counted = near.select(*keys, "_v", F.explode("_parts").alias("_p"))
    below = counted.groupBy(*keys, F.col("_p.i").alias("_i")).agg(F.count_if(F.col("_v") < F.col("_p.low")).alias("_below"))
    counts = cut(counted.where(F.col("_v").between(F.col("_p.low"), F.col("_p.high"))).groupBy(*keys, F.col("_p.i").alias("_i"), "_v").agg(F.count("*").alias("_n")))

    each = [*keys, "_i"]
    ranges = _ranged(counts, [*each, "_v"])
    sums = ranges.groupBy("_range", *each).agg(F.sum("_n").alias("_m"))  # a row for each range and group in it
    before = Window.partitionBy(*each).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = _beside(sums.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0))), cut(_beside(below, held.select(*keys, "total"), keys)), each)
    starts = starts.withColumn("_start", F.col("_start") + F.col("_below"))
    asked = F.array().cast("array<bigint>")
    for i, p in enumerate(shares):
        asked = F.when(F.col("_i") == i, F.array_distinct(wanted[p](F.col("total")))).otherwise(asked)
    here = lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_m"))
    starts = starts.withColumn("_asked", F.filter(asked, here)).where(F.size("_asked") > 0).drop("_m", "_below")
    running = Window.partitionBy("_range", *each).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("_start") + F.coalesce(F.sum("_n").over(running), F.lit(0))
    read = _beside(ranges, cut(starts), ["_range", *each]).withColumn("_low", low)
    hit = F.filter("_asked", lambda r: (r >= F.col("_low")) & (r < F.col("_low") + F.col("_n")))
    return read.select(*keys, "total", F.explode(hit).alias("rank"), F.col("_v").alias("value"))


def _sized(df: DataFrame, keys: list[str], value: str, n_values: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to BIG, rows of larger groups or None): rows are (keys, _v) without nulls."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if (rows.count() if n_values is None else n_values) <= BIG:
        return rows, None
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("total")).where(F.col("total") > BIG).select(*keys, F.lit(True).alias("_large")))  # one for each BIG values at most
    if not large.head(1):
        return rows, None
    marked = _beside(rows, large, keys, "left")
    return marked.where("_large is null").drop("_large"), marked.where("_large").drop("_large")


def at_ranks(df: DataFrame, keys: list[str], value: str, wanted: Wanted, n_values: int | None = None) -> DataFrame:
    """(keys, total, rank, value): the values at the wanted ranks of every group, nulls not counted.

    ``n_values``: how many values there are, if that is known."""
    rows, large = _sized(df, keys, value, n_values)
    every = F.array_distinct(F.concat(*[w(F.col("total")) for w in wanted.values()]))
    place = Window.partitionBy(*keys).orderBy("_v")
    ranked = rows.withColumns({"rank": F.row_number().over(place) - 1, "total": F.count("*").over(Window.partitionBy(*keys))})
    out = ranked.where(F.array_contains(every, F.col("rank").cast("long"))).select(*keys, "total", F.col("rank").cast("long").alias("rank"), F.col("_v").alias("value"))
    return out if large is None else out.unionByName(_bracketed(large, keys, wanted))


def middle(total: Column) -> Column:
    """The one or two ranks in the middle."""
    return F.array(F.floor((total - 1) / 2).cast("long"), F.floor(total / 2).cast("long"))


def medians(df: DataFrame, keys: list[str], value: str, n_values: int | None = None) -> DataFrame:
    """(keys, n, median); of an even number of values the mean of the two in the middle."""
    rows, large = _sized(df, keys, value, n_values)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median("_v").alias("median"))
    if large is None:
        return out
    found = _bracketed(large, keys, {0.5: middle}).groupBy(*keys).agg(F.max("total").alias("n"), (0.5 * F.min("value") + 0.5 * F.max("value")).alias("median"))
    return out.where("n > 0").unionByName(found)


def numbered_by(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 within their key, in an order that leaves no ties: a key may span any number of ranges."""
    ranges = _ranged(df, [*keys, *order])
    held = ranges.groupBy("_range", *keys).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    on = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = ranges.withColumn("_rn", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    return ranked.join(starts, on).withColumn(name, F.col("_start") + F.col("_rn")).select(*df.columns, name)

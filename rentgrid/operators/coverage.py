"""Counts: facets, coverage, completeness of fields, anomalies, reports and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.operators import ranks


def field_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, total, percent) of each column, in one aggregation; empty text counts as missing."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("total"), *[F.count(N.present(F.col(c), kinds[c])).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns]))
    out = one.select("total", rows.alias("r")).select("r.field", "r.filled", "total")
    return out.withColumn("percent", N.half_even(F.col("filled") * 100.0 / F.greatest(F.col("total"), F.lit(1)), 1))


def frequencies(df: DataFrame, key: Column, k: int | None = None) -> DataFrame:
    """(value, n), most frequent first, ties by value; the first ``k`` if given."""
    out = df.groupBy(key.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(k) if k else out


def exploded_facet(df: DataFrame, values: str) -> DataFrame:
    """(value, n) of a multi-valued field, a row counted once a value; by count, then lower-cased label."""
    return df.select(F.explode(F.array_distinct(values)).alias("value")).where("value != ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("value"), "value")


def facet_counts(df: DataFrame, predicates: dict[str, Column], facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n): for each facet its values' counts among the rows that meet all other predicates.

    One pass: a row is listed under each facet whose other conditions it meets."""
    ok = {k: F.coalesce(p, F.lit(False)) for k, p in predicates.items()}

    def others(name: str) -> Column:
        out = F.lit(True)
        for k, p in ok.items():
            out = out & p if k != name else out
        return out

    listed = F.array_compact(F.array(*[F.when(others(n), F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value"))) for n, c in facets.items()]))
    return df.select(F.inline(listed)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def isolated_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(criterion, n): how many rows each criterion meets on its own, to explain an empty result."""
    one = df.agg(*[F.count_if(p).alias(k) for k, p in predicates.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"`{k}`").alias("n")) for k in predicates])))


def repeated_values(df: DataFrame, keys: list[str], more_than: int = 2) -> DataFrame:
    """Keys whose value occurs too often to belong to one listing each, such as an agency's address."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def drop_repeated(df: DataFrame, source: str, value: str, more_than: int = 2) -> DataFrame:
    """``df`` with values that a source repeats more than ``more_than`` times set to null."""
    w = Window.partitionBy(source, value)
    return df.withColumn("_n", F.count(value).over(w)).withColumn(value, F.when(F.col("_n") <= more_than, F.col(value))).drop("_n")


def anomalies(df: DataFrame, id_col: str, reasons: dict[str, Column], n: int = 20) -> DataFrame:
    """The ``n`` rows with most reasons: id, reasons, severity."""
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in reasons.items()]))
    out = df.select(id_col, found.alias("reasons")).withColumn("severity", F.size("reasons")).where("severity > 0")
    return out.orderBy(F.desc("severity"), id_col).limit(n)


def truth_status(hide: Column, uncertain: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit(False)), "error").when(F.coalesce(hide, F.lit(False)), "hide").when(F.coalesce(uncertain, F.lit(False)), "uncertain").otherwise("ok")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, min, max, median) of numeric columns."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.field", "x.v")
    ends = values.groupBy("field").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    out = F.broadcast(names).join(ends, "field", "left").join(ranks.medians(values, ["field"], "v").select("field", "median"), "field", "left")
    return out.select("field", F.coalesce("n", F.lit(0)).alias("n"), "min", "max", "median")


def daily_activity(df: DataFrame, opened: str, closed: str, until: Column, days: int = 30) -> DataFrame:
    """(day, entries, exits) of the last ``days`` days, zero-filled."""
    first = F.date_sub(until.cast("date"), days - 1)
    span = df.sparkSession.range(1).select(F.explode(F.sequence(first, until.cast("date"))).alias("day"))
    e = F.struct(F.to_date(opened).alias("day"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    x = F.struct(F.to_date(closed).alias("day"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    n = df.select(F.inline(F.array(e, x))).where(F.col("day").between(first, until.cast("date"))).groupBy("day").agg(F.sum("i").alias("entries"), F.sum("o").alias("exits"))
    return span.join(n, "day", "left").select("day", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("exits", F.lit(0)).alias("exits")).orderBy("day")


def movements(df: DataFrame, first: str, last: str, active: Column, now: Column, days: int = 7, long_days: int = 45) -> DataFrame:
    """One row: new within ``days``, gone, gone within ``days``, active, and active for over ``long_days``."""
    since = lambda c, d: F.unix_micros(F.col(c).cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - d * 86_400_000_000
    on = F.coalesce(active, F.lit(False))
    return df.agg(
        F.count_if(since(first, days)).alias("new"), F.count_if(~on).alias("gone"), F.count_if(~on & since(last, days)).alias("gone_recently"), F.count_if(on).alias("active"),
        F.count_if(on & ~since(first, long_days)).alias("long_running"),
    )


def is_fresh(first: Column, now: Column, days: int = 3) -> Column:
    """First seen within so many whole days."""
    return F.coalesce(F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 8.64e10) <= days, F.lit(False))


def location_summary(df: DataFrame, location: str = "location", most: int = 30) -> DataFrame:
    """(figure, key, n) of inferred places: listings, those in the focus, by quality, and the ``most`` commonest communes."""
    at = lambda f: F.col(f"{location}.{f}")
    counts = df.groupBy(at("commune_inferred").alias("commune"), at("quality").alias("quality"), at("focus").alias("focus")).agg(F.count("*").alias("n"))
    figure = lambda name, key: counts.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).select(F.lit(name).alias("figure"), "key", "n")
    communes = figure("commune", F.col("commune")).orderBy(F.desc("n"), "key").limit(most)
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("focus"), F.col("n")).otherwise(0)), F.lit(0)).alias("focus"))
    whole = one.select(F.inline(F.array(F.struct(F.lit("listings").alias("figure"), F.lit("").alias("key"), F.col("all").alias("n")), F.struct(F.lit("focus").alias("figure"), F.lit("").alias("key"), F.col("focus").alias("n")))))
    return whole.unionByName(figure("quality", F.col("quality"))).unionByName(communes)


def per_source(df: DataFrame, source: str, active: Column, read: Column, last: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(read).alias("detail_read"), F.max(last).alias("latest")).orderBy(source)


def run_groups(df: DataFrame, family: str, passed: Column) -> DataFrame:
    """(family, steps, passed, ok) of gates and pipeline steps."""
    return df.groupBy(family).agg(F.count("*").alias("steps"), F.count_if(passed).alias("passed"), F.bool_and(passed).alias("ok")).orderBy(family)


def volume_checks(df: DataFrame, source: str, image: Column, least: int, least_source: dict[str, int], photo_share: float) -> DataFrame:
    """(check, value, ok): total rows, rows of single sources, share with photo."""
    row = df.agg(F.count("*").alias("total"), F.avg(F.when(image, 1.0).otherwise(0.0)).alias("photos"), *[F.count_if(F.col(source) == s).alias(f"s_{i}") for i, s in enumerate(least_source)])
    check = lambda name, value, ok: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))
    checks = [check("total", F.col("total"), F.col("total") >= least), check("photo_share", F.col("photos"), F.col("photos") >= photo_share)]
    checks += [check(f"source:{s}", F.col(f"s_{i}"), F.col(f"s_{i}") >= n) for i, (s, n) in enumerate(least_source.items())]
    return row.select(F.inline(F.array(*checks)))


def page(df: DataFrame, order: list[Column], number: int, size: int = 36) -> DataFrame:
    """Page ``number`` (from 0) of a result."""
    return df.orderBy(*order).offset(number * size).limit(size)


def round_trip(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two exports has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def dangling(df: DataFrame, id_col: str, pointer: str) -> DataFrame:
    """Rows whose pointer names no row."""
    ids = df.select(F.col(id_col).alias("_id")).distinct()
    return df.where(F.col(pointer).isNotNull()).join(ids, F.col(pointer) == F.col("_id"), "left_anti")

"""Numbers and missing values.  Rounding is half to even; casts never fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column if the frame has it, else a typed null: documents may lack any field."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def present(c: Column, kind: str) -> Column:
    """Null for what counts as missing: empty text and empty arrays; 0 and false stay."""
    if kind == "string":
        return F.when(c != "", c)
    return F.when(F.size(c) > 0, c) if kind.startswith(("array", "map")) else c


def first_present(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the columns that is not missing, among those the frame has."""
    kinds = dict(df.dtypes)
    found = [present(F.col(n), kinds[n]).cast(kind) for n in names if n in kinds]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def number_or_none(c: Column) -> Column:
    """A number from text with spaces, currency or unit signs and a decimal comma; null if none."""
    t = F.replace(F.replace(F.trim(c.cast("string")), F.lit("€")), F.lit("m²"))
    t = F.replace(F.translate(t, "  ", ""), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def digits_number(c: Column) -> Column:
    """A number from what is left of a text without all but digits, commas, points and minus signs."""
    return F.replace(F.regexp_replace(c.cast("string"), "[^0-9,.-]", ""), F.lit(","), F.lit(".")).try_cast("double")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c.cast("double"), digits)


def as_int(c: Column) -> Column:
    """A whole number, rounded half to even; null for what is no finite number or fits no long."""
    x = c.try_cast("double")
    return F.when(F.abs(x) < F.lit(9.0e18), F.bround(x, 0).cast("long"))


def parse_int(c: Column) -> Column:
    return as_int(digits_number(c))


def truthy(c: Column) -> Column:
    """Null for 0 as well: what plain truth tests take for missing."""
    return F.when(c != 0, c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null unless both are given and b is not 0."""
    return F.try_divide(a.cast("double"), truthy(b.cast("double")))


def price_per_m2(rent: Column, surface: Column) -> Column:
    return F.when((rent > 0) & (surface > 0), rent.cast("double") / surface.cast("double"))


def bedrooms_or_rooms(bedrooms: Column, rooms: Column) -> Column:
    """Bedrooms, or one fewer than the rooms; 0 of either counts as missing."""
    return F.coalesce(truthy(bedrooms), F.greatest(truthy(rooms) - 1, F.lit(0)))


def estimated_bedrooms(bedrooms: Column, rooms: Column) -> Column:
    """(n, deduced): given bedrooms, 0 included, or one fewer than at least one room."""
    n = F.coalesce(bedrooms, F.when(rooms >= 1, F.greatest(rooms - 1, F.lit(0))))
    return F.struct(n.alias("n"), (bedrooms.isNull() & (rooms >= 1)).alias("deduced"))


def band(c: Column, step: int) -> Column:
    """The nearest multiple of ``step`` as text; ``?`` for what is no positive number."""
    x = c.try_cast("double")
    return F.when(x > 0, (F.bround(x / step, 0) * step).cast("long").cast("string")).otherwise("?")


def rounded_to(c: Column, step: int) -> Column:
    """The nearest multiple of ``step``, 0 for missing."""
    return F.coalesce(F.bround(truthy(c.cast("double")) / step, 0) * step, F.lit(0)).cast("long")


def rel_close(x: Column, y: Column, pct: float, abs_tol: float) -> Column:
    """Within the larger of an absolute tolerance and a share of the larger value; false if either is missing."""
    a, b = x.cast("double"), y.cast("double")
    room = F.greatest(F.lit(float(abs_tol)), F.lit(pct) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    return F.coalesce(F.abs(a - b) <= room, F.lit(False))


def within_ratio(value: Column, target: Column, tolerance: float) -> Column:
    t = target.cast("double")
    return F.coalesce(F.abs(value.cast("double") - t) / F.greatest(t, F.lit(1.0)) <= tolerance, F.lit(False))


def pct_drop(old: Column, new: Column) -> Column:
    """How far ``new`` fell below ``old``, in percent of it; 0 for no fall or nothing before."""
    return F.when(old > 0, F.greatest(F.lit(0.0), (old - new) * 100.0 / old)).otherwise(F.lit(0.0))


def quantile_exclusive(values: Column, pct: int) -> Column:
    """The percentile by the exclusive method: rank pct * (n + 1) / 100, interpolated, kept inside.

    Needs two values at least, else null."""
    s = F.array_sort(values)
    n = F.size(s)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(pct) * (n + 1) / 100).cast("int")))
    delta = F.lit(pct) * (n + 1) - j * 100
    return F.when(n > 1, (F.element_at(s, j) * (100 - delta) + F.element_at(s, j + 1) * delta) / 100.0)


def parse_time(c: Column) -> Column:
    """A timestamp from ISO-8601 text; Z is +00:00 and no offset means UTC (the session's zone)."""
    return F.try_to_timestamp(F.trim(c.cast("string")))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def days_between(a: Column, b: Column) -> Column:
    return F.bround(seconds_between(a, b) / 86400, 2)


def hours_between(a: Column, b: Column) -> Column:
    return F.bround(seconds_between(a, b) / 3600, 2)


def age_phrase(days: Column) -> Column:
    """How long ago, in French; null for no age."""
    return (
        F.when(days <= 0, "aujourd'hui").when(days == 1, "hier")
        .when(days < 7, F.concat(F.lit("il y a "), days.cast("string"), F.lit(" j")))
        .when(days < 31, F.concat(F.lit("il y a "), F.floor(days / 7).cast("string"), F.lit(" sem.")))
        .when(days >= 31, F.concat(F.lit("il y a "), F.floor(days / 30).cast("string"), F.lit(" mois")))
    )

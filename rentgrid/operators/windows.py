"""Order-based operators: as-of and interval joins, interleaving, retention, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.operators import ranks
from rentgrid.operators.lineage import cut


def as_of(df: DataFrame, key: list[str], at: str, tie: str, is_target: Column, value: Column, forward: bool = False) -> Column:
    """The value of the nearest earlier (or later) target row of the same key; the row itself is never one.

    One window over the key: events and their targets share a table, so no join is needed.  Earlier
    means an earlier time, or the same time and a smaller tie-break; later means a later time."""
    marked = F.when(is_target, value)
    if forward:
        w = Window.partitionBy(*key).orderBy(F.col(at), F.col(tie)).rowsBetween(1, Window.unboundedFollowing)
        return F.first(marked, ignorenulls=True).over(w)
    w = Window.partitionBy(*key).orderBy(F.col(at), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(marked, ignorenulls=True).over(w)


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_cols: list[str], hours: float, left_id: str, tie: str) -> DataFrame:
    """Each left row with the right row of its key nearest in time, at most ``hours`` away, or nulls.

    Times are cut into buckets of ``hours``; a right row goes to its own bucket and both
    neighbours, so the join is an equi join on key and bucket and a key's rows are spread over as
    many buckets as it has hours."""
    span = int(hours * 3.6e9)
    tl, tr = F.unix_micros(F.col(left_at).cast("timestamp")), F.unix_micros(F.col(right_at).cast("timestamp"))
    r = right.select(F.col(key).alias("_k"), tr.alias("_t"), F.struct(*[F.col(c) for c in right_cols]).alias("_r"), F.col(tie).alias("_tie"), F.explode(F.array(*[F.floor(tr / span) + d for d in (-1, 0, 1)])).alias("_b"))
    l = left.select(F.col(left_id), F.col(key).alias("_k"), tl.alias("_lt"), F.floor(tl / span).alias("_b"))
    met = l.join(r, ["_k", "_b"]).where(F.abs(F.col("_lt") - F.col("_t")) <= span)
    best = met.groupBy(left_id).agg(F.min_by("_r", F.struct(F.abs(F.col("_lt") - F.col("_t")), F.col("_tie"))).alias("_r"))
    return left.join(best, left_id, "left").select(*[left[c] for c in left.columns], *[F.col(f"_r.{c}").alias(f"near_{c}") for c in right_cols])


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with their turn and place: the first of every group, then the second of every group, and so on, groups
    of a turn by name.  ``order`` leaves no ties; a group may have nearly all rows."""
    turns = ranks.numbered_by(df, [group], order, "turn")
    return ranks.numbered_by(turns, [], ["turn", group], "place")


def keep_latest(df: DataFrame, prefix: str, at: str, tie: str, keep: int) -> DataFrame:
    """The rows beyond the latest ``keep`` of each prefix: what retention may remove."""
    rank = F.row_number().over(Window.partitionBy(prefix).orderBy(F.desc(at), F.desc(tie)))
    return df.withColumn("_rn", rank).where(F.col("_rn") > keep).drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: Column | int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def percentile_rank(c: Column, *partition: str) -> Column:
    """The share of values that are at most the row's."""
    return F.cume_dist().over(Window.partitionBy(*partition).orderBy(c))


def last_values(df: DataFrame, key: str, order: list[str], n: int, condition: Column, *columns: str) -> DataFrame:
    """(key, values): the last ``n`` rows of each key that meet the condition, in order."""
    ranked = top_n(df.where(condition), [key], [F.desc(c) for c in order], n)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("values"))


def numbered(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """Rows numbered from 1 in the order of a column: in ranges of it, behind the counts of the ranges before."""
    return ranks.numbered_by(df, [], [order], name)


#: Cells of a grid are halved up to so often, in steps of two, until a place meets about ``MET`` places in its own.
HALVED, MET = 16, 4


def _crowds(places: DataFrame, side: float) -> dict[int, float]:
    """How many places a place has in its cell on average, by the number of times that cells of ``side`` are halved."""
    cell = lambda c: F.call_function("shiftright", F.floor(F.col(c) / (side / 2**HALVED)), F.lit(HALVED) - F.col("n"))
    dealt = places.select("_plat", "_plon", F.explode(F.array(*[F.lit(n) for n in range(0, HALVED + 1, 2)])).alias("n"))
    cells = dealt.groupBy("n", cell("_plat").alias("_y"), cell("_plon").alias("_x")).agg(F.count("*").alias("k"))
    return {r.n: r.met for r in cells.groupBy("n").agg((F.sum(F.col("k").cast("double") * F.col("k")) / F.sum("k")).alias("met")).collect()}


def _met(spots: DataFrame, places: DataFrame, side: float, near: Column) -> DataFrame:
    """(spot, place, _d) of spots and the places that are ``near``, among those of their own cell and the eight around it."""
    cell = lambda c: F.floor(F.col(c) / side)
    grid = places.withColumns({"_y": cell("_plat"), "_x": cell("_plon")})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    looking = spots.withColumn("_o", around).withColumns({"_y": cell("_lat") + F.col("_o.i"), "_x": cell("_lon") + F.col("_o.j")}).drop("_o")
    d = F.sqrt((F.col("_plat") - F.col("_lat")) ** 2 + (F.col("_plon") - F.col("_lon")) ** 2)
    return looking.join(grid, ["_y", "_x"]).withColumn("_d", d).where(near)


def nearest_place(df: DataFrame, places: DataFrame, lat: str, lon: str, cutoff: float, id_col: str) -> DataFrame:
    """Each row with the nearest place closer than ``cutoff`` degrees, or null; of several the first.

    Rows of one spot are looked up once, and of the places of one spot only the first is.  Places are dealt to a grid and
    each spot looks in its own and the eight cells around it: an equi join, whatever the number of places.  Where cells of
    ``cutoff`` are crowded, finer ones come first: a place no farther than a cell is wide is the nearest of all, and only
    spots without one go on to the next grid.  ``places``: (place, lat, lon)."""
    there = cut(places.groupBy(F.col("lat").alias("_plat"), F.col("lon").alias("_plon")).agg(F.min("place").alias("place")).where("_plat is not null and _plon is not null"))
    left = cut(df.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).where("_lat is not null and _lon is not null").distinct())
    # a little wider than the radius that is searched, as quotients are rounded
    side = cutoff * (1 + 1e-9)
    crowds = _crowds(there, side)
    n = min((k for k, met in crowds.items() if met <= MET), default=max(crowds, default=0))
    best = None
    for k in range(n, -1, -2):
        wide = side / 2**k
        near = (F.col("_d") < cutoff) & (F.lit(True) if k == 0 else F.col("_d") <= wide * (1 - 1e-9))
        # the distance first and its place then, both by hash: the pairs are never sorted or shuffled as they are
        low = cut(_met(left, there, wide, near).groupBy("_lat", "_lon").agg(F.min("_d").alias("distance")))
        found = cut(_met(low, there, wide, near & (F.col("_d") == F.col("distance"))).groupBy("_lat", "_lon", "distance").agg(F.min("place").alias("place")))
        best = found if best is None else best.unionByName(found)
        if k:
            left = cut(left.join(found, ["_lat", "_lon"], "left_anti"))
            if not left.head(1):
                break
    rest = [c for c in df.columns if c != id_col]
    return df.join(best, (df[lat] == F.col("_lat")) & (df[lon] == F.col("_lon")), "left").select(id_col, *rest, "place", "distance")


def first_known(df: DataFrame, candidates: Column, table: DataFrame, key: str, id_col: str) -> DataFrame:
    """Each row with the entry of ``table`` for the first of its candidate keys that has one."""
    tried = df.select(id_col, F.posexplode(candidates).alias("_pos", key))
    cols = [c for c in table.columns if c != key]
    hit = tried.join(table, key).groupBy(id_col).agg(F.min_by(F.struct(*cols), "_pos").alias("_hit"))
    return df.join(hit, id_col, "left").select(*[df[c] for c in df.columns], *[F.col(f"_hit.{c}").alias(c) for c in cols])

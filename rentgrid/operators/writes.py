"""Table writes without MERGE: each returns the new state of the table as a plan.

The caller writes it to a new folder and swaps, so a failed run leaves the old table untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The last row (or rows) of each key by ``order``; a partial limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= keep).drop("_rn")


def native_id(df: DataFrame, source: Column) -> Column:
    """The id within its source: source_id or site_id, else the id without the source's prefix."""
    given = F.coalesce(*[F.nullif(F.trim(N.column(df, c)), F.lit("")) for c in ("source_id", "site_id")])
    own = F.nullif(F.trim(N.column(df, "id")), F.lit(""))
    prefix = F.concat(source, F.lit(":"))
    bare = F.when(own.startswith(prefix) & (F.length(own) > F.length(prefix)), F.substring(own, F.length(prefix) + 1, F.length(own))).otherwise(own)
    return F.coalesce(given, F.when(source.isNotNull(), bare).otherwise(own))


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], now: Column, order: str, first: str = "first_seen_at", updated: str = "updated_at") -> DataFrame:
    """Insert or update by key; the batch's last row of a key wins and the first-seen time stays.

    Rows with a null key are skipped (``skipped`` counts them).  One full outer join: the key
    columns are the only shuffle."""
    rows = latest(batch.dropna(subset=keys), keys, [F.desc(order)])
    values = [c for c in base.columns if c not in (*keys, first, updated)]
    b, n = base.alias("b"), rows.withColumn("_new", F.lit(True)).alias("n")
    joined = b.join(n, keys, "full_outer")
    is_new = F.col("n._new").isNotNull()
    pick = [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values]
    return joined.select(*keys, *pick, F.coalesce(f"b.{first}", F.when(is_new, now)).alias(first), F.when(is_new, now).otherwise(F.col(f"b.{updated}")).alias(updated))


def skipped(batch: DataFrame, keys: list[str]) -> DataFrame:
    """(processed, skipped): rows of a batch, and those without a full key."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return batch.agg(F.count("*").alias("processed"), F.count_if(missing).alias("skipped"))


def upsert_status(base: DataFrame, batch: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """(keys, status) of a batch against a table: new, changed (another digest) or seen."""
    old = base.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(digest)), "seen").otherwise("changed")
    return batch.join(old, keys, "left").select(*keys, status.alias("status"))


def upsert_richer(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update, where a null or empty new value never replaces an old one."""
    kinds = dict(base.dtypes)
    values = [c for c in base.columns if c not in keys]
    new = {c: N.present(F.col(f"n.{c}"), kinds[c]) for c in values if c in batch.columns}
    return base.alias("b").join(batch.alias("n"), keys, "full_outer").select(*keys, *[F.coalesce(new[c], F.col(f"b.{c}")).alias(c) if c in new else F.col(f"b.{c}").alias(c) for c in values])


def deactivate_unseen(base: DataFrame, seen: DataFrame, source: str, source_col: str = "source_site", id_col: str = "source_id") -> DataFrame:
    """Rows of one source that a batch did not see become inactive; an empty batch changes nothing."""
    ids = seen.select(F.col(id_col).alias("_seen")).distinct()
    any_seen = ids.agg((F.count("_seen") > 0).alias("_any"))  # one row
    joined = base.join(ids, base[id_col] == F.col("_seen"), "left").crossJoin(F.broadcast(any_seen))
    gone = (F.col(source_col) == source) & F.col("_seen").isNull() & F.col("_any")
    return joined.withColumn("is_active", F.when(gone, 0).otherwise(F.coalesce("is_active", F.lit(1)))).select(*base.columns)


def insert_new(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the table has not; of several the first by all columns."""
    fresh = latest(batch, keys, [F.col(c) for c in batch.columns if c not in keys] or [F.lit(1)])
    return fresh.join(base.select(*keys), keys, "left_anti")


def keep_with_parent(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose parent is there and active."""
    return child.join(parent.where(F.coalesce(F.col("is_active"), F.lit(1)) == 1).select(*keys), keys, "left_semi")


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns, in name order, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def structure_hash(df: DataFrame) -> str:
    """Digest of a frame's field names and types, for drift between runs."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(dict(df.dtypes), sort_keys=True).encode()).hexdigest()[:16]


def description_update(existing: Column, new: Column, title: Column, at_least: int = 45) -> Column:
    """Whether a recovered description should replace the stored one."""
    old = F.length(F.trim(F.coalesce(existing, F.lit(""))))
    grows = F.length(new) > F.greatest(old, F.lit(at_least))
    return F.coalesce(new.isNotNull() & (F.trim(new) != F.trim(F.coalesce(title, F.lit("")))) & grows, F.lit(False))


def purge(df: DataFrame, outside: Column, last_seen: Column, now: Column, days: int = 30) -> DataFrame:
    """Without rows outside the area and without inactive ones not seen for ``days`` days."""
    stale = (F.coalesce(F.col("is_active"), F.lit(1)) == 0) & (N.seconds_between(last_seen, now) > days * 86400)
    return df.where(~(F.coalesce(outside, F.lit(False)) | F.coalesce(stale, F.lit(False))))


def volume_guard(old: DataFrame, new: DataFrame, source: str, critical: list[str], overall: float = 15.0, each: float = 35.0) -> DataFrame:
    """One row a source, and one for all (source null): counts before and after, drop in percent, refused.

    Refused: the whole fell by more than ``overall`` percent, a critical source by more than ``each``."""
    name = F.coalesce(F.col(source), F.lit("unknown"))
    both = old.select(name.alias("source"), F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(name.alias("source"), F.lit(0).alias("o"), F.lit(1).alias("n")))
    sums = both.rollup("source").agg(F.sum("o").alias("before"), F.sum("n").alias("after"))
    drop = N.pct_drop(F.col("before"), F.col("after"))
    limit = F.when(F.col("source").isNull(), F.lit(overall)).when(F.col("source").isin(*critical), F.lit(each))
    return sums.select("source", "before", "after", drop.alias("drop_pct"), F.coalesce(drop > limit, F.lit(False)).alias("refused"))


def may_promote(candidate: DataFrame, at_least: int = 400) -> DataFrame:
    """(active, ok): a candidate or a rollback target is valid with enough active rows."""
    return candidate.agg(F.count_if(F.coalesce(F.col("is_active"), F.lit(1)) == 1).alias("active")).select("active", (F.col("active") >= at_least).alias("ok"))

"""What the public product shows of listings: projections, sidecar joins, tabs, and the figures of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.functions import text as T
from rentgrid.operators.entity import title_ratio

# fixed values: labels that stand for no district, as slugs
NO_DISTRICT = ("zone-non-precisee", "non-precisee", "non-precise", "region-non-precisee", "non-renseigne", "autre", "inconnu", "na", "")
# fixed values: the zones in which a search is strict, and its bounds
TARGET_ZONES = ("Sainte-Marie", "Moufia", "La Bretagne", "Saint-Denis")
STRICT = {"surface": 60, "rent_low": 600, "rent_high": 1000}
NO_ZONE, NO_COMMUNE, NO_PLACE = "Zone non précisée", "Non précisée", "Secteur non précisé"


# ---- labels and levels of a row


def district_label(raw: Column, commune: Column) -> Column:
    """The district of a "commune - district - part" label: its last two parts that are not the commune."""
    same = lambda c: T.norm_slug(c) == T.norm_slug(T.text(commune))
    label = F.trim(raw)
    parts = F.filter(F.transform(F.split(label, " - "), lambda p: F.trim(p)), lambda p: (p != "") & ~same(p))
    cut = F.when(F.contains(label, F.lit(" - ")), F.when(F.size(parts) > 0, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " · "))).otherwise(label)
    shown = lambda c: c.isNotNull() & ~T.norm_slug(c).isin(*NO_DISTRICT)
    return F.when(shown(label), T.bind(cut, lambda c: F.when(shown(c) & ~same(c), c)))


def place_label(district: Column, commune: Column, zone: Column) -> Column:
    """District, zone and commune, each once, as far as they say something."""
    own = T.clean(district)
    parts = F.array(
        F.when((own != "") & ~F.lower(own).isin("none", "nan"), own),
        F.when((zone != "") & (zone != NO_ZONE) & ~zone.eqNullSafe(commune), zone),
        F.when((commune != "") & (commune != NO_COMMUNE), commune),
    )
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(F.array_compact(parts)), " · "), F.lit("")), F.lit(NO_PLACE))


def availability(age_hours: Column) -> Column:
    """How recently a listing was seen: fresh to 36 hours, attention to 96, stale, or unknown."""
    return F.when(age_hours.isNull(), "unknown").when(age_hours <= 36, "fresh").when(age_hours <= 96, "attention").otherwise("stale")


def geo_level(quality: Column, city: Column, district: Column) -> Column:
    """(level, score) of a listing's place."""
    said = T.contains_any(T.norm_nfd(T.text(quality)), ["haute", "high", "quartier", "adresse"])
    has = lambda c: T.text(c) != ""
    finer = has(city) & has(district) & (T.norm_nfd(T.text(city)) != T.norm_nfd(T.text(district)))
    level = F.when(said, "haute").when(finer, "moyenne").when(has(city), "commune").otherwise("faible")
    score = F.when(said, 0.8).when(finer, 0.65).when(has(city), 0.45).otherwise(0.15)
    return F.struct(level.alias("level"), score.alias("score"))


def price_publishable(price: Column) -> Column:
    return F.coalesce(price.try_cast("double") > 0, F.lit(False))


def without_empties(df: DataFrame, keep: list[str], media: tuple[str, ...] = (), most: int = 8) -> Column:
    """A row's kept fields as JSON; nulls, empty texts and empty lists are left out, lists of media cut to ``most``."""
    kinds = dict(df.dtypes)

    def field(name: str) -> Column:
        c = F.col(name)
        if kinds[name].startswith("array"):
            c = F.slice(c, 1, most) if name in media else c
            return F.when(F.size(c) > 0, c).alias(name)
        return (F.when(c != "", c) if kinds[name] == "string" else c).alias(name)

    return F.to_json(F.struct(*[field(n) for n in keep if n in kinds]))


# ---- predicates


def in_target_zone(zones: Column, primary: Column) -> Column:
    named = F.arrays_overlap(zones, F.array(*[F.lit(z) for z in TARGET_ZONES]))
    return F.coalesce(named, F.lit(False)) | F.coalesce(primary.isin(*TARGET_ZONES), F.lit(False))


def tabs(df: DataFrame) -> dict[str, Column]:
    """The predicates of the product's tabs, by name."""
    c = lambda n, t: N.column(df, n, t)
    zone = in_target_zone(c("zones", "array<string>"), c("primary_zone", "string"))
    affordable = (c("surface_m2", "double") >= STRICT["surface"]) & c("rent_eur", "int").between(STRICT["rent_low"], STRICT["rent_high"])
    room = (F.coalesce(c("bedrooms", "int"), F.lit(0)) >= 1) | (F.coalesce(c("rooms", "int"), F.lit(0)) >= 2)
    said = {
        "strict": zone & affordable & room, "target": zone, "sameBudgetElsewhere": ~zone & affordable, "furnished": c("furnished", "string") == "Meublé",
        "duplicates": F.coalesce(c("duplicate_group_size", "int"), F.lit(1)) > 1,
    }
    return {k: F.coalesce(p, F.lit(False)) for k, p in said.items()}


def portal_predicate(df: DataFrame, state: dict) -> Column:
    """The portal's filters: exact city, type and region, bounds that a missing or zero number fails, and zones
    by containment in any place or text field."""
    out = F.coalesce(N.column(df, "display_canonical", "boolean"), F.lit(True))
    for key in ("city", "type", "region"):
        if state.get(key):
            out &= F.col(key) == state[key]
    number = lambda n: F.nullif(N.column(df, n, "double").cast("double"), F.lit(0.0))
    for key, name, low in (("maxPrice", "price", False), ("minPrice", "price", True), ("minSurface", "surface", True), ("minRooms", "rooms", True), ("minBedrooms", "bedrooms", True)):
        if state.get(key):
            out &= number(name) >= state[key] if low else number(name) <= state[key]
    if state.get("minScore"):
        out &= F.coalesce(number("opportunity_score"), number("score"), F.lit(0.0)) >= state["minScore"]
    if zones := [z.strip() for z in state.get("zones", ()) if z.strip()]:
        hay = T.norm_nfd(F.concat_ws(" ", *[T.text(N.column(df, n)) for n in ("city", "district", "location", "title", "description")]))
        met = F.lit(False)
        for z in zones:
            met = met | F.contains(hay, T.norm_nfd(F.lit(z)))
        out &= met
    return F.coalesce(out, F.lit(False))


# ---- kept and suspect rows


def partitioned(df: DataFrame, most: int = 10_000) -> DataFrame:
    """All rows with their list, kept or suspect, and the reasons; an impossible rent is one more reason."""
    wild = F.coalesce(F.col("rent_eur") > most, F.lit(False))
    reasons = F.coalesce(N.column(df, "residential_reasons", "array<string>"), F.array().cast("array<string>"))
    kept = ~wild & F.coalesce(F.col("residential_status") == "residential_candidate", F.lit(False))
    return df.withColumns(
        {
            "list": F.when(kept, "kept").otherwise("suspect"), "residential_status": F.when(wild, "excluded_bad_rent").otherwise(F.col("residential_status")),
            "residential_reasons": F.when(wild, F.concat(reasons, F.array(F.lit(f"rent_eur>{most}")))).otherwise(reasons),
        }
    )


def export_order(kept: bool) -> list[Column]:
    rent = F.coalesce(F.nullif(F.col("rent_eur"), F.lit(0)), F.lit(10**9))
    return [F.desc("score"), rent, F.desc(F.coalesce("surface_m2", F.lit(0)))] if kept else [F.col("source_site"), rent, F.col("title")]


def group_order() -> list[Column]:
    """Automatic groups first, then by confidence and id."""
    return [F.col("decision") != "auto_duplicate", F.desc("confidence"), F.col("group_id")]


# ---- joins


def with_sidecars(df: DataFrame, keys: list[str], sidecars: dict[str, DataFrame], defaults: dict[str, object] | None = None) -> DataFrame:
    """Listings with the columns of sidecar tables of at most one row a key, prefixed by the sidecar's name;
    ``defaults`` (by full column name) stand in where a key has none."""
    for name, side in sidecars.items():
        side = side.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c not in keys])
        df = df.join(side, keys, "left")
    return df.fillna(defaults) if defaults else df


def with_history(df: DataFrame, events: DataFrame, key: str, at: str, columns: list[str], most: int = 6) -> DataFrame:
    """Listings with the ``most`` latest of their events as a list of structs, oldest first; empty without any."""
    latest = events.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in columns]))).where(F.col("_rn") <= most)
    lists = latest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, *columns))).alias("history"))
    return df.join(lists, key, "left").withColumn("history", F.coalesce("history", F.array().cast(lists.schema["history"].dataType)))


def by_full_or_short_key(df: DataFrame, table: DataFrame, full: list[str], short: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the row of ``table`` with the same full key, else of the one with the same short key (its
    largest full key); ``matched`` tells which."""
    exact = table.groupBy(*full).agg(F.max(F.struct(*columns)).alias("_exact"))
    near = table.groupBy(*short).agg(F.max_by(F.struct(*columns), F.struct(*full)).alias("_near"))
    met = df.join(exact, full, "left").join(near, short, "left")
    which = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fallback").otherwise("none")
    found = F.coalesce("_exact", "_near")
    return met.select(*[df[c] for c in df.columns], which.alias("matched"), *[found[c].alias(c) for c in columns if c not in df.columns])


def to_reparse(listings: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Listings whose stored detail page was read without error."""
    return listings.join(details.where("http_status = 200").select(*keys).distinct(), keys, "left_semi")


# ---- figures of a run


def distinct_figures(df: DataFrame, counted: list[str], listed: list[str]) -> DataFrame:
    """One row: how many different values, and the sorted lists of those of columns of few values."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.agg(*[F.count_distinct(full(c)).alias(f"n_{c}") for c in counted], *[F.array_sort(F.collect_set(full(c))).alias(c) for c in listed])


def search_scores(matched: DataFrame, search: str, score: Column) -> DataFrame:
    """(search, n, avg_score) with the average of one decimal; missing scores are 0."""
    return matched.groupBy(search).agg(F.count("*").alias("n"), N.half_even(F.avg(F.coalesce(score, F.lit(0))), 1).alias("avg_score"))


def score_bands(df: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return df.agg(F.count_if(s >= 75).alias("strong_75_plus"), F.count_if((s >= 55) & (s < 75)).alias("medium_55_74"), F.count_if(s < 55).alias("low_under_55"))


def scrape_summary(events: DataFrame) -> DataFrame:
    """(source_site, n, with_image, new, changed, seen) of a run's events."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "seen")]
    return events.groupBy("source_site").agg(F.count("*").alias("n"), F.count_if(T.text(F.col("image_url")) != "").alias("with_image"), *status)


def fetch_report(fetches: DataFrame) -> DataFrame:
    """(kind, name, n): failures by reason and successes by host."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    name = F.when(ok, F.parse_url("url", F.lit("HOST"))).otherwise(F.coalesce("reason", F.lit("unknown")))
    return fetches.select(F.when(ok, "host").otherwise("failure").alias("kind"), name.alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))


def gallery_stats(df: DataFrame, source: str, urls: str) -> DataFrame:
    n = F.coalesce(F.size(urls), F.lit(0))
    return df.groupBy(source).agg(F.count("*").alias("n"), F.sum(n).alias("urls"), N.half_even(F.avg(n), 2).alias("avg_urls"), F.count_if(n > 1).alias("multi"))


def enrichment_summary(df: DataFrame) -> DataFrame:
    """One row of figures of an enrichment run; groups are counted before they are added up."""
    groups = df.where("group_key is not null").groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_items"))
    missing = F.count_if(F.col("city") == NO_COMMUNE)
    own = df.agg(
        F.count("*").alias("active_rows"), missing.alias("city_missing"), N.half_even(100 * (F.count("*") - missing) / F.greatest(F.count("*"), F.lit(1)), 1).alias("city_coverage_pct"),
        F.count_if(F.col("is_residential") == 1).alias("residential"), F.count_if((F.col("is_residential") == 1) & (F.col("is_canonical") == 1)).alias("canonical_residential"),
    )
    return own.crossJoin(groups)  # one row each


def feed_figures(df: DataFrame) -> DataFrame:
    """(name, n): the feed's counters, and its rows by precision."""
    on = F.coalesce(F.col("active"), F.lit(False))
    flags = {
        "total": F.lit(True), "active": on, "with_point": F.col("lat").isNotNull(), "with_photo": T.text(F.col("image")) != "", "active_without_photo": on & (T.text(F.col("image")) == ""),
        "detail_read": F.col("detail_read"), "fresh": on & F.col("fresh"),
    }
    names = F.array_compact(F.array(*[F.when(p, k) for k, p in flags.items()], F.concat(F.lit("precision:"), F.col("precision"))))
    return df.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def notable_changes(changes: DataFrame, drops: int = 8, returns: int = 4) -> DataFrame:
    """The largest falls of price and the first listings that came back; ties by id."""
    delta = F.coalesce(F.col("new_value").try_cast("double") - F.col("old_value").try_cast("double"), F.lit(0.0))
    rows = changes.withColumn("delta", delta)
    down = rows.where((F.col("event_type") == "price_changed") & ((F.col("delta") < 0) | F.coalesce(F.col("direction") == "down", F.lit(False))))
    best = down.orderBy(F.desc(F.abs("delta")), "id").limit(drops).withColumn("kind", F.lit("price_down"))
    back = rows.where("event_type = 'reappeared'").orderBy("id").limit(returns).withColumn("kind", F.lit("reappeared"))
    return best.unionByName(back)


def best_candidates(listings: DataFrame, candidates: DataFrame, key: str, wanted: str) -> DataFrame:
    """(key, candidate, exact, score): for every listing the best of the candidates found for it under its ``key``.

    Both have title, price and surface; ``wanted`` is the listing's id at the interface, ``id`` the candidate's.  The
    same id gives 3 points, a likeness of titles up to 1, a price within 5 and a surface within 1 a half each.  Without
    the same id 1.75 points are asked for, which takes both halves: so titles are compared only where both are met."""
    c = candidates.select(key, F.col("id").cast("string").alias("candidate"), F.col("title").alias("_t"), F.col("price").alias("_p"), F.col("surface").alias("_s"))
    near = lambda a, b, room: F.coalesce(F.abs(F.col(a).cast("double") - F.col(b).cast("double")) <= room, F.lit(False))
    met = listings.select(key, F.col(wanted).cast("string").alias("_w"), "title", "price", "surface").join(c, key)
    met = met.withColumns({"exact": F.coalesce(F.col("candidate") == F.col("_w"), F.lit(False)), "_near": near("price", "_p", 5.0).cast("int") + near("surface", "_s", 1.0).cast("int")})
    met = met.where(F.col("exact") | (F.col("_near") == 2))
    score = F.when(F.col("exact"), 3.0).otherwise(0.0) + F.col("_near") * 0.5 + title_ratio(F.lower(T.text(F.col("title"))), F.lower(T.clean(F.col("_t"))))
    good = met.withColumn("score", score).where(F.col("exact") | (F.col("score") >= 1.75))
    best = good.groupBy(key).agg(F.max_by(F.struct("candidate", "exact", "score"), F.struct("score", F.col("candidate"))).alias("b"))
    return best.select(key, "b.candidate", "b.exact", F.round("b.score", 3).alias("score"))


def local_media(df: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """``df`` (one row a key) with local images that are no stored files (``path``) taken away.

    A main image that is gone gives way to the first of the gallery, and a main image is part of the gallery."""
    said = df.select(key, F.posexplode(F.concat(F.array(F.coalesce("local_image_url", F.lit(""))), F.coalesce("local_image_urls", F.array().cast("array<string>")))).alias("at", "path"))
    there = said.join(files.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("_found"))
    d = df.join(there, key, "left").withColumn("_found", F.coalesce("_found", F.array().cast(there.schema["_found"].dataType)))
    d = d.withColumn("_gallery", F.transform(F.filter("_found", lambda x: x["at"] > 0), lambda x: x["path"])).withColumn("_main", F.coalesce(F.get("_found", F.lit(0))["path"], F.lit("")))
    whole = F.when((F.col("_main") != "") & ~F.array_contains("_gallery", F.col("_main")), F.concat(F.array("_main"), F.col("_gallery"))).otherwise(F.col("_gallery"))
    return d.withColumns({"local_image_url": F.col("_main"), "local_image_urls": whole}).drop("_found", "_gallery", "_main")

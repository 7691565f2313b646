"""Private profiles: strict and fallback matches, near misses, and 0-100 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.functions import plain
from rentgrid.functions import text as T
from rentgrid.functions.numbers import column
from rentgrid.operators.matching import all_of


def _place(df: DataFrame) -> Column:
    names = ("title", "description", "url", "region", "commune", "city", "primary_zone", "district", "location", "location_label")
    zones = [F.array_join("zones", " ")] if "zones" in df.columns else []
    return T.norm_nfd_space(F.concat_ws(" ", *[T.text(column(df, n)) for n in names], *zones))


def matched_zone(df: DataFrame, zones: list[str]) -> Column:
    """The first of the zones that the listing's texts name, or null."""
    blob = _place(df)
    hits = [F.when(blob.rlike(rf"\b{T.quoted(plain.fold_space(z))}\b"), z) for z in zones if plain.fold_space(z)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _prose(df: DataFrame) -> Column:
    return T.norm_nfd_space(F.concat_ws(" ", *[T.text(column(df, n)) for n in ("title", "description", "decision_summary")]))


def has_garden(df: DataFrame) -> Column:
    return _prose(df).rlike(r"\b(jardin|terrain|cour|exterieur)\b")


def floor_note(df: DataFrame) -> Column:
    """What a text says on floor and lift; null if it is the ground or first floor."""
    t = _prose(df)
    above = t.rlike(r"\b(2e|2eme|deuxieme|3e|3eme|troisieme|4e|4eme|etage)\b")
    lift = t.rlike(r"\b(ascenseur|elevator)\b")
    return (
        F.when(t.rlike(r"\b(rdc|rez de chaussee|1er|premier)\b"), None).when(above & lift, "floor_above_first_with_elevator")
        .when(above, "floor_without_elevator").otherwise("missing_floor_or_elevator_data")
    )


def _common(df: DataFrame, p: dict) -> tuple[dict, dict, Column, Column, Column, Column, Column]:
    c, f = p.get("criteria") or {}, p.get("fallbacks") or {}
    furnished = F.coalesce(F.nullif(column(df, "furnished"), F.lit("")), F.lit("Non précisé"))
    return c, f, N.as_int(column(df, "rent_eur")), column(df, "surface_m2", "double").cast("double"), column(df, "bedrooms", "int").cast("int"), furnished, matched_zone(df, c.get("zones") or [])


def _furnished(c: dict, f: dict, furnished: Column) -> tuple[Column, Column]:
    """(acceptable, only as a fallback)."""
    want = c.get("furnished_preference")
    if not want:
        return F.lit(True), F.lit(False)
    other = furnished.isin(*(f.get("furnished") or ["\0"]))
    return (furnished == want) | other, (furnished != want) & other


def evaluate(df: DataFrame, profile: dict) -> Column:
    """(decision, warnings) of a listing for a profile, or null: strict_match, or fallback_match with warnings."""
    c, f, rent, area, beds, furnished, zone = _common(df, profile)
    ok = [F.coalesce(column(df, "is_canonical", "boolean"), F.lit(True)), zone.isNotNull(), rent.between(int(c.get("rent_min_eur", 0)), int(c.get("rent_max_eur", 10**9))), area >= float(c.get("surface_min_m2", 0))]
    if c.get("property_type"):
        ok.append(column(df, "property_type").isin(*c["property_type"]))
    warnings = []
    if c.get("bedrooms_min") is not None:
        least = f.get("bedrooms_min")
        ok.append(beds >= int(c["bedrooms_min"] if least is None else min(least, c["bedrooms_min"])))
        warnings.append(F.when(beds < int(c["bedrooms_min"]), "two_bedrooms_fallback"))
    fine, second = _furnished(c, f, furnished)
    ok.append(fine)
    warnings.append(F.when(second, "furnished_fallback"))
    if c.get("elevator_required_above_floor") is not None:
        note, shown = floor_note(df), {"floor_without_elevator", *profile.get("warnings", []), *f}
        warnings.append(F.when(note.isin(*sorted(shown)), note))
    if "garden_preferred" in (profile.get("preferences") or []) and f.get("missing_garden"):
        warnings.append(F.when(~has_garden(df), "garden_missing_or_unknown"))
    w = F.array_sort(F.array_distinct(F.array_compact(F.array(*warnings))))
    return F.when(all_of(ok), F.struct(F.when(F.size(w) > 0, "fallback_match").otherwise("strict_match").alias("decision"), w.alias("warnings")))


def near_miss(df: DataFrame, profile: dict, rent_gap: float = 0.12, surface_gap: float = 0.10) -> Column:
    """(misses, warnings) of a listing of the right type and zone that misses by bounded gaps, or null."""
    c, f, rent, area, beds, furnished, zone = _common(df, profile)
    low, high, least = int(c.get("rent_min_eur", 0)), int(c.get("rent_max_eur", 10**9)), float(c.get("surface_min_m2", 0))
    say = lambda what, a, op, b: F.concat(F.lit(what + ":"), a.cast("string"), F.lit(f"{op}{b}"))
    ok = [F.coalesce(column(df, "is_canonical", "boolean"), F.lit(True)), zone.isNotNull()]
    if c.get("property_type"):
        ok.append(column(df, "property_type").isin(*c["property_type"]))
    ok.append(rent.isNull() | rent.between(low, high) | N.within_ratio(rent, F.when(rent < low, F.lit(low)).otherwise(F.lit(high)), rent_gap))
    ok.append(area.isNull() | (area >= least) | N.within_ratio(area, F.lit(least), surface_gap))
    number = F.when(area == F.floor(area), F.floor(area).cast("string")).otherwise(area.cast("string"))
    misses = [
        F.when(rent.isNull(), "rent_unknown").when(rent < low, say("rent_below_target", rent, "<", low)).when(rent > high, say("rent_above_target", rent, ">", high)),
        F.when(area.isNull(), "surface_unknown").when(area < least, F.concat(F.lit("surface_below_target:"), number, F.lit(f"<{least:g}"))),
    ]
    warnings = []
    if c.get("bedrooms_min") is not None:
        need, fb = int(c["bedrooms_min"]), f.get("bedrooms_min")
        second = (beds < need) & (beds >= int(fb)) if fb is not None else F.lit(False)
        ok.append(beds.isNull() | (beds >= need) | second | (beds + 1 >= need))
        misses.append(F.when(beds.isNull(), "bedrooms_unknown").when((beds < need) & ~second, say("bedrooms_below_target", beds, "<", need)))
        warnings.append(F.when(second, "two_bedrooms_fallback"))
    fine, fallback = _furnished(c, f, furnished)
    ok.append(fine)
    warnings.append(F.when(fallback, "furnished_fallback"))
    if "garden_preferred" in (profile.get("preferences") or []):
        warnings.append(F.when(~has_garden(df), "garden_missing_or_unknown"))
    m, w = F.array_compact(F.array(*misses)), F.array_sort(F.array_distinct(F.array_compact(F.array(*warnings))))
    return F.when(all_of(ok) & (F.size(m) > 0), F.struct(m.alias("misses"), w.alias("warnings")))


def profile_matches(df: DataFrame, profiles: list[dict], best: int = 20, near: int = 10) -> DataFrame:
    """For each profile its ``best`` matches (strict first, then by rent) and ``near`` near misses (fewest
    gaps first): profile_id, id, decision, warnings, misses, rank.  One pass over the listings."""
    hits = []
    for p in profiles:
        e, n = evaluate(df, p), near_miss(df, p)
        none = F.array().cast("array<string>")
        hits.append(
            F.when(e.isNotNull(), F.struct(F.lit(p["id"]).alias("profile_id"), e["decision"].alias("decision"), e["warnings"].alias("warnings"), none.alias("misses")))
            .when(n.isNotNull(), F.struct(F.lit(p["id"]).alias("profile_id"), F.lit("near_miss").alias("decision"), n["warnings"].alias("warnings"), n["misses"].alias("misses")))
        )
    rows = df.select("id", F.col("rent_eur").cast("long").alias("rent_eur"), F.inline(F.array_compact(F.array(*hits))))
    is_near = F.col("decision") == "near_miss"
    order = [F.when(F.col("decision") == "strict_match", 0).otherwise(1), F.size("misses"), F.coalesce("rent_eur", F.lit(10**9)), "id"]
    rank = F.row_number().over(Window.partitionBy("profile_id", is_near).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.when(is_near, near).otherwise(best))


# fixed values: points of a profile's score
ZONE_POINTS = {1: 30, 2: 26, 3: 20, 4: 14, 5: 10}
COMFORT_POINTS = (("jardin", 3), ("parking", 2), ("terrasse", 2), ("veranda", 2), ("clim", 1))


def zone_rank(df: DataFrame, zones: dict[int, list[str]]) -> Column:
    """The rank of the best-ranked zone that the place fields name, or null."""
    blob = T.norm_alnum(F.concat_ws(" ", *[T.text(column(df, n)) for n in ("quartier", "location_label", "title", "commune")]))
    hits = [F.when(T.contains_any(blob, [plain.fold(z) for z in zones[r] if plain.fold(z)]), F.lit(r)) for r in sorted(zones)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("int")


def profile_score(df: DataFrame, p: dict) -> Column:
    """0 to 100: zone, rent, surface and rooms, then furnishing, access, comfort and precision of place."""
    num = lambda n: column(df, n, "double").cast("double")
    rank = zone_rank(df, p["zones"])
    zone = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ZONE_POINTS.items() for x in kv]), rank), F.when(rank.isNotNull(), 8), F.lit(4))
    r, s = num("rent"), num("surface")
    low, high, need = p["loyer_min"], p["loyer_max"], p["surface_min"]
    rent = F.when(r.isNull(), 8).when(r.between(low, high), 22).when(r < low, 12).otherwise(F.greatest(F.lit(0.0), 16 - (r - high) / high * 60))
    area = F.when(s.isNull(), 8).when(s >= need, 22).otherwise(F.greatest(F.lit(0.0), 18 - (need - s) / need * 55))
    beds = F.coalesce(num("bedrooms"), F.greatest(N.truthy(num("rooms")) - 1, F.lit(0.0)))
    chambers = F.when(beds.isNull(), 6).when(beds >= p["chambres_ideal"], 16).when(beds >= p["chambres_min"], 11).otherwise(2)
    pts = zone + rent + area + chambers
    if p.get("types"):
        t = T.norm_alnum(column(df, "type"))
        pts = pts - F.when((t != "") & ~T.contains_any(t, [plain.fold(x) for x in p["types"]]), 12).otherwise(0)
    if p.get("non_meuble_prefere"):
        pts = pts + F.when(num("furnished") == 0, 5).when(num("furnished") == 1, -3).otherwise(0)
    if p.get("bonus_acces"):
        floor, lift = T.text(column(df, "floor")), num("elevator")
        pts = pts + F.when(floor.startswith("RDC"), 5).when(floor.startswith("1"), 4).when((floor != "") & (lift == 1), 3).when((floor != "") & (lift == 0), -4).otherwise(0)
    comfort = sum(F.when(num(k) > 0, v).otherwise(0) for k, v in COMFORT_POINTS) + F.when(num("nb_sdb") >= 2, 2).otherwise(0)
    pts = pts + F.least(comfort, F.lit(10)) + F.least(F.coalesce(num("location_precision_rank"), F.lit(0.0)) * 1.2, F.lit(6.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), N.half_even(pts).cast("int")))


def best_profile(df: DataFrame, profiles: dict[str, dict], least: int = 45) -> DataFrame:
    """Listings with the scores that reach ``least`` and the best of them, the first of equals."""
    scored = F.array_compact(F.array(*[F.when(profile_score(df, p) >= least, F.struct(profile_score(df, p).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("profile"))) for i, (k, p) in enumerate(profiles.items())]))
    out = df.withColumn("profiles", scored)
    return out.withColumns({"best_profile": F.array_max("profiles")["profile"], "best_score": F.coalesce(F.array_max("profiles")["score"], F.lit(0))})

"""Local price references and explainable scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.functions import text as T
from rentgrid.functions.numbers import column
from rentgrid.operators import ranks


def references(df: DataFrame, value: str, fine: list[str], coarse: list[str], least: int = 5) -> DataFrame:
    """Every row with its reference: the median of its fine group if that has ``least`` values, else of its
    coarse group, else of all; with the scope and the number of values.

    Medians are exact, and neither a large group nor the whole is gathered for them."""
    n = df.where(F.col(value).isNotNull()).count()
    level = lambda keys, p: ranks.medians(df, keys, value, n).withColumnsRenamed({"median": f"{p}_median", "n": f"{p}_n"})
    overall = level([], "all").agg(F.max("all_median").alias("all_median"), F.coalesce(F.max("all_n"), F.lit(0)).alias("all_n"))
    # one row for all; a group's row is joined by its keys
    out = df.join(level(fine, "fine"), fine, "left").join(level(coarse, "coarse"), coarse, "left").crossJoin(F.broadcast(overall))
    by_fine, by_coarse = F.col("fine_n") >= least, F.col("coarse_n") >= least
    pick = lambda what: F.when(by_fine, F.col(f"fine_{what}")).when(by_coarse, F.col(f"coarse_{what}")).otherwise(F.col(f"all_{what}"))
    out = out.withColumns({"reference": pick("median"), "reference_n": pick("n"), "reference_scope": F.when(by_fine, "fine").when(by_coarse, "coarse").otherwise("global")})
    return out.drop("fine_median", "fine_n", "coarse_median", "coarse_n", "all_median", "all_n")


def group_medians(df: DataFrame, key: str, value: str, least: int = 3, digits: int = 2) -> DataFrame:
    found = ranks.medians(df, [key], value)
    return found.where(F.col("n") >= least).select(key, N.half_even(F.col("median"), digits).alias("median"), "n")


def exclusive_quartiles(df: DataFrame, key: str, value: str, least: int = 100) -> DataFrame:
    """Exact quartiles by the exclusive method, whole numbers, for groups of ``least`` values at least.

    Only the ranges of values that hold a wanted rank are read, so one key may have nearly all rows."""
    first = lambda n, pct: F.greatest(F.lit(1), F.least(n - 1, F.floor(pct * (n + 1) / 100)))

    def wanted(pct: int):
        return lambda n: F.when(n >= least, F.array((first(n, pct) - 1).cast("long"), first(n, pct).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    at = ranks.at_ranks(df, [key], value, {pct / 100: wanted(pct) for pct in (25, 75)})
    out, n = {}, F.col("total")
    for pct in (25, 75):
        j = first(n, pct)
        delta = F.max(pct * (n + 1) - j * 100)
        value_at = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
        out[pct] = ((value_at(j - 1) * (100 - delta) + value_at(j) * delta) / 100.0).cast("long")
    return at.groupBy(key).agg(F.max("total").alias("n"), out[25].alias("p25"), out[75].alias("p75"))


def opportunity(df: DataFrame, least: int = 5) -> DataFrame:
    """Listings with score, label, confidence and the six components of an opportunity.

    Price against the local reference, quality of the listing, location, freshness, risk and confidence
    in the data; the components are clamped one by one and add up to 100 at most."""
    price, surface = N.as_int(column(df, "rent_eur", "double")), column(df, "surface_m2", "double").cast("double")
    commune = F.coalesce(F.nullif(column(df, "commune"), F.lit("")), F.nullif(column(df, "city"), F.lit("")), F.lit("Non précisée"))
    kind = F.coalesce(F.nullif(T.norm_nfd_space(column(df, "property_type")), F.lit("")), F.lit("type_nc"))
    base = df.withColumns({"_p": price, "_s": surface, "_commune": commune, "_kind": kind, "price_per_m2": N.price_per_m2(price, surface)})
    r = references(base, "price_per_m2", ["_commune", "_kind"], ["_commune"], least)
    ppm, ref, n = F.col("price_per_m2"), F.col("reference"), F.col("reference_n")
    delta = (ref - ppm) / ref
    market = F.when(ppm.isNull() | ref.isNull() | (ref == 0), 0).when(delta >= 0.18, 34).when(delta >= 0.08, 27).when(delta >= -0.05, 18).otherwise(F.greatest(F.lit(0), N.half_even(16 + delta * 70).cast("int")))
    images = F.size(F.filter(F.col("local_image_urls"), lambda x: x != "")) if "local_image_urls" in df.columns else F.lit(0)
    photos = F.when(images > 0, images).when(F.coalesce(column(df, "local_image_url"), F.lit("")) != "", 1).otherwise(0)
    length = F.length(F.coalesce(column(df, "description"), F.lit("")))
    rooms = column(df, "rooms", "double").cast("double")
    quality = F.when(photos >= 3, 10).when(photos >= 1, 7).otherwise(0) + F.when(length >= 350, 8).when(length >= 120, 5).otherwise(-4)
    quality = quality + F.when((rooms != 0) & (F.col("_s") / F.greatest(rooms, F.lit(1.0)) >= 18), 4).otherwise(0)
    where = column(df, "location_quality")
    place = F.least(F.lit(13), F.when(where == "haute", 10).when(where == "moyenne", 7).otherwise(3) + F.when(column(df, "focus", "boolean"), 3).otherwise(0))
    fresh = F.when(F.coalesce(column(df, "is_new", "boolean"), F.lit(False)), 5).otherwise(3)
    both = (F.col("_p") != 0) & (F.col("_s") != 0)
    risk = F.greatest(F.lit(0), 12 - F.when(column(df, "dedup_group_id").isNotNull(), 3).otherwise(0) - F.when(F.col("_p") > 3500, 6).otherwise(0) - F.when(F.coalesce(both, F.lit(False)), 0).otherwise(6))
    sure = F.when(n >= 12, 4).when(n >= 5, 3).when(n >= 3, 2).otherwise(0) + F.when(both, 2).otherwise(0) + F.when(length >= 120, 2).otherwise(0) + F.when(photos > 0, 1).otherwise(0) + F.when(where.isin("haute", "moyenne"), 1).otherwise(0)
    out = r.withColumns(
        {"market_price": market, "listing_quality": F.greatest(F.lit(0), F.least(F.lit(22), quality)), "location_fit": place, "freshness": fresh, "risk": risk, "data_confidence": F.least(F.lit(10), sure)}
    )
    total = sum(F.col(c) for c in ("market_price", "listing_quality", "location_fit", "freshness", "risk", "data_confidence"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return out.withColumn("score", score).withColumns(
        {
            "label": F.when(F.col("score") >= 75, "opportunité forte").when(F.col("score") >= 58, "à étudier").when(F.col("score") >= 42, "standard").otherwise("risque/bruit"),
            "confidence": F.when(F.col("data_confidence") >= 8, "haute").when(F.col("data_confidence") >= 5, "moyenne").otherwise("faible"),
        }
    ).drop("_p", "_s", "_commune", "_kind")


def top_opportunities(scored: DataFrame, n: int = 80) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc(F.col("confidence") == "haute"), "id").limit(n)


# fixed values: fields of the completeness score with their labels and points
COMPLETENESS = (
    ("rent_eur", "loyer", 18), ("surface_m2", "surface", 18), ("rooms", "pièces", 10), ("bedrooms", "chambres", 8),
    ("url", "lien source", 10), ("image_url", "photo", 12), ("description", "description", 8), ("published_at", "date publication", 6),
)


def completeness(df: DataFrame, city: Column, region: Column) -> Column:
    """(score, missing): points for the fields given, 100 at most, and the labels of the others."""
    has = lambda n: T.clean(column(df, n)) != ""
    points = sum(F.when(has(f), p).otherwise(0) for f, _, p in COMPLETENESS)
    known = F.coalesce(city, F.lit("Non précisée")) != "Non précisée"
    points = points + F.when(known, 16).otherwise(0) + F.when(region != "Région non précisée", 6).otherwise(0)
    missing = F.array_compact(F.array(*[F.when(~has(f), label) for f, label, _ in COMPLETENESS], F.when(~known, "ville normalisée")))
    return F.struct(F.least(points, F.lit(100)).alias("score"), missing.alias("missing"))


# fixed values: zones that count most, and the budget aimed at
PRIORITY_ZONES, WIDE_ZONE, BUDGET, NEAR_BUDGET, ROOMY = ("Moufia", "La Bretagne", "Sainte-Marie"), "Saint-Denis", (600, 1000), 1200, 60


def default_score(df: DataFrame) -> Column:
    c = lambda n, t="string": column(df, n, t)
    zone, rent, area = c("primary_zone"), c("rent_eur", "double"), c("surface_m2", "double")
    return sum(
        (
            F.when(zone.isin(*PRIORITY_ZONES), 40).when(zone == WIDE_ZONE, 18).otherwise(0), F.when(area >= ROOMY, 16).otherwise(0), F.when(rent.between(*BUDGET), 18).otherwise(0),
            F.when(c("bedrooms", "int") >= 1, 10).when(c("rooms", "int") >= 2, 8).otherwise(0),
            F.when(c("furnished") == "Non meublé", 8).when(c("furnished") == "Non précisé", 3).otherwise(0), F.when(c("image_url") != "", 10).otherwise(0),
        ),
        F.lit(0),
    )


def variant_tags(df: DataFrame) -> Column:
    c = lambda n, t="string": column(df, n, t)
    zone, rent, area = c("primary_zone"), c("rent_eur", "double"), c("surface_m2", "double")
    target = F.coalesce(zone.isin(*PRIORITY_ZONES, WIDE_ZONE), F.lit(False))
    tags = F.array(
        F.when(target, "Zone ciblée"), F.when(zone.isin(*PRIORITY_ZONES), "Zone prioritaire"), F.when(rent.between(*BUDGET), "Budget 600–1000€").when((rent != 0) & (rent <= NEAR_BUDGET), "Budget proche"),
        F.when(area >= ROOMY, "≥ 60 m²").when(area >= 50, "Surface proche"), F.when(c("furnished") == "Meublé", "Variante meublée"),
        F.when(~target & rent.between(*BUDGET) & (area >= ROOMY), "Même budget/surface ailleurs"),
    )
    return F.slice(F.array_compact(tags), 1, 4)


def decision_summary(df: DataFrame) -> Column:
    c = lambda n, t="string": column(df, n, t)
    zone, rent = c("primary_zone"), c("rent_eur", "double")
    reasons = F.array(
        F.when((c("region") != "") & (c("region") != "Région non précisée"), c("region")), F.when(zone.isin(*PRIORITY_ZONES), "zone prioritaire").when(zone == WIDE_ZONE, "secteur cible large"),
        F.when(rent.between(*BUDGET), "budget cible").when((rent != 0) & (rent <= NEAR_BUDGET), "budget proche"), F.when(c("surface_m2", "double") >= ROOMY, "surface confortable"),
        F.when(c("furnished") == "Non meublé", "non meublé"),
    )
    return F.coalesce(F.nullif(F.array_join(F.slice(F.array_compact(reasons), 1, 4), " · "), F.lit("")), F.lit("à vérifier manuellement"))


def summary_points(score: Column, delta: Column, photos: Column, precision: Column) -> Column:
    """(positive, warning) points of a card, five and four at most."""
    good = F.array(F.when(score >= 75, "score élevé").when(score >= 58, "score correct"), F.when(delta >= 0.08, "prix/m² sous la référence"), F.when(photos >= 3, "galerie fournie"), F.when(precision >= 3, "localisation précise"))
    bad = F.array(F.when(score < 42, "score faible"), F.when(delta < -0.05, "prix/m² au-dessus de la référence"), F.when(photos == 0, "sans photo"), F.when(precision <= 1, "localisation imprécise"))
    keep = lambda a, n: F.slice(F.array_distinct(F.array_compact(a)), 1, n)
    return F.struct(keep(good, 5).alias("positive"), keep(bad, 4).alias("warning"))


def residential_reasons(title: Column, description: Column, kind: Column, url: Column, rent: Column) -> Column:
    """Why a listing is probably no home; an empty list if nothing speaks against it.

    A medical office that is only a possible use of a home doesn't count."""
    strong = F.concat_ws(" ", T.clean(title), T.norm_translate(kind), T.clean(url))
    # fixed values: words of premises that are no homes
    hard = r"(?i)\b(local\s+(?:commercial|professionnel|m[eé]dical)|locaux\s+commerciaux|bureau(?:x)?\b|box\b|parking\b|garage\b|garde\s*-?\s*meuble|terrain\b|entrep[oô]t)"
    soft = r"(?i)\b(local\s+(?:commercial|professionnel|m[eé]dical)|locaux\s+commerciaux)\b"
    home = F.concat_ws(" ", T.clean(title), T.norm_translate(kind)).rlike(r"(?i)\b(maison|villa|appartement|studio|duplex|t[1-6]|f[1-6])\b")
    incidental = T.clean(description).rlike(r"(?i)(possibilit[eé].{0,80}local\s+m[eé]dical|am[eé]nag[eé]e?.{0,80}cabinet\s+m[eé]dical)")
    word, prose = F.regexp_extract(strong, hard, 1), F.regexp_extract(T.clean(description), soft, 1)
    return F.array_compact(
        F.array(
            F.when(T.norm_translate(kind).isin("commercial", "box"), F.concat(F.lit("property_type="), T.norm_translate(kind))),
            F.when(word != "", F.concat(F.lit("strong_keyword="), word)), F.when((prose != "") & ~(home & incidental), F.concat(F.lit("description_keyword="), prose)),
            F.when(rent > 10000, "rent_eur>10000"),
        )
    )

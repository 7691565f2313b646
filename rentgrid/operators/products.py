"""The product's rows: items of the product view, clean public items, and what is published of them.

Each is one specification (``functions.nested``) over computed columns, so a field is named once, with where it
comes from and what stands in for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import extract as X
from rentgrid.functions import geo, nested, semantics
from rentgrid.functions import numbers as N
from rentgrid.functions import text as T
from rentgrid.functions.nested import ALL, First, Most, Path
from rentgrid.operators import market, public, windows


def _given(c: Column) -> Column:
    """The cleaned text, or null if nothing is left of it."""
    return F.nullif(T.clean(c), F.lit(""))


def _plain(c: Column) -> Column:
    """A number as people write it: no decimals if it has none."""
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def described(description: Column, title: Column, kind: Column, rooms: Column, bedrooms: Column, area: Column, rent: Column, place: Column, source: Column) -> Column:
    """(text, status): the source's own description, or a synthesis of the fields where that is too short,
    repeats the title or is a crawler's card."""
    own, name = T.clean(description), T.clean(title)
    genuine = (F.length(own) >= 45) & (F.lower(own) != F.lower(name)) & ~X.is_boilerplate(own)
    some = lambda c: N.truthy(c)
    parts = F.concat_ws(
        ", ", F.nullif(kind, F.lit("")), F.concat(some(rooms).cast("string"), F.lit(" pièce(s)")), F.concat(some(bedrooms).cast("string"), F.lit(" chambre(s)")),
        F.concat(_plain(some(area)), F.lit(" m²")), F.concat(some(rent).cast("string"), F.lit(" €/mois")),
    )
    made = F.concat(F.when(name != "", F.concat(name, F.lit(". "))).otherwise(""), F.lit("Repères extraits: "), parts, F.lit(". Secteur: "), place, F.lit(". Source: "), F.coalesce(source, F.lit("n.c.")))
    return F.when(genuine, F.struct(own.alias("text"), F.lit("Description source").alias("status"))).otherwise(F.struct(made.alias("text"), F.lit("Synthèse depuis titre + champs").alias("status")))


def product_items(view: DataFrame) -> DataFrame:
    """Items of the product view's rows (raw fields with their enrichment, any of which may be missing).

    Zone and commune are the enrichment's if it has both, else both are read from the texts; a number of bedrooms that
    is missing or 0 is one less than the rooms."""
    c = lambda n, t="string": N.column(view, n, t)
    words = T.norm_translate(geo.all_text(c("city"), c("district"), c("title"), c("description"), c("url")))
    d = view.withColumns({"_zone": _given(c("zone_normalized")), "_commune": _given(c("city_normalized"))})
    both = F.col("_zone").isNotNull() & F.col("_commune").isNotNull()
    d = d.withColumn("_own", F.when(both, F.col("_commune")).otherwise(geo.detect_commune(c("city"), c("district"), c("title"), c("description"), c("url"))))
    d = d.withColumn("_read", F.when(~both, geo.detect_zones(words, F.col("_own"))))
    d = d.withColumns({"_zone": F.when(both, F.col("_zone")).otherwise(F.col("_read.primary")), "_stored": F.when(both, F.from_json(c("zones_json"), "array<string>")).otherwise(F.col("_read.zones"))})
    known = (F.col("_zone") != "") & (F.col("_zone") != geo.UNKNOWN_ZONE)
    rooms, area = c("rooms", "int"), c("surface_m2", "double").cast("double")
    given = c("residential_status")
    reasons = F.when(F.coalesce(given != "", F.lit(False)), F.coalesce(F.from_json(c("residential_reasons_json"), "array<string>"), F.array().cast("array<string>"))).otherwise(
        market.residential_reasons(c("title"), c("description"), c("property_type"), c("url"), F.lit(None).cast("double"))
    )
    d = d.withColumns(
        {
            "_reasons": reasons, "_region": F.coalesce(_given(c("region")), geo.region_for(F.col("_own"))),
            "_kind": F.coalesce(_given(c("property_type_normalized")), geo.property_label(c("property_type"), c("title"))),
            "_bedrooms": F.coalesce(N.truthy(c("bedrooms", "int")), F.when(N.truthy(rooms).isNotNull(), F.greatest(rooms - 1, F.lit(0)))),
            "_furnished": X.furnished_status(c("title"), c("description"), c("url")), "_rent": c("rent_eur", "double").cast("long"), "_place": public.place_label(c("district"), F.col("_own"), F.col("_zone")),
        }
    )
    pack = described(c("description"), c("title"), F.col("_kind"), rooms, F.col("_bedrooms"), area, F.col("_rent"), F.col("_place"), c("source_site"))
    d = d.withColumn("_pack", pack)
    key = lambda a, b: F.concat_ws(":", a, b)
    other = F.when((c("canonical_source_site") != "") & (c("canonical_source_id") != ""), key(c("canonical_source_site"), c("canonical_source_id")))
    item = nested.project(d, {
        "id": key(c("source_site"), c("source_id")), "source_site": ALL, "source_id": ALL, "url": ALL, "title": F.coalesce(_given(c("title")), F.lit("Annonce sans titre")),
        "city": F.coalesce(_given(c("city")), F.col("_own")), "commune": F.col("_own"), "region": F.col("_region"), "primary_zone": F.col("_zone"),
        "zones": F.when(F.size("_stored") > 0, F.col("_stored")).when(known, F.array("_zone")).otherwise(F.array().cast("array<string>")),
        "property_type": F.col("_kind"), "rooms": rooms, "bedrooms": F.col("_bedrooms"), "surface_m2": area, "rent_eur": F.col("_rent"), "furnished": F.col("_furnished"),
        "agency_or_owner": T.clean(c("agency_or_owner")), "image_url": ALL, "seen_last_at": ALL, "published_at": ALL, "location_label": F.col("_place"),
        "description": F.col("_pack.text"), "description_status": F.col("_pack.status"), "residential_reasons": F.col("_reasons"),
        "residential_status": F.coalesce(F.nullif(given, F.lit("")), F.when(F.size("_reasons") > 0, "suspect_non_residential").otherwise("residential_candidate")),
        "db_quality_score": Path("quality_score"), "db_is_canonical": c("is_canonical", "int").cast("boolean"), "db_canonical_id": other,
        "db_duplicate_group_size": Path("duplicate_group_size"), "db_duplicate_group_rank": Path("duplicate_group_rank"),
    })
    return item.withColumns({"decision_summary": market.decision_summary(item), "score": market.default_score(item), "variant_tags": market.variant_tags(item)})


def thumbnail_names(url: Column) -> Column:
    """The names under which an image may be stored: beginnings of its address's digest, by kind of file."""
    digest = F.sha2(url, 256)
    return F.array(*[F.concat(F.left(digest, F.lit(n)), F.lit(kind)) for kind in (".jpg", ".jpeg", ".webp", ".png") for n in (24, 32, 40, 64)])


def with_local_image(df: DataFrame, files: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose image is stored get its path as ``local_image_url``, unless they have one.  files: (name)."""
    table = files.select("name", F.concat(F.lit("thumbs/"), "name").alias("_thumb")).distinct()
    found = windows.first_known(df, thumbnail_names(F.col("image_url")), table, "name", id_col)
    return found.withColumn("local_image_url", F.coalesce(F.nullif(N.column(df, "local_image_url"), F.lit("")), "_thumb")).drop("_thumb")


def _asset(path: Column) -> Column:
    p = F.trim(path)
    return F.when(p.startswith("/thumbs/"), F.regexp_replace(p, "^/+", "")).otherwise(p)


def clean_items(df: DataFrame) -> DataFrame:
    """Clean public items of exported rows, whose ``location_intelligence`` and ``opportunity_analysis`` may be structs."""
    listed = lambda n: F.coalesce(N.column(df, n, "array<string>"), F.array().cast("array<string>"))
    one = lambda c: F.array_compact(F.array(F.nullif(c, F.lit(""))))
    uniq = lambda a: F.array_distinct(F.filter(a, lambda x: x != ""))
    number = lambda *ns: F.coalesce(*[N.truthy(N.column(df, n, "double").cast("double")) for n in ns])
    d = df.withColumns(
        {
            "_price": number("rent_eur", "price_eur", "price").cast("long"), "_local": F.nullif(_asset(N.column(df, "local_image_url")), F.lit("")),
            "_found": semantics.found_in(N.column(df, "title"), N.column(df, "description")),
        }
    )
    d = d.withColumns(
        {
            "_gallery": uniq(F.concat(F.transform(listed("local_image_urls"), _asset), one(F.col("_local")))), "_outside": uniq(F.concat(listed("image_urls"), one(N.column(df, "image_url")))),
            "_said": semantics.analysis(N.column(df, "title"), N.column(df, "description"), N.column(df, "description_status"), F.col("_price"), F.col("_found")),
        }
    )
    images = F.struct(
        F.lit("image_quality_v1").alias("version"), F.col("_local").isNotNull().alias("valid_local_primary"), F.size("_gallery").alias("valid_local_count"), F.size("_outside").alias("external_count"),
        F.when(F.col("_local").isNotNull(), "local").when(F.size("_outside") > 0, "external_only").otherwise("missing").alias("status"),
    )
    where = "location_intelligence"
    at = lambda p, t: (x[0] if (x := nested.at(None, d.schema, p)) else F.lit(None)).cast(t)
    level = F.struct(
        F.coalesce(F.nullif(at(f"{where}.quality", "string"), F.lit("")), F.lit("commune")).alias("level"), at(f"{where}.confidence", "double").alias("confidence"),
        F.coalesce(F.nullif(at(f"{where}.method", "string"), F.lit("")), F.lit("exported_location_intelligence")).alias("method"),
    )
    return nested.project(d, {
        "id": ALL, "source": First("source_site", "source", default="source"), "source_id": ALL, "url": ALL, "title": First("title", default="Annonce immobilière"),
        "city": First(f"{where}.commune_inferred", "commune", "city", default=""), "district": First(f"{where}.district_best", "primary_zone", "city", "location_label", default=""),
        "region": First(f"{where}.region_inferred", "region", default=""), "location": First(f"{where}.precise_location_label", "location_label", "commune", "city", default=""),
        "location_intelligence": ALL, "map_point": Path(f"{where}.map_point"), "map_url": Path(f"{where}.map_point.osm_url"), "type": First("property_type", "type", default="Bien"),
        "price": F.col("_price"), "surface": First("surface_m2", "surface"), "rooms": ALL, "bedrooms": ALL, "furnished": First("furnished", default="Non précisé"), "agency": First("agency_or_owner", default=""),
        "image_url": ALL, "image_urls": F.col("_outside"), "local_image_url": F.col("_local"), "local_image_urls": F.col("_gallery"), "description": First("description", default=""),
        "description_status": First("description_status", default=""), "description_analysis": F.col("_said"), "feature_tags": semantics.feature_tags(F.col("_said")), "image_quality": images,
        "geo_quality": Path("geo_quality") if "geo_quality" in df.columns else level, "seen_last_at": First("seen_last_at", "last_seen_at", default=""), "published_at": ALL,
        "score": First("score", "db_quality_score", default=0), "opportunity_analysis": ALL, "opportunity_score": First("opportunity_analysis.score", "opportunity_score", "score", default=0),
    })


# fixed values: what is published of an item, and of its parts
_HOUSING = {"count": ALL, "label": ALL, "ground_floor_count": ALL, "upstairs_count": ALL, "status": ALL, "evidence": Most(2)}
PUBLISHED = {
    "id": ALL, "source": ALL, "source_id": ALL, "url": ALL, "title": ALL, "city": ALL, "district": ALL, "region": ALL, "location": ALL,
    "location_intelligence": {"district_best": ALL, "precise_location_label": ALL, "commune_inferred": ALL, "district_hints": Most(5)},
    "map_point": ALL, "map_url": ALL, "type": ALL, "price": ALL, "surface": ALL, "rooms": ALL, "bedrooms": ALL, "furnished": ALL, "agency": ALL, "image_url": ALL, "local_image_url": ALL,
    "local_image_urls": ALL, "description": ALL, "description_status": ALL, "description_analysis": {"property_state": {"furnished": {"status": ALL}}}, "seen_last_at": ALL, "published_at": ALL,
    "score": ALL, "opportunity_score": ALL,
    "opportunity_analysis": {"score": ALL, "label": ALL, "segment": ALL, "reasons": Most(6), "risks": Most(6), "signals": Most(6), "recommendation": ALL},
    "feature_tags": ALL, "geo_quality": ALL, "image_quality": ALL, "seen_also_on": ALL, "dedup_product_note": ALL, "dedup_group_id": ALL, "dedup_decision": ALL, "dedup_confidence": ALL,
    "dedup_role": ALL, "dedup_reason": ALL, "dedup_sources": ALL, "canonical_display_id": ALL, "display_canonical": ALL,
    "housing_details": {"bathrooms": _HOUSING, "wc": _HOUSING, "layout": _HOUSING, "bedroom_distribution": _HOUSING},
}


def published(items: DataFrame) -> DataFrame:
    """(id, document): the publishable part of items as JSON; items without a positive price are left out."""
    shown = items.where(public.price_publishable(F.col("price"))) if "price" in items.columns else items
    return shown.select("id", nested.document(shown, PUBLISHED).alias("document"))

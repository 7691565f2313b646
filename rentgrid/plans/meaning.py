"""What texts say and what is published of listings: semantics, items, documents and their redaction.

Texts and documents are written from a listing's own numbers; the SQL states what each variant must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import housing, semantics, variant
from rentgrid.operators import products
from rentgrid.plans.stand_in import LISTING_SQL, listings, table

_N = f"WITH {LISTING_SQL}, l AS (SELECT *, id::INT AS n, surface_m2::INT AS area FROM listing)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumns({"n": F.expr("cast(id as int)"), "area": F.expr("cast(surface_m2 as int)")})


# ---- semantics

#: The parts of a listing's text by its number, as Spark and DuckDB both read them.
_SAID = {
    "state": "CASE n % 4 WHEN 0 THEN 'Appartement non meublé' WHEN 1 THEN 'Location meublée' WHEN 2 THEN 'Logement meublé, puis loué vide' ELSE 'Logement calme' END",
    "cars": "CASE n % 6 WHEN 0 THEN 'Sans parking' WHEN 1 THEN '2 places de parking' WHEN 2 THEN 'Pas de grand garage, mais un box' WHEN 3 THEN 'Ni garage clos ni box' WHEN 4 THEN 'Sans vis-à-vis avec parking' ELSE 'Au calme' END",
    "outside": "CASE n % 5 WHEN 0 THEN 'Terrasse et jardin' WHEN 1 THEN 'Aucune piscine, balcon' WHEN 2 THEN 'Varangue sans jardin' WHEN 3 THEN 'Jardin, aucun autre jardin' ELSE 'Vue mer' END",
    "sums": "concat('Loyer : ', CASE n % 7 WHEN 0 THEN concat('2 ', lpad(cast(n % 1000 as {text}), 3, '0')) ELSE cast(rent_eur as {text}) END, ' €', CASE n % 3 WHEN 0 THEN ' CC' WHEN 1 THEN ' hors charges' ELSE '' END)",
    "bond": "CASE n % 2 WHEN 0 THEN concat('Dépôt de garantie : ', cast(rent_eur * 2 as {text}), ' €') ELSE concat('Honoraires locataire : ', cast(100 + n % 90 as {text}), ',50 €') END",
    "open": "CASE n % 3 WHEN 0 THEN 'Disponible immédiatement' WHEN 1 THEN 'Libre le 1/2/2026' ELSE 'Bientôt libre' END",
    "near": "CASE n % 4 WHEN 0 THEN 'Proche de la plage' WHEN 1 THEN 'À deux pas du centre' ELSE 'Rue calme' END",
}
_PARTS = ("state", "cars", "outside", "sums", "bond", "open", "near")


def _text(kind: str) -> str:
    return "concat(" + ", '. ', ".join(f"({_SAID[p]})" for p in _PARTS).replace("{text}", kind) + ", '.')"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a text that says what they are like, and what was found in it."""
    d = _numbered(spark, sf_dir).withColumn("ad", F.expr(_text("string")))
    return d.withColumn("found", semantics.found_in(F.col("title"), F.col("ad")))


def description_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, rule and evidence with its span by field of every listing's text."""
    status = F.when(F.col("n") % 5 == 0, "Synthèse depuis titre + champs")
    d = said(spark, sf_dir).withColumn("a", semantics.analysis(F.col("title"), F.col("ad"), status, F.col("rent_eur"), F.col("found")))
    furnished, parking, sums = F.col("a.property_state.furnished"), F.col("a.features.parking"), F.col("a.financials")
    first = lambda c, f: F.get(c["evidence"], F.lit(0))[f]
    return d.select(
        "id", furnished["status"].alias("furnished"), first(furnished, "rule").alias("furnished_rule"), first(furnished, "text").alias("furnished_text"), first(furnished, "start").alias("furnished_start"),
        F.coalesce(parking["present"], F.lit(False)).alias("parking"), parking["stance"].alias("parking_stance"), first(parking, "text").alias("parking_text"), first(parking, "negated").alias("parking_negated"),
        F.array_join(F.transform("a.features.outdoor.evidence", lambda e: e["rule"]), ",").alias("outdoor"), F.array_join("a.features.outdoor.denied", ",").alias("outdoor_denied"),
        sums["rent_mentioned_eur"]["value"].alias("rent"), sums["rent_mentioned_eur"]["charge_basis"].alias("basis"), first(sums["rent_mentioned_eur"], "start").alias("rent_start"),
        first(sums["charges"], "text").alias("charges"), sums["deposit"]["amount_eur"].alias("deposit"), sums["agency_fees"]["amount_eur"].alias("fees"),
        F.col("a.availability.status").alias("availability"), F.get("a.proximity.raw_mentions", F.lit(0))["text"].alias("near"), F.get("a.proximity.raw_mentions", F.lit(0))["end"].alias("near_end"),
        F.array_join("a.quality.warnings", ",").alias("warnings"), F.array_join(semantics.feature_tags(F.col("a")), ",").alias("tags"),
    )


DESCRIPTION_SEMANTICS = f"""{_N}, t AS (SELECT *, {_text("VARCHAR")} AS ad FROM l),
 s AS (SELECT *, title || chr(10) || ad AS whole, CASE n % 7 WHEN 0 THEN 2000 + n % 1000 ELSE rent_eur END::BIGINT AS rent, CASE n % 4 WHEN 0 THEN 'non meublé' WHEN 1 THEN 'Location meublée' WHEN 2 THEN 'loué vide' END AS ft,
   CASE n % 6 WHEN 0 THEN 'parking' WHEN 1 THEN '2 places de parking' WHEN 2 THEN 'garage' WHEN 3 THEN 'garage clos' WHEN 4 THEN 'parking' END AS pt,
   CASE n % 4 WHEN 0 THEN 'Proche de la plage' WHEN 1 THEN 'À deux pas du centre' END AS near FROM t)
SELECT id, CASE n % 4 WHEN 0 THEN 'non_meuble' WHEN 1 THEN 'meuble' WHEN 2 THEN 'non_meuble' ELSE 'unknown' END AS furnished, CASE n % 4 WHEN 1 THEN 'furnished_positive' WHEN 3 THEN NULL ELSE 'furnished_negative' END AS furnished_rule,
 ft AS furnished_text, (strpos(whole, ft) - 1)::INT AS furnished_start, n % 6 <> 5 AS parking, CASE n % 6 WHEN 5 THEN 'unknown' WHEN 0 THEN 'denied' WHEN 3 THEN 'denied' ELSE 'affirmed' END AS parking_stance,
 pt AS parking_text, CASE WHEN n % 6 IN (0, 2, 3) THEN true WHEN n % 6 < 5 THEN false END AS parking_negated,
 CASE n % 5 WHEN 0 THEN 'terrace,garden' WHEN 1 THEN 'balcony,pool' WHEN 2 THEN 'varangue,garden' WHEN 3 THEN 'garden' ELSE '' END AS outdoor, CASE n % 5 WHEN 1 THEN 'pool' WHEN 2 THEN 'garden' ELSE '' END AS outdoor_denied,
 rent, CASE n % 3 WHEN 0 THEN 'cc' WHEN 1 THEN 'hc' ELSE 'unknown' END AS basis, (strpos(whole, 'Loyer :') - 1)::INT AS rent_start, CASE n % 3 WHEN 0 THEN 'CC' WHEN 1 THEN 'hors charges' END AS charges,
 CASE n % 2 WHEN 0 THEN rent_eur * 2 END::BIGINT AS deposit, CASE n % 2 WHEN 1 THEN (100 + n % 90) * 100 + 50 END::BIGINT AS fees, CASE WHEN n % 3 < 2 THEN 'mentioned' ELSE 'unknown' END AS availability,
 near, (strpos(whole, near) - 1 + length(near))::INT AS near_end,
 concat_ws(',', CASE WHEN n % 5 = 0 THEN 'description_fallback_synthetic' END, CASE WHEN length(ad) < 120 THEN 'description_short_or_sparse' END,
  CASE WHEN abs(rent - rent_eur) >= 500 THEN 'rent_field_mismatch: field price=' || rent_eur || ', text rent=' || rent END) AS warnings,
 concat_ws(',', CASE n % 4 WHEN 0 THEN 'Non meublé' WHEN 1 THEN 'Meublé' WHEN 2 THEN 'Non meublé' END, CASE WHEN n % 6 <> 5 THEN 'Parking' END, CASE WHEN n % 5 < 3 THEN 'Varangue / terrasse' END,
  CASE WHEN n % 5 IN (0, 2, 3) THEN 'Jardin' END, CASE WHEN n % 5 = 1 THEN 'Piscine' END) AS tags FROM s"""


def secret_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that seem to hold secrets, with how many; the plain tokens of the table are named as access tokens."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", variant.secret_hints(F.replace("text", F.lit("token = "), F.lit("access_token = "))).alias("hints")).where("hints > 0")


_HINT = variant.SECRET_HINT.replace("'", "''")
SECRET_HINTS = f"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(replace(text, 'token = ', 'access_token = '), '{_HINT}'))::INT AS hints FROM documents) WHERE hints > 0"


# ---- housing details

_ROOMS = """concat(CASE n % 5 WHEN 0 THEN 'Duplex. ' WHEN 1 THEN 'Maison de plain-pied. ' ELSE '' END, CASE n % 4 WHEN 0 THEN 'Deux douches et 1 sdb, ' WHEN 1 THEN 'une salle d’eau, ' WHEN 2 THEN '12 douches, ' ELSE '' END,
 CASE n % 3 WHEN 0 THEN 'WC. ' WHEN 1 THEN '3 toilettes. ' ELSE 'calme. ' END, CASE n % 7 WHEN 0 THEN 'Au rez-de-chaussée, une chambre; à l''étage : trois chambres.' WHEN 1 THEN 'Elle comprend: 2 chambres et à l''étage une chambre.' WHEN 2 THEN 'Quatre chambres.' WHEN 3 THEN 'RDC avec cuisine.' ELSE '' END)"""


def housing_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by noun and storey; a split beyond the listing's bedrooms is hidden."""
    d = _numbered(spark, sf_dir).withColumn("h", housing.details(F.lit("T"), F.expr(_ROOMS), F.col("bedrooms")))
    split = F.col("h.bedroom_distribution")
    return d.select(
        "id", F.col("h.bathrooms.count").alias("bathrooms"), F.col("h.bathrooms.confidence").alias("confidence"), F.size("h.bathrooms.evidence").alias("n_evidence"), F.col("h.wc.count").alias("wc"), F.col("h.layout.label").alias("label"),
        F.array_join("h.layout.evidence", "|").alias("storeys"), split["ground_floor_count"].alias("ground"), split["upstairs_count"].alias("upstairs"), split["status"].alias("status"), F.array_join(split["evidence"], "|").alias("said"),
    )


HOUSING_DETAILS = f"""{_N}, k AS (SELECT *, CASE n % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS low, CASE n % 7 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS up FROM l), c AS (SELECT *, coalesce(low + up > nullif(bedrooms, 0), false) AS apart FROM k)
SELECT id, CASE n % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 END::INT AS bathrooms, CASE WHEN n % 4 = 3 THEN 'absent' ELSE 'source_text' END AS confidence, CASE n % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END::INT AS n_evidence,
 CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END::INT AS wc, CASE WHEN n % 5 = 1 THEN 'Tout RDC / plain-pied' WHEN n % 5 = 0 OR n % 7 = 0 THEN 'Duplex / étage(s)' WHEN n % 7 = 3 THEN 'RDC mentionné' WHEN n % 7 = 1 THEN 'Étage mentionné' ELSE 'Non précisé' END AS label,
 concat_ws('|', CASE WHEN n % 7 = 3 THEN 'RDC' END, CASE WHEN n % 5 = 0 THEN 'Duplex' END, CASE WHEN n % 5 = 1 THEN 'plain-pied' END) AS storeys,
 CASE WHEN NOT apart THEN low END::INT AS ground, CASE WHEN NOT apart THEN up END::INT AS upstairs, CASE WHEN low IS NULL THEN 'unknown' WHEN apart THEN 'conflict' ELSE 'ok' END AS status,
 CASE n % 7 WHEN 0 THEN 'rez-de-chaussée, une chambre|à l''étage : trois chambres' WHEN 1 THEN 'comprend: 2 chambres et à l''étage|à l''étage une chambre' WHEN 3 THEN 'RDC avec cuisine' ELSE '' END AS said FROM c"""


# ---- items

_VIEW = {
    "city": "commune", "district": "CASE n % 6 WHEN 0 THEN 'Les Hauts' WHEN 1 THEN 'None' END", "city_normalized": "CASE WHEN n % 3 > 0 THEN concat(' ', commune, ' ') END", "zone_normalized": "CASE n % 4 WHEN 0 THEN 'Moufia' WHEN 1 THEN 'Zone 9' WHEN 2 THEN 'Zone non précisée' END",
    "zones_json": "CASE n % 5 WHEN 0 THEN '[\"Moufia\", \"Nord\"]' WHEN 1 THEN 'no list' END", "region": "CASE WHEN n % 2 = 0 THEN 'Nord' END", "property_type_normalized": "CASE WHEN n % 4 = 1 THEN 'Villa' END",
    "residential_status": "CASE WHEN n % 7 = 0 THEN 'checked' END", "residential_reasons_json": "'[\"seen\"]'", "quality_score": "n % 50", "is_canonical": "CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END",
    "canonical_source_site": "CASE WHEN n % 4 = 0 THEN source_site END", "canonical_source_id": "source_id", "duplicate_group_size": "n % 4", "duplicate_group_rank": "1",
    "description": "CASE WHEN n % 2 = 0 THEN concat(description, ' et une description assez longue pour rester') ELSE title END", "title": "CASE WHEN n % 9 = 0 THEN ' ' ELSE title END",
}


def viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _VIEW.items()}).drop("id", "score", "furnished")


def product_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of rows of the product view, all their fields."""
    p = products.product_items(viewed(spark, sf_dir))
    return p.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in p.dtypes])


PRODUCT_ITEMS = f"""{_N}, v AS (SELECT * REPLACE ({", ".join(f"{v} AS {k}" for k, v in _VIEW.items() if k in ("description", "title"))}), {", ".join(f"{v} AS {k}" for k, v in _VIEW.items() if k not in ("description", "title"))} FROM l),
 z AS (SELECT *, n % 3 > 0 AND n % 4 < 3 AS known FROM v),
 a AS (SELECT *, CASE WHEN known THEN zone_normalized ELSE commune END AS pz, coalesce(CASE WHEN district = 'Les Hauts' THEN district || ' · ' END, '') ||
   CASE WHEN known AND n % 4 IN (0, 1) THEN zone_normalized || ' · ' ELSE '' END || commune AS place, coalesce(nullif(bedrooms, 0), greatest(rooms - 1, 0)) AS beds, coalesce(region, 'Région non précisée') AS reg,
   CASE WHEN n % 4 = 1 THEN 'Villa' WHEN regexp_matches(lower(property_type || ' ' || title), 't[1-5]|maison|villa|house|flat|studio') THEN 'Appartement' ELSE 'Appartement / maison' END AS kind FROM z),
 i AS (SELECT *, n % 2 = 0 AND length(description) >= 45 AS own, CASE WHEN n % 4 = 0 AND known THEN 40 ELSE 0 END + CASE WHEN surface_m2 >= 60 THEN 16 ELSE 0 END + CASE WHEN rent_eur BETWEEN 600 AND 1000 THEN 18 ELSE 0 END
   + CASE WHEN beds >= 1 THEN 10 WHEN rooms >= 2 THEN 8 ELSE 0 END + 3 + CASE WHEN image_url <> '' THEN 10 ELSE 0 END AS pts FROM a)
SELECT source_site || ':' || source_id AS id, source_site, source_id, url, coalesce(nullif(trim(title), ''), 'Annonce sans titre') AS title, commune AS city, commune, reg AS region, pz AS primary_zone,
 CASE WHEN known AND n % 5 = 0 THEN 'Moufia,Nord' WHEN known AND n % 4 = 2 THEN '' ELSE pz END AS zones, kind AS property_type, rooms, beds AS bedrooms, surface_m2, rent_eur::BIGINT AS rent_eur, 'Non précisé' AS furnished,
 '' AS agency_or_owner, nullif(image_url, '') AS image_url, place AS location_label,
 CASE WHEN own THEN description ELSE CASE WHEN n % 9 > 0 THEN title || '. ' ELSE '' END || 'Repères extraits: ' || kind || ', ' || rooms || ' pièce(s)' || CASE WHEN beds > 0 THEN ', ' || beds || ' chambre(s)' ELSE '' END || ', ' || area || ' m², ' || rent_eur || ' €/mois. Secteur: ' || place || '. Source: ' || source_site END AS description,
 CASE WHEN own THEN 'Description source' ELSE 'Synthèse depuis titre + champs' END AS description_status, CASE WHEN n % 7 = 0 THEN 'seen' ELSE '' END AS residential_reasons, CASE WHEN n % 7 = 0 THEN 'checked' ELSE 'residential_candidate' END AS residential_status,
 quality_score AS db_quality_score, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS db_is_canonical, CASE WHEN n % 4 = 0 THEN source_site || ':' || source_id END AS db_canonical_id, duplicate_group_size AS db_duplicate_group_size, duplicate_group_rank AS db_duplicate_group_rank,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN n % 2 = 0 THEN 'Nord' END, CASE WHEN n % 4 = 0 AND known THEN 'zone prioritaire' END, CASE WHEN rent_eur BETWEEN 600 AND 1000 THEN 'budget cible' WHEN rent_eur <= 1200 THEN 'budget proche' END,
  CASE WHEN surface_m2 >= 60 THEN 'surface confortable' END], lambda x: x IS NOT NULL)[1:4], ' · '), ''), 'à vérifier manuellement') AS decision_summary, pts AS score,
 array_to_string(list_filter([CASE WHEN n % 4 = 0 AND known THEN 'Zone ciblée' END, CASE WHEN n % 4 = 0 AND known THEN 'Zone prioritaire' END, CASE WHEN rent_eur BETWEEN 600 AND 1000 THEN 'Budget 600–1000€' WHEN rent_eur <= 1200 THEN 'Budget proche' END,
  CASE WHEN surface_m2 >= 60 THEN '≥ 60 m²' WHEN surface_m2 >= 50 THEN 'Surface proche' END, CASE WHEN NOT (n % 4 = 0 AND known) AND rent_eur BETWEEN 600 AND 1000 AND surface_m2 >= 60 THEN 'Même budget/surface ailleurs' END], lambda x: x IS NOT NULL)[1:4], ',') AS variant_tags FROM i"""


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as they are exported: with places, analyses and galleries below them."""
    d = said(spark, sf_dir).drop("found")
    hints = F.transform(F.sequence(F.lit(1), F.col("rooms") * 2), lambda i: F.concat(F.lit("h"), i.cast("string")))
    point = F.when(F.col("n") % 3 == 0, F.struct(F.concat(F.lit("osm/"), "id").alias("osm_url"), F.lit(1.5).alias("lat")))
    places = F.struct(
        F.when(F.col("n") % 4 == 0, F.lit("Commune X")).alias("commune_inferred"), F.when(F.col("n") % 4 == 1, F.lit("")).when(F.col("n") % 4 == 2, "Quartier Y").alias("district_best"),
        F.lit(None).cast("string").alias("precise_location_label"), F.lit("Ouest").alias("region_inferred"), hints.alias("district_hints"), point.alias("map_point"), F.when(F.col("n") % 2 == 0, "haute").alias("quality"),
        F.lit(0.5).alias("confidence"), F.lit("").alias("method"), F.lit("debug").alias("trace"),
    )
    reasons = F.transform(F.sequence(F.lit(1), F.col("rooms") * 3), lambda i: F.concat(F.lit("r"), i.cast("string")))
    scored = F.struct(F.when(F.col("n") % 5 > 0, F.col("score")).alias("score"), F.lit("standard").alias("label"), F.lit("").alias("segment"), reasons.alias("reasons"), F.lit(9).alias("weights"))
    rows = F.array(F.struct(F.lit("a").alias("text"), F.lit(1).alias("line")), F.struct(F.lit("b").alias("text"), F.lit(2).alias("line")), F.struct(F.lit("c").alias("text"), F.lit(3).alias("line")))
    baths = F.struct(F.when(F.col("n") % 2 == 0, F.col("rooms")).alias("count"), F.lit("").alias("label"), F.when(F.col("n") % 2 == 0, rows).alias("evidence"), F.lit("x").alias("raw"))
    return d.withColumns(
        {
            "location_intelligence": places, "opportunity_analysis": scored, "housing_details": F.struct(baths.alias("bathrooms"), F.struct(F.lit(None).cast("string").alias("label")).alias("layout")),
            "local_image_url": F.when(F.col("n") % 4 == 0, F.concat(F.lit("/thumbs/"), "id", F.lit(".jpg"))), "image_urls": F.when(F.col("n") % 3 == 0, F.array("image_url", F.lit("http://img.example/more.jpg"))), "description": F.col("ad"),
            "location_label": F.lit("Label"), "primary_zone": F.when(F.col("n") % 8 == 0, "Zone Z"), "price": F.when(F.col("n") % 11 > 0, F.col("rent_eur").cast("double") + 0.5), "rent_eur": F.when(F.col("n") % 2 > 0, F.col("rent_eur")),
        }
    )


def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the clean items, those that come from below flattened."""
    c = products.clean_items(exported(spark, sf_dir))
    return c.select(
        "id", "source", "title", "city", "district", "region", "location", "map_url", F.col("map_point.lat").alias("lat"), "type", "price", "surface", "furnished", "agency", "local_image_url",
        F.array_join("local_image_urls", ",").alias("gallery"), F.array_join("image_urls", ",").alias("outside"), F.array_join("feature_tags", ",").alias("tags"), F.col("image_quality.status").alias("images"),
        F.col("image_quality.valid_local_count").alias("n_local"), F.col("image_quality.external_count").alias("n_outside"), F.col("geo_quality.level").alias("level"), F.col("geo_quality.confidence").alias("confidence"),
        F.col("geo_quality.method").alias("method"), "score", "opportunity_score", F.col("description_analysis.property_state.furnished.status").alias("said"),
    )


CLEAN_ITEMS = f"""{_N} SELECT id, source_site AS source, title, CASE WHEN n % 4 = 0 THEN 'Commune X' ELSE commune END AS city, CASE WHEN n % 4 = 2 THEN 'Quartier Y' WHEN n % 8 = 0 THEN 'Zone Z' ELSE 'Label' END AS district,
 'Ouest' AS region, 'Label' AS location, CASE WHEN n % 3 = 0 THEN 'osm/' || id END AS map_url, CASE WHEN n % 3 = 0 THEN 1.5 END::DOUBLE AS lat, property_type AS type, CASE WHEN n % 2 > 0 THEN rent_eur WHEN n % 11 > 0 THEN rent_eur END::BIGINT AS price,
 surface_m2 AS surface, furnished, '' AS agency, CASE WHEN n % 4 = 0 THEN 'thumbs/' || id || '.jpg' END AS local_image_url, CASE WHEN n % 4 = 0 THEN 'thumbs/' || id || '.jpg' ELSE '' END AS gallery,
 concat_ws(',', CASE WHEN n % 3 = 0 THEN nullif(image_url, '') END, CASE WHEN n % 3 = 0 THEN 'http://img.example/more.jpg' END, CASE WHEN n % 3 > 0 THEN nullif(image_url, '') END) AS outside,
 concat_ws(',', CASE n % 4 WHEN 0 THEN 'Non meublé' WHEN 1 THEN 'Meublé' WHEN 2 THEN 'Non meublé' END, CASE WHEN n % 6 <> 5 THEN 'Parking' END, CASE WHEN n % 5 < 3 THEN 'Varangue / terrasse' END,
  CASE WHEN n % 5 IN (0, 2, 3) THEN 'Jardin' END, CASE WHEN n % 5 = 1 THEN 'Piscine' END) AS tags,
 CASE WHEN n % 4 = 0 THEN 'local' WHEN n % 3 = 0 OR image_url <> '' THEN 'external_only' ELSE 'missing' END AS images, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS n_local,
 CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN image_url <> '' THEN 1 ELSE 0 END AS n_outside, CASE WHEN n % 2 = 0 THEN 'haute' ELSE 'commune' END AS level, 0.5::DOUBLE AS confidence, 'exported_location_intelligence' AS method, score,
 score AS opportunity_score, CASE n % 4 WHEN 0 THEN 'non_meuble' WHEN 1 THEN 'meuble' WHEN 2 THEN 'non_meuble' ELSE 'unknown' END AS said FROM l"""


def slim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published documents of exported rows: nested parts pruned, lists cut, nothing empty left."""
    d = exported(spark, sf_dir).select("id", "title", "price", "location_intelligence", "opportunity_analysis", "housing_details", "image_urls", "local_image_url", F.lit("kept back").alias("raw_json"))
    return products.published(d)


SLIM_DOCUMENTS = f"""{_N} SELECT id, '{{"id":"' || id || '","title":"' || title || '","location_intelligence":{{' || CASE n % 4 WHEN 2 THEN '"district_best":"Quartier Y",' WHEN 0 THEN '"commune_inferred":"Commune X",' ELSE '' END ||
 '"district_hints":[' || array_to_string(list_transform(range(1, least(5, rooms * 2) + 1), lambda i: '"h' || i || '"'), ',') || ']}},"price":' || rent_eur || '.5' || CASE WHEN n % 4 = 0 THEN ',"local_image_url":"/thumbs/' || id || '.jpg"' ELSE '' END ||
 ',"opportunity_analysis":{{' || CASE WHEN n % 5 > 0 THEN '"score":' || score || ',' ELSE '' END || '"label":"standard","reasons":[' || array_to_string(list_transform(range(1, least(6, rooms * 3) + 1), lambda i: '"r' || i || '"'), ',') || ']}}' ||
 CASE WHEN n % 2 = 0 THEN ',"housing_details":{{"bathrooms":{{"count":' || rooms || ',"evidence":[{{"text":"a","line":1}},{{"text":"b","line":2}}]}}}}' ELSE '' END || '}}' AS document FROM l WHERE n % 11 > 0"""


# ---- documents of any shape

_RAW = """CASE n % 6 WHEN 0 THEN 'no json' WHEN 1 THEN concat('["', id, '"]') WHEN 2 THEN '{}'
 WHEN 3 THEN concat('{"id":', id, ',"title":"', title, '","rent_eur":"', cast(rent_eur as {text}), '.5","zones":[],"primary_zone":"Moufia","surface_m2":', cast(area as {text}), ',"local_image_url":"/thumbs/', id, '.jpg","description":"Voir https://a.example/x et m@b.example"}')
 WHEN 4 THEN concat('{"id":"s:', id, '","source":"given","zones":["A","B"],"commune":"', commune, '","rent_eur":"abc","image_url":" http://i.example/1.jpg ","last_seen_at":"2024","rooms":null}') END"""


def journal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the journal shows of listings whose stored documents are of any shape, or broken."""
    raw = F.expr(_RAW.replace("{text}", "string"))
    d = _numbered(spark, sf_dir).withColumn("item", variant.journal_item(raw, F.concat(F.lit("site"), F.when(F.col("n") % 5 > 0, ":").otherwise(""), "id"), F.when(F.col("n") % 9 > 0, F.col("title")), F.col("url")))
    return d.select(F.col("id").alias("listing"), "item.*").withColumn("zones", F.array_join("zones", ","))


JOURNAL_ITEMS = f"""{_N}, k AS (SELECT *, n % 6 AS k, 'site' || CASE WHEN n % 5 > 0 THEN ':' ELSE '' END || id AS own FROM l)
SELECT id AS listing, CASE k WHEN 3 THEN id WHEN 4 THEN 's:' || id ELSE own END AS id, CASE WHEN k = 3 OR n % 9 > 0 THEN title ELSE 'Annonce' END AS title, url,
 CASE WHEN k = 4 THEN 'given' WHEN k <> 3 AND n % 5 > 0 THEN 'site' END AS source_site, NULL::VARCHAR AS region, CASE WHEN k = 4 THEN commune END AS commune, CASE WHEN k = 3 THEN 'Moufia' END AS primary_zone,
 CASE k WHEN 3 THEN 'Moufia' WHEN 4 THEN 'A,B' ELSE '' END AS zones, NULL::VARCHAR AS property_type, NULL::VARCHAR AS furnished, CASE WHEN k = 4 THEN commune END AS location_label,
 CASE WHEN k = 3 THEN round_even(rent_eur + 0.5, 0) END::BIGINT AS rent_eur, CASE WHEN k = 3 THEN area END::DOUBLE AS surface_m2, NULL::DOUBLE AS rooms, NULL::DOUBLE AS bedrooms,
 CASE k WHEN 3 THEN 'thumbs/' || id || '.jpg' WHEN 4 THEN 'http://i.example/1.jpg' END AS image_url, CASE WHEN k = 3 THEN 'Voir et' END AS description, NULL::VARCHAR AS decision_summary, CASE WHEN k = 4 THEN '2024' END AS seen_last_at FROM k"""

_REPORT = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('{"db_path":"/opt/data/x.db","steps":[[', cast(event_id as {text}), ',{"path":"p","note":"Bearer abc"}],[]],"ok":true}')
 WHEN 2 THEN concat('{"log":"see /srv/projects/run/', cast(user_id as {text}), ' now","n":', cast(event_id as {text}), '.5,"none":null}') ELSE concat('{"cut ', cast(event_id as {text})) END"""


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several shapes, some broken, without private keys, secrets and paths."""
    e = table(spark, sf_dir, "events").withColumn("report", F.expr(_REPORT.replace("{text}", "string")))
    return e.select("event_id", variant.redacted("report").alias("report"))


REDACTED_DOCUMENTS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN '{"steps":[[' || event_id || ',{"note":"[REDACTED]abc"}],[]],"ok":true}'
 WHEN 2 THEN '{"log":"see [path-redacted] now","n":' || event_id || '.5,"none":null}' END AS report FROM events"""

QUERIES = {f.__name__: f for f in (description_semantics, housing_details, secret_hints, product_items, clean_items, slim_documents, journal_items, redacted_documents)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

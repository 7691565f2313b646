"""Fields of listings: amounts, details of advertisements, places, images, contracts and guards.

The texts are written from a listing's own numbers, so that the SQL can state what has to be found in
them without reading the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import extract as X
from rentgrid.functions import geo, numbers
from rentgrid.functions import text as T
from rentgrid.operators import public, writes
from rentgrid.plans.stand_in import LISTING_SQL, listings
from rentgrid.sources import documents

_NUMBERED = f"WITH {LISTING_SQL}, l AS (SELECT *, id::INT AS n, surface_m2::INT AS area FROM listing)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumns({"n": F.expr("cast(id as int)"), "area": F.expr("cast(surface_m2 as int)")})


def read_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in prose and their whole numbers."""
    raw = F.expr("CASE n % 5 WHEN 0 THEN concat(rent_eur, ' €') WHEN 1 THEN concat(area, ',5 m²') WHEN 2 THEN concat('1 ', lpad(cast(n % 1000 as string), 3, '0')) WHEN 3 THEN 'prix sur demande' END")
    d = numbered(spark, sf_dir).withColumn("raw", raw)
    return d.select("id", numbers.number_or_none(F.col("raw")).alias("number"), numbers.parse_int(F.col("raw")).alias("whole"))


READ_AMOUNTS = f"""{_NUMBERED} SELECT id, CASE n % 5 WHEN 0 THEN rent_eur WHEN 1 THEN area + 0.5 WHEN 2 THEN 1000 + n % 1000 END::DOUBLE AS number,
 CASE n % 5 WHEN 0 THEN rent_eur WHEN 1 THEN area + area % 2 WHEN 2 THEN 1000 + n % 1000 END::BIGINT AS whole FROM l"""


def advertised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with an advertisement that states their rent, charges, size, storey and address."""
    ad = """concat('Loyer : ', rent_eur, ' €, charges comprises : ', 20 + n % 50, ' €. ', rooms, ' pièces de ', area, ' m². ',
     CASE n % 3 WHEN 0 THEN 'Logement meublé' WHEN 1 THEN 'Location vide' ELSE 'Bel appartement' END, '. ',
     CASE n % 4 WHEN 0 THEN 'Au rez-de-chaussée' WHEN 1 THEN concat('Au ', 2 + n % 7, 'ème étage avec ascenseur') WHEN 2 THEN 'Etage : 3 sans ascenseur' ELSE 'Au calme' END, '. ',
     CASE n % 2 WHEN 0 THEN concat(1 + n % 90, ' rue Pasteur') ELSE 'Quartier agréable' END, '.')"""
    return numbered(spark, sf_dir).withColumn("ad", F.expr(ad))


def ad_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = advertised(spark, sf_dir)
    ad = F.col("ad")
    return d.select("id", X.rent(ad).alias("rent"), X.surface(ad).alias("surface"), X.rooms(ad).alias("rooms"), X.furnished_status(ad).alias("furnished"), F.array_join(X.feature_tags(ad), ",").alias("tags"))


AD_AMOUNTS = f"""{_NUMBERED} SELECT id, rent_eur::BIGINT AS rent, area::DOUBLE AS surface, rooms, CASE n % 3 WHEN 0 THEN 'Meublé' WHEN 1 THEN 'Non meublé' ELSE 'Non précisé' END AS furnished,
 concat_ws(',', CASE WHEN n % 3 = 0 THEN 'Meublé' END, CASE WHEN n % 4 IN (1, 2) THEN 'Ascenseur' END) AS tags FROM l"""


def ad_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = advertised(spark, sf_dir).withColumn("d", X.details(F.col("ad")))
    return d.select("id", "d.address", "d.street", "d.floor", "d.has_elevator", "d.charges_eur", "d.furnished", "d.bedrooms")


AD_DETAILS = f"""{_NUMBERED} SELECT id, CASE WHEN n % 2 = 0 THEN (1 + n % 90) || ' rue Pasteur' END AS address, CASE WHEN n % 2 = 0 THEN 'rue Pasteur' END AS street,
 CASE n % 4 WHEN 0 THEN 'RDC' WHEN 1 THEN (2 + n % 7) || 'e etage' WHEN 2 THEN '3e etage' END AS floor, CASE n % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS has_elevator,
 20 + n % 50 AS charges_eur, CASE WHEN n % 3 = 0 THEN 1 END AS furnished, NULL::INT AS bedrooms FROM l"""


def ad_comfort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bathrooms, toilets, storeys and amenities, and the bedrooms of each storey."""
    prose = """concat(CASE n % 3 WHEN 0 THEN '2 salles de bains' WHEN 1 THEN 'Une salle d''eau' ELSE 'Belle cuisine' END, '. ',
     CASE n % 5 WHEN 0 THEN 'WC séparé' WHEN 1 THEN 'Deux toilettes' ELSE 'Calme' END, '. ', CASE n % 4 WHEN 0 THEN 'Duplex avec terrasse' WHEN 1 THEN 'Sur trois niveaux, piscine' ELSE 'Plain-pied, garage' END, '. ',
     CASE n % 7 WHEN 0 THEN 'Au rdc une chambre' ELSE 'Entrée' END, '. ', CASE n % 2 WHEN 0 THEN 'Et à l''étage deux chambres' ELSE 'Fin' END, '.')"""
    d = numbered(spark, sf_dir).withColumn("prose", F.expr(prose))
    d = d.withColumns({"c": X.comfort(F.col("prose")), "split": X.bedroom_split(F.col("prose"), F.col("rooms"))})
    return d.select("id", "c.nb_sdb", "c.wc_separe", "c.nb_wc", "c.terrasse", "c.piscine", "c.parking", "c.jardin", "c.niveaux", "split.ground", "split.upstairs")


AD_COMFORT = f"""{_NUMBERED}, s AS (SELECT *, CASE WHEN n % 7 = 0 THEN 1 END AS low, CASE WHEN n % 2 = 0 THEN 2 END AS up FROM l)
SELECT id, CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS nb_sdb, CASE WHEN n % 5 = 0 THEN 1 END AS wc_separe, CASE WHEN n % 5 = 1 THEN 2 END AS nb_wc,
 CASE WHEN n % 4 = 0 THEN 1 END AS terrasse, CASE WHEN n % 4 = 1 THEN 1 END AS piscine, CASE WHEN n % 4 > 1 THEN 1 END AS parking, NULL::INT AS jardin, CASE n % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS niveaux,
 CASE WHEN coalesce(low, 0) + coalesce(up, 0) <= rooms THEN low END AS ground, CASE WHEN coalesce(low, 0) + coalesce(up, 0) <= rooms THEN up END AS upstairs FROM s"""


def place_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How precisely a place is known, its rank and label, and whether its coordinates lie in the box."""
    given = lambda least, value: F.when(F.col("n") % 5 <= least, F.lit(value))
    lat, lon = F.when(F.col("n") % 5 <= 3, -21.5 + F.col("n") % 10 * 0.1), F.when(F.col("n") % 5 <= 3, F.lit(55.5))
    found = X.precision(given(0, "1 rue X"), given(1, "rue X"), F.when(F.col("n") % 5 == 1, "").otherwise(given(2, "Les Palmes")), lat, lon)
    d = numbered(spark, sf_dir).withColumns({"precision": found, "plausible": geo.plausible(lat, lon)})
    return d.select("id", "precision", X.precision_rank(F.col("precision")).alias("rank"), X.precision_label(F.col("precision")).alias("label"), "plausible")


PLACE_PRECISION = f"""{_NUMBERED} SELECT id, ['adresse_exacte', 'rue', 'residence', 'point_carte', 'inconnu'][n % 5 + 1] AS precision, [5, 4, 3, 3, 0][n % 5 + 1] AS rank,
 ['Adresse exacte', 'Rue', 'Résidence', 'Point cartographique', 'Localisation inconnue'][n % 5 + 1] AS label, n % 5 <= 3 AND n % 10 BETWEEN 1 AND 6 AS plausible FROM l"""


def place_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communes and districts that texts name, by alias, postal code or within a known commune."""
    said = F.expr("CASE n % 4 WHEN 0 THEN 'Bel appartement, secteur de Cambaie' WHEN 1 THEN 'T2 au centre, 97460' WHEN 2 THEN 'Maison à Saint-Denis' ELSE 'Studio avec vue' END")
    declared = F.when(F.col("n") % 3 == 0, "Saint-Paul").when(F.col("n") % 3 == 1, "Saint-Denis")
    d = numbered(spark, sf_dir).select("id", said.alias("said"), declared.alias("declared"))
    return d.select("id", geo.district_in(F.col("declared"), F.col("said")).alias("district"), geo.strict_commune(F.col("said")).alias("commune"), geo.scope_class(F.col("declared"), F.col("said")).alias("scope"))


PLACE_SCOPE = f"""{_NUMBERED} SELECT id, CASE WHEN n % 4 = 0 AND n % 3 = 0 THEN 'Cambaie' END AS district, CASE WHEN n % 4 = 2 THEN 'Saint-Denis' END AS commune,
 CASE n % 3 WHEN 0 THEN 'OUT' WHEN 1 THEN 'IN' ELSE 'AMBIGUOUS' END AS scope FROM l"""


def photo_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that can be photographs, their fingerprints, and the photos of a row once each."""
    raw = F.expr("CASE n % 6 WHEN 0 THEN concat('http://i.example/', id, '.jpg') WHEN 1 THEN 'http://i.example/Logo.png' WHEN 2 THEN 'data:image/png;base64,AA' WHEN 3 THEN concat('http://i.example/', id, '.svg?x=1') WHEN 4 THEN concat('\"http://i.example/', id, '.webp\" ') ELSE ' ' END")
    d = numbered(spark, sf_dir).withColumn("photo", X.photo_url(raw))
    d = d.withColumns({"image_urls": F.array(F.col("image_url"), F.lit("b"), F.lit(" b ")), "local_image_url": F.concat(F.lit("l"), F.col("id"))})
    hashes = F.array(F.upper(F.left(F.sha2("id", 256), F.lit(16))), F.lit("xyz"), F.lit(None).cast("string"))
    srcset = X.first_srcset(F.concat(F.lit(" , http://i.example/"), F.col("id"), F.lit(" 480w, http://i.example/x 900w")))
    return d.select("id", "photo", documents.url_fingerprint(F.col("photo")).alias("print"), F.array_join(documents.photo_list(d), ",").alias("photos"), F.array_join(documents.fingerprints(hashes), ",").alias("hashes"), srcset.alias("srcset"))


PHOTO_ADDRESSES = f"""{_NUMBERED}, p AS (SELECT *, CASE n % 6 WHEN 0 THEN 'http://i.example/' || id || '.jpg' WHEN 4 THEN 'http://i.example/' || id || '.webp' END AS photo FROM l)
SELECT id, photo, left(sha256(photo), 16) AS print, concat_ws(',', nullif(image_url, ''), 'b', 'l' || id) AS photos, left(sha256(id), 16) AS hashes, 'http://i.example/' || id AS srcset FROM p"""


def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(spark, sf_dir)
    cities = F.when(F.col("n") % 3 == 0, F.array()).otherwise(F.array("source_site", F.lit("La Saline")))
    url = X.search_url("http://x.example/find/", {"city": cities}, {"max": F.when(F.col("n") % 2 == 0, F.col("rent_eur"))}, F.when(F.col("n") % 5 != 0, F.lit("vue mer")).otherwise(""))
    return d.select("id", url.alias("url"), T.money(F.col("rent_eur") * 10).alias("money"), T.surface_label(F.col("surface_m2")).alias("surface"))


SEARCH_ADDRESSES = f"""{_NUMBERED} SELECT id, 'http://x.example/find/?immo=1' || CASE WHEN n % 3 > 0 THEN '&city=' || source_site || '%7CLa+Saline' ELSE '' END || CASE WHEN n % 2 = 0 THEN '&max=' || rent_eur ELSE '' END || CASE WHEN n % 5 > 0 THEN '&q=vue+mer' ELSE '' END AS url,
 (rent_eur * 10 // 1000) || ' ' || lpad((rent_eur * 10 % 1000)::VARCHAR, 3, '0') || ' €' AS money, area || ' m²' AS surface FROM l"""


def own_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids within the source, and digests of rows."""
    d = numbered(spark, sf_dir)
    rows = d.select(F.concat("source_site", F.lit(":"), "id").alias("id"), "source_site", F.when(F.col("n") % 3 == 0, F.concat(F.lit("s"), "id")).when(F.col("n") % 3 == 1, " ").alias("source_id"), "rooms", "bedrooms")
    return rows.select("id", writes.native_id(rows, F.col("source_site")).alias("own"), writes.content_hash(rows, ["rooms", "bedrooms", "id"]).alias("digest"))


OWN_IDS = f"""{_NUMBERED} SELECT source_site || ':' || id AS id, CASE WHEN n % 3 = 0 THEN 's' ELSE '' END || id AS own,
 sha256('{{"bedrooms":' || coalesce(bedrooms::VARCHAR, 'null') || ',"id":"' || source_site || ':' || id || '","rooms":' || rooms || '}}') AS digest FROM l"""


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical rows in the public contract; a price in prose is read, one that is none is null."""
    d = numbered(spark, sf_dir).withColumn("rent_eur", F.expr("CASE WHEN n % 4 = 0 THEN concat(rent_eur, ' €') WHEN n % 4 = 1 THEN 'NC' ELSE cast(rent_eur as string) END"))
    c = documents.public_contract(documents.active(d))
    return c.select("id", "source", "price", "surface", "type", "city", "rooms", "bedrooms", "furnished", F.array_join("image_urls", ",").alias("images"), "display_canonical")


CONTRACT_ROWS = f"""{_NUMBERED} SELECT id, source_site AS source, CASE WHEN n % 4 <> 1 THEN rent_eur END::DOUBLE AS price, surface_m2 AS surface, property_type AS type, commune AS city, rooms::DOUBLE AS rooms,
 bedrooms::DOUBLE AS bedrooms, furnished, image_url AS images, true AS display_canonical FROM l WHERE is_active = 1"""


def light_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents without empty fields, of the active listings that have an image."""
    return documents.light_index(documents.with_image(documents.active(listings(spark, sf_dir))), ["id", "rent_eur", "bedrooms", "no_such_field"])


LIGHT_ROWS = f"""{_NUMBERED} SELECT id, '{{"id":"' || id || '","rent_eur":' || rent_eur || coalesce(',"bedrooms":' || bedrooms, '') || '}}' AS json FROM l WHERE is_active = 1 AND image_url <> ''"""


def purged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge leaves, and of it the rows whose parent is active."""
    d = numbered(spark, sf_dir).withColumn("last_seen", F.expr("timestamp'2024-03-01' - make_interval(0, 0, 0, n % 60)"))
    left = writes.purge(d, F.when(F.col("n") % 13 == 0, True), F.col("last_seen"), F.lit("2024-03-01").cast("timestamp"))
    child = left.select("id", "source_site", F.col("is_active").alias("was_active"))
    return writes.keep_with_parent(child.withColumn("id", F.expr("cast(cast(id as int) + 1 as string)")), d.select("id", "is_active"), ["id"])


PURGED_ROWS = f"""{_NUMBERED}, kept AS (SELECT * FROM l WHERE n % 13 <> 0 AND NOT (is_active = 0 AND n % 60 > 30)) SELECT (kept.n + 1)::VARCHAR AS id, kept.source_site, kept.is_active AS was_active FROM kept JOIN l p ON p.n = kept.n + 1 WHERE p.is_active = 1"""


def promotion_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate may replace the target, and whether an artifact may be imported, by source."""
    d = numbered(spark, sf_dir)
    once = writes.may_promote(d).select(F.lit("promote").alias("guard"), F.col("active").cast("long").alias("n"), "ok")
    rows = documents.importable(d.where("n % 10 = 0").withColumn("rent_eur", F.when(F.col("n") % 20 == 0, F.col("rent_eur").cast("string")).otherwise("NC")), rows=15, prices=5)
    return once.unionByName(rows.select(F.lit("import").alias("guard"), F.col("prices").alias("n"), "ok"))


PROMOTION_GUARDS = f"""{_NUMBERED} SELECT 'promote' AS guard, count(*) FILTER (is_active = 1) AS n, count(*) FILTER (is_active = 1) >= 400 AS ok FROM l
 UNION ALL SELECT 'import', count(*) FILTER (n % 20 = 0), count(*) >= 15 AND count(*) FILTER (n % 20 = 0) >= 5 FROM l WHERE n % 10 = 0"""


def shown_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions shown or replaced by facts, crawler prose, cut footers, and updates worth while."""
    d = numbered(spark, sf_dir)
    own = F.expr("CASE n % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Annonce SeLoger collectée par CDP.' WHEN 2 THEN concat(title, '. Annonce publiée le 3. Proposée par X') ELSE title END")
    d = d.withColumns({"own": own, "long": F.concat(F.repeat(F.lit("a"), F.col("n") % 300), F.lit(" Footer : x"))})
    facts = X.description_or_facts(F.col("own"), F.col("property_type"), F.col("rooms"), F.col("area"), F.nullif(F.lit(""), F.lit("")), F.col("rent_eur"))
    update = writes.description_update(F.lit("b" * 60), F.repeat(F.lit("c"), F.col("n") % 100), F.col("title"))
    return d.select("id", facts.alias("shown"), X.is_boilerplate(F.col("own")).alias("crawled"), F.length(X.cut_footer(F.col("long"), ["Footer"])).alias("n_cut"), update.alias("better"))


SHOWN_DESCRIPTIONS = f"""{_NUMBERED} SELECT id, CASE n % 4 WHEN 2 THEN title || '. Annonce publiée le 3. Proposée par X' WHEN 3 THEN title ELSE property_type || ' · ' || rooms || ' pièce(s) · ' || area || ' m² · ' || rent_eur || ' €/mois' END AS shown,
 n % 4 = 2 AS crawled, CASE WHEN n % 300 > 119 THEN n % 300 ELSE n % 300 + 11 END::INT AS n_cut, n % 100 > 60 AS better FROM l"""


def published_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE n % 5 WHEN 0 THEN concat('Publiée il y a ', n % 40, ' h') WHEN 1 THEN concat('il y a ', n % 9, ' j') WHEN 2 THEN concat('Il y a ', n % 3, ' sem.') WHEN 3 THEN concat('le ', 1 + n % 28, '/02/2024') ELSE 'sans date' END")
    age = X.published_age_hours(said, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    d = numbered(spark, sf_dir).withColumn("hours", age)
    return d.select("id", "hours", X.recently_published(F.col("hours")).alias("recent"), numbers.age_phrase(F.floor(F.col("hours") / 24)).alias("phrase"))


PUBLISHED_AGES = f"""{_NUMBERED}, a AS (SELECT *, CASE n % 5 WHEN 0 THEN n % 40 WHEN 1 THEN n % 9 * 24 WHEN 2 THEN n % 3 * 168 WHEN 3 THEN (29 - n % 28) * 24 END::DOUBLE AS hours FROM l)
SELECT id, hours, coalesce(hours <= 72, false) AS recent, CASE WHEN hours < 24 THEN 'aujourd''hui' WHEN hours < 48 THEN 'hier' WHEN hours < 168 THEN 'il y a ' || hours::INT // 24 || ' j' WHEN hours IS NOT NULL THEN 'il y a ' || hours::INT // 168 || ' sem.' END AS phrase FROM a"""

def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates for every listing: one that may be it, and one that is not."""
    d = numbered(spark, sf_dir).selectExpr("id as key", "id as wanted", "n", "title", "rent_eur as price", "surface_m2 as surface")
    other = d.selectExpr("key", "concat('x', key) as id", "if(n % 4 = 3, '####', upper(title)) as title", "price + if(n % 4 = 2, 50, 3) as price", "surface + 1 as surface")
    own = d.selectExpr("key", "if(n % 4 = 0, key, concat('y', key)) as id", "'####' as title", "price - 400 as price", "surface + 40 as surface")
    return public.best_candidates(d, other.unionByName(own), "key", "wanted").select("key", "candidate", "exact", F.floor("score").alias("points"))


BEST_MATCHES = f"""{_NUMBERED} SELECT id AS key, CASE WHEN n % 4 = 1 THEN 'x' ELSE '' END || id AS candidate, n % 4 = 0 AS exact, CASE WHEN n % 4 = 0 THEN 3 ELSE 2 END::BIGINT AS points FROM l WHERE n % 4 < 2"""


def stored_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(spark, sf_dir).withColumns({"local_image_url": F.expr("CASE n % 3 WHEN 0 THEN 'gone' WHEN 1 THEN concat('m', id) END"), "local_image_urls": F.when(F.col("n") % 4 > 0, F.array(F.lit("gone"), F.concat(F.lit("g"), F.col("id")), F.concat(F.lit("h"), F.col("id"))))})
    files = d.select(F.explode(F.array(F.concat(F.lit("m"), F.col("id")), F.concat(F.lit("h"), F.col("id")), F.when(F.col("n") % 2 == 0, F.concat(F.lit("g"), F.col("id"))))).alias("path"))
    kept = public.local_media(d, files)
    return kept.select("id", "local_image_url", F.array_join("local_image_urls", ",").alias("gallery"))


STORED_MEDIA = f"""{_NUMBERED}, g AS (SELECT id, CASE WHEN n % 3 = 1 THEN 'm' || id END AS main, CASE WHEN n % 4 = 0 THEN '' WHEN n % 2 = 0 THEN 'g' || id || ',h' || id ELSE 'h' || id END AS rest FROM l)
SELECT id, coalesce(main, split_part(rest, ',', 1)) AS local_image_url, concat_ws(',', main, nullif(rest, '')) AS gallery FROM g"""

QUERIES = {
    f.__name__: f
    for f in (
        read_amounts, ad_amounts, ad_details, ad_comfort, place_precision, place_scope, photo_addresses, search_addresses, own_ids, contract_rows, light_rows, purged_rows,
        promotion_guards, shown_descriptions, published_ages, best_matches, stored_media,
    )
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

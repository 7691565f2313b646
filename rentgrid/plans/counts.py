"""Coverage, facets, summaries and reports over the stand-in listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import geo, numbers, query
from rentgrid.operators import coverage, market, matching, windows
from rentgrid.plans.stand_in import LISTING_SQL, listings, table

FIELDS = ["rent_eur", "bedrooms", "image_url", "title", "furnished"]


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.field_coverage(listings(spark, sf_dir), FIELDS)


_COVER = " UNION ALL ".join(f"SELECT '{f}' AS field, count({f if f in ('rent_eur', 'bedrooms') else f'nullif({f}, {chr(39) * 2})'}) AS filled, count(*) AS total FROM listing" for f in FIELDS)
FIELD_COVERAGE = f"WITH {LISTING_SQL}, c AS ({_COVER}) SELECT field, filled, total, round_even(filled * 100.0::DOUBLE / total, 1) AS percent FROM c"


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.numeric_summary(listings(spark, sf_dir), ["rent_eur", "surface_m2", "bedrooms"])


NUMERIC_SUMMARY = f"WITH {LISTING_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, median({c})::DOUBLE AS median FROM listing" for c in ("rent_eur", "surface_m2", "bedrooms")
)


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.frequencies(listings(spark, sf_dir), F.col("commune"), 10)


TOP_VALUES = f"WITH {LISTING_SQL} SELECT commune AS value, count(*) AS n FROM listing GROUP BY 1 ORDER BY n DESC, value LIMIT 10"


def zone_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("zones", F.split("title", " "))
    return coverage.exploded_facet(rows, "zones")


ZONE_FACET = f"WITH {LISTING_SQL} SELECT z AS value, count(*) AS n FROM (SELECT id, unnest(list_distinct(string_split(title, ' '))) AS z FROM listing) WHERE z <> '' GROUP BY 1"


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    where = {"commune": F.col("commune").isin("Brand#1", "Brand#2", "Brand#3"), "rooms": F.col("rooms") >= 2, "rent": F.col("rent_eur") <= 1200, "furnished": F.col("furnished") == "Meublé"}
    return coverage.facet_counts(rows, where, {"commune": F.col("commune"), "rooms": F.col("rooms"), "furnished": F.col("furnished")})


_P = {"commune": "commune IN ('Brand#1','Brand#2','Brand#3')", "rooms": "rooms >= 2", "rent": "rent_eur <= 1200", "furnished": "furnished = 'Meublé'"}
FACET_COUNTS = f"WITH {LISTING_SQL} " + " UNION ALL ".join(
    f"SELECT '{f}' AS facet, {f}::VARCHAR AS value, count(*) AS n FROM listing WHERE {' AND '.join(p for k, p in _P.items() if k != f)} GROUP BY 2" for f in ("commune", "rooms", "furnished")
)


def zero_result_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return coverage.isolated_counts(rows, query.predicates(rows, query.parse("T3 meublé moins de 800 jardin"), {}))


ZERO_RESULT_EXPLAINED = f"""WITH {LISTING_SQL} SELECT 'rooms' AS criterion, count(*) FILTER (rooms = 3) AS n FROM listing
UNION ALL SELECT 'amenity:Jardin', count(*) FILTER (description LIKE '%jardin%') FROM listing UNION ALL SELECT 'furnished', count(*) FILTER (furnished = 'Meublé') FROM listing
UNION ALL SELECT 'max_price', count(*) FILTER (rent_eur <= 800) FROM listing"""


def natural_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 non meublé jardin, at least 700, roughly as a user types it."""
    rows = listings(spark, sf_dir)
    return query.search(rows, query.parse("F3 non meublé jardin plus de 700 red"), {}).select("id", "rent_eur", "relevance")


NATURAL_SEARCH = f"""WITH {LISTING_SQL} SELECT id, rent_eur, CASE WHEN list_contains(string_split(lower(title || ' ' || description), ' '), 'red') THEN 18 ELSE 13 END AS relevance FROM listing
WHERE rooms = 3 AND furnished <> 'Meublé' AND description LIKE '%jardin%' AND rent_eur >= 700
 AND (lower(title || ' ' || commune || ' ' || property_type || ' ' || description || ' ' || source_site || ' ' || furnished)) LIKE '%red%'"""


def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.page(listings(spark, sf_dir), matching.sort_keys("priceAsc"), 2).select("id", "rent_eur", "score")


SORTED_PAGE = f"WITH {LISTING_SQL} SELECT id, rent_eur, score FROM listing ORDER BY rent_eur, score DESC, id LIMIT 36 OFFSET 72"


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    c = market.completeness(rows, F.col("commune"), F.lit("Nord"))
    return rows.select("id", c["score"].alias("score"), F.array_join(c["missing"], ",").alias("missing"))


COMPLETENESS = f"""WITH {LISTING_SQL} SELECT id, least(100, 18 + 18 + 10 + CASE WHEN bedrooms IS NULL THEN 0 ELSE 8 END + 10 + CASE WHEN image_url = '' THEN 0 ELSE 12 END + 8 + 16 + 6) AS score,
 concat_ws(',', CASE WHEN bedrooms IS NULL THEN 'chambres' END, CASE WHEN image_url = '' THEN 'photo' END, 'date publication') AS missing FROM listing"""


def quality_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = {"unlabelled": F.col("quality").isNull(), "low": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short": F.length("text") < 80, "source": F.col("source") == "src0"}
    out = coverage.anomalies(d, "doc_id", reasons)
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "severity")


QUALITY_ANOMALIES = """
WITH r AS (SELECT doc_id, [CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN length(text) < 80 THEN 'short' END,
  CASE WHEN source = 'src0' THEN 'source' END] AS a FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT doc_id, list_filter(a, lambda x: x IS NOT NULL) AS a FROM r)
SELECT doc_id, array_to_string(a, ',') AS reasons, len(a)::INTEGER AS severity FROM s WHERE len(a) > 0 ORDER BY severity DESC, doc_id LIMIT 20"""


def truth_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = coverage.truth_status(F.col("quality") == 0, F.col("quality").isNull(), F.length("text") == 0)
    return d.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


TRUTH_STATUS = """SELECT CASE WHEN length(text) = 0 THEN 'error' WHEN quality = 0 THEN 'hide' WHEN quality IS NULL THEN 'uncertain' ELSE 'ok' END AS status, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""


def repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.repeated_values(listings(spark, sf_dir), ["source_site", "title"], 2)


REPEATED_VALUES = f"WITH {LISTING_SQL} SELECT source_site, title, count(*) AS n FROM listing GROUP BY 1, 2 HAVING count(*) > 2"


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt out type by type: the turn within a type, and the place in the order of turns."""
    return windows.round_robin(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).select("event_id", "turn", "place")


ROUND_ROBIN = """WITH t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events)
SELECT event_id, turn, row_number() OVER (ORDER BY turn, event_type) AS place FROM t"""


def price_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return rows.select("id", numbers.half_even(windows.percentile_rank(F.col("rent_eur"), "commune"), 9).alias("rank"))


PRICE_RANK = f"WITH {LISTING_SQL} SELECT id, round_even(cume_dist() OVER (PARTITION BY commune ORDER BY rent_eur), 9) AS rank FROM listing"


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = lambda k, m: ((F.col(k) * m) % 1000) / 1000.0
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), spot("c_custkey", 379).alias("lat"), spot("c_custkey", 613).alias("lon"))
    shops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), spot("s_suppkey", 271).alias("lat"), spot("s_suppkey", 449).alias("lon"))
    return windows.nearest_place(people, shops, "lat", "lon", 0.045, "id").select("id", "place")


NEAREST_PLACE = """
WITH c AS (SELECT c_custkey AS id, ((c_custkey * 379) % 1000) / 1000.0::DOUBLE AS lat, ((c_custkey * 613) % 1000) / 1000.0::DOUBLE AS lon FROM customer),
 s AS (SELECT s_suppkey AS place, ((s_suppkey * 271) % 1000) / 1000.0::DOUBLE AS lat, ((s_suppkey * 449) % 1000) / 1000.0::DOUBLE AS lon FROM supplier),
 d AS (SELECT id, place, sqrt(power(s.lat - c.lat, 2) + power(s.lon - c.lon, 2)) AS d FROM c, s), b AS (SELECT id, place FROM d WHERE d < 0.045 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, place) = 1)
SELECT c.id, b.place FROM c LEFT JOIN b ON c.id = b.id"""


def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("name"))
    tries = F.array(F.concat(F.lit("Brand#"), (F.col("score") + 20).cast("string")), F.concat(F.lit("Brand#"), (F.col("rooms") + 22).cast("string")), F.lit("Brand#1"))
    return windows.first_known(rows.select("id", "score", "rooms"), tries, known, "key", "id").select("id", "name")


ORDERED_LOOKUP = f"""WITH {LISTING_SQL}, t AS (SELECT id, 1 AS p, score + 20 AS k FROM listing UNION ALL SELECT id, 2, rooms + 22 FROM listing UNION ALL SELECT id, 3, 1 FROM listing)
SELECT l.id, x.n_name AS name FROM listing l LEFT JOIN (SELECT id, arg_min(n_name, p) AS n_name FROM t JOIN nation ON n_nationkey = k GROUP BY id) x ON x.id = l.id"""


def feed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumns({"rent": F.when(F.col("score") % 4 != 0, F.col("rent_eur")), "active": F.col("is_active") == 1, "surface": F.col("surface_m2"), "type": F.col("property_type")})
    f = {"actives": True, "rentMax": 1000, "surfaceMin": 40, "chambresMin": 1, "types": ["small", "economy"], "q": "red proche"}
    return rows.where(query.feed_predicate(rows, f)).select("id")


FEED_FILTER = f"""WITH {LISTING_SQL} SELECT id FROM listing WHERE is_active = 1 AND coalesce(CASE WHEN score % 4 <> 0 THEN rent_eur END, 1000000000) <= 1000 AND surface_m2 >= 40
 AND coalesce(bedrooms, rooms - 1) >= 1 AND (lower(property_type) LIKE '%small%' OR lower(property_type) LIKE '%economy%')
 AND lower(title || ' ' || commune || ' ' || description) LIKE '%red%' AND lower(title || ' ' || commune || ' ' || description) LIKE '%proche%'"""


def city_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities by code, alias and name, from addresses made of the customers' keys."""
    from rentgrid.functions import gazetteer as G

    codes, names = list(G.POSTAL), list(G.CITY_NAMES)
    c = table(spark, sf_dir, "customer")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % k + 1).cast("int"))
    city = F.when(F.col("c_custkey") % 2 == 0, pick(codes, len(codes))).otherwise(pick(names, len(names)))
    none = F.lit(None).cast("string")
    found = geo.detect_commune(city, none, none, none, none)
    return c.select("c_custkey", found.alias("commune"), geo.region_for(found).alias("region"))


QUERIES = {
    f.__name__: f
    for f in (
        field_coverage, numeric_summary, top_values, zone_facet, facet_counts, zero_result_explained, natural_search, sorted_page, completeness, quality_anomalies, truth_status,
        repeated_values, round_robin, price_rank, nearest_place, ordered_lookup, feed_filter, city_regions,
    )
}


#: What each postal code (0) and each name (1), by its place in its list, is a commune and region of.
CITY_REGIONS = """SELECT c_custkey, commune, region FROM customer JOIN (VALUES
  (0, 0, 'Saint-Denis', 'Nord'), (0, 1, 'Saint-Denis', 'Nord'), (0, 2, 'Sainte-Marie', 'Nord'), (0, 3, 'Sainte-Suzanne', 'Nord'), (0, 4, 'Saint-André', 'Est'),
  (0, 5, 'Saint-Benoît', 'Est'), (0, 6, 'Bras-Panon', 'Est'), (0, 7, 'La Plaine des Palmistes', 'Est'), (0, 8, 'Saint-Pierre', 'Sud'), (0, 9, 'Le Tampon', 'Sud'),
  (0, 10, 'Le Tampon', 'Sud'), (0, 11, 'Saint-Louis', 'Sud'), (0, 12, 'Saint-Joseph', 'Sud'), (0, 13, 'Entre-Deux', 'Sud'), (0, 14, 'Les Avirons', 'Sud'),
  (0, 15, 'Etang-Salé', 'Sud'), (0, 16, 'Saint-Paul', 'Ouest'), (0, 17, 'Saint-Paul', 'Ouest'), (0, 18, 'Saint-Paul', 'Ouest'), (0, 19, 'La Saline', 'Ouest'),
  (0, 20, 'Saint-Leu', 'Ouest'), (0, 21, 'La Possession', 'Ouest'), (0, 22, 'Le Port', 'Ouest'), (1, 0, 'Saint-Denis', 'Nord'), (1, 1, 'Sainte-Marie', 'Nord'),
  (1, 2, 'Saint-Denis', 'Nord'), (1, 3, 'Le Tampon', 'Sud'), (1, 4, 'Saint-Pierre', 'Sud'), (1, 5, 'Saint-Paul', 'Ouest'), (1, 6, 'La Possession', 'Ouest'),
  (1, 7, 'Saint-Leu', 'Ouest'), (1, 8, 'Saint-André', 'Est'), (1, 9, 'Saint-Louis', 'Sud'), (1, 10, 'Le Port', 'Ouest'), (1, 11, 'Sainte-Suzanne', 'Nord'),
  (1, 12, 'Saint-Benoît', 'Est'), (1, 13, 'Saint-Joseph', 'Sud'), (1, 14, 'Bras-Panon', 'Est'), (1, 15, 'Entre-Deux', 'Sud'), (1, 16, 'Les Avirons', 'Sud'),
  (1, 17, 'Etang-Salé', 'Sud'), (1, 18, 'La Plaine des Palmistes', 'Est'), (1, 19, 'Saint-Paul', 'Ouest'), (1, 20, 'La Saline', 'Ouest'), (1, 21, 'Petite Ile', 'Sud'),
  (1, 22, 'Cilaos', 'Sud'), (1, 23, 'Salazie', 'Est'), (1, 24, 'Trois-Bassins', 'Ouest'), (1, 25, 'Saint-Philippe', 'Sud')) v(k, i, commune, region)
 ON k = c_custkey % 2 AND i = c_custkey % CASE WHEN c_custkey % 2 = 0 THEN 23 ELSE 26 END"""
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

"""Operators around the product that need a little staging: views, notices, gates, orders, places and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import geo
from rentgrid.operators import coverage, entity, market, matching, public
from rentgrid.plans import matches
from rentgrid.plans.stand_in import LISTING_SQL, listings, table
from rentgrid.sources import documents

_N = f"WITH {LISTING_SQL}, l AS (SELECT *, id::INT AS n FROM listing)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumn("n", F.expr("cast(id as int)"))


def product_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with their enrichment, which three in four have; a column of both is the raw one's."""
    raw = _numbered(spark, sf_dir)
    more = raw.where("n % 4 > 0").select("source_site", "source_id", F.lit("other").alias("title"), (F.col("n") % 10).alias("quality"))
    return documents.product_view(raw, more).select("id", "title", "quality")


PRODUCT_VIEW = f"{_N} SELECT id, title, CASE WHEN n % 4 > 0 THEN n % 10 END AS quality FROM l"

SEARCHES = [("cheap", {"rentMax": 900}), ("large", {"surfaceMin": 60}), ("never", {"rentMax": 5000})]
_CHANGE = "CASE event_id % 4 WHEN 0 THEN 'price_changed' WHEN 1 THEN 'disappeared' WHEN 2 THEN 'reappeared' ELSE 'new' END"


def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events on what each search finds since it was last checked, at most twenty; an event goes to the first search."""
    kind = F.expr(_CHANGE)
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_at"), (F.col("user_id") + 1).cast("string").alias("listing_id"), kind.alias("event_type"), F.lit("100").alias("old_value"), F.floor("value").cast("string").alias("new_value"))
    since = {"cheap": "2024-01-05 00:00:00", "large": "2024-01-10 00:00:00"}
    hits = matching.events_since(e, listings(spark, sf_dir), SEARCHES, since, 20)
    return matching.first_search_wins(hits, "event_id").select("event_id", "search_id", "listing_id", "rank")


CHANGES_SINCE = f"""{_N}, e AS (SELECT event_id, ts, (user_id + 1)::VARCHAR AS id, {_CHANGE} AS kind, floor(value)::INT AS v FROM events), k AS (SELECT * FROM e WHERE kind <> 'new' AND (kind <> 'price_changed' OR v < 100)),
 h AS (SELECT 'cheap' AS search_id, 0 AS position, event_id, ts, k.id FROM k JOIN l USING (id) WHERE rent_eur <= 900 AND ts > TIMESTAMP '2024-01-05' UNION ALL SELECT 'large', 1, event_id, ts, k.id FROM k JOIN l USING (id) WHERE surface_m2 >= 60 AND ts > TIMESTAMP '2024-01-10'),
 r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM h)
SELECT event_id, arg_min(search_id, position) AS search_id, any_value(id) AS listing_id, arg_min(rank, position) AS rank FROM r WHERE rank <= 20 GROUP BY 1"""


def failed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ten failures, named where watch and listing are known."""
    o = table(spark, sf_dir, "orders")
    ledger = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("watch_id"), (F.col("o_custkey") * 2).alias("listing_id"), F.col("o_orderdate").alias("notified_at"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("sent").alias("status"), F.lit("smtp").alias("error"))
    watches = spark.createDataFrame([(k, f"Watch {k}") for k in range(3)], "id int, name string")
    rows = listings(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    return matching.failed_notices(ledger, watches, rows).select("id", "watch_name", "listing_title", "url")


FAILED_NOTICES = f"""{_N}, f AS (SELECT o_orderkey AS id, o_custkey % 5 AS w, o_custkey * 2 AS x FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)
SELECT f.id, CASE WHEN w < 3 THEN 'Watch ' || w ELSE 'watch ' || w END AS watch_name, coalesce(title, 'listing ' || x) AS listing_title, url FROM f LEFT JOIN l ON l.n = x"""


def residential_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why listings are probably no homes."""
    d = _numbered(spark, sf_dir)
    title = F.expr("CASE n % 6 WHEN 0 THEN 'Local commercial centre' WHEN 1 THEN 'Appartement T3' WHEN 2 THEN 'Beau garage' ELSE title END")
    prose = F.expr("CASE n % 4 WHEN 0 THEN 'Possibilité de créer un local médical' WHEN 1 THEN 'Ancien local professionnel' ELSE 'Calme' END")
    kind = F.when(F.col("n") % 10 == 0, "Box").otherwise("logement")
    reasons = market.residential_reasons(title, prose, kind, F.col("url"), F.when(F.col("n") % 7 == 0, 12_000).otherwise(F.col("rent_eur")))
    return d.select("id", F.array_join(reasons, "|").alias("reasons"))


RESIDENTIAL_GATE = f"""{_N} SELECT id, concat_ws('|', CASE WHEN n % 10 = 0 THEN 'property_type=box' END,
 CASE WHEN n % 6 = 0 THEN 'strong_keyword=Local commercial' WHEN n % 6 = 2 AND n % 10 <> 0 THEN 'strong_keyword=garage' WHEN n % 6 = 2 THEN 'strong_keyword=garage' WHEN n % 10 = 0 THEN 'strong_keyword=box' END,
 CASE WHEN n % 4 = 1 THEN 'description_keyword=local professionnel' WHEN n % 4 = 0 AND n % 6 NOT IN (1) AND NOT (n % 6 > 2 AND regexp_matches(title, ' T[1-6] ')) THEN 'description_keyword=local médical' END, CASE WHEN n % 7 = 0 THEN 'rent_eur>10000' END) AS reasons FROM l"""


def best_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.top_opportunities(matches.opportunity(spark, sf_dir)).select("id", "score", "confidence")


BEST_OPPORTUNITIES = f"SELECT id, score, confidence FROM ({matches.OPPORTUNITY}) ORDER BY score DESC, confidence = 'haute' DESC, id LIMIT 80"


def exported_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the kept listings in the order of their export; unknown rents and sizes come last."""
    d = _numbered(spark, sf_dir).withColumns({"rent_eur": F.when(F.col("n") % 5 > 0, F.col("rent_eur")), "surface_m2": F.when(F.col("n") % 3 > 0, F.col("surface_m2")), "score": F.col("score") % 4})
    return coverage.page(d, [*public.export_order(True), F.col("id")], 1).select("id")


EXPORTED_PAGE = f"{_N} SELECT id FROM l ORDER BY score % 4 DESC, CASE WHEN n % 5 > 0 THEN rent_eur ELSE 1000000000 END, CASE WHEN n % 3 > 0 THEN surface_m2 ELSE 0 END DESC, id LIMIT 36 OFFSET 36"


def group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of groups: automatic ones first, then by confidence and id."""
    g = _numbered(spark, sf_dir).select(F.concat(F.lit("D"), "id").alias("group_id"), F.when(F.col("n") % 5 == 0, "auto_duplicate").otherwise("needs_review").alias("decision"), (F.col("score") % 7 / 10).alias("confidence"))
    return coverage.page(g, public.group_order(), 0).select("group_id", "decision")


GROUP_PAGE = f"{_N} SELECT 'D' || id AS group_id, CASE WHEN n % 5 = 0 THEN 'auto_duplicate' ELSE 'needs_review' END AS decision FROM l ORDER BY n % 5 <> 0, (score % 7 / 10.0)::DOUBLE DESC, 'D' || id LIMIT 36"


def fresh_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users first seen within three whole days of the last day's noon."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return first.select("user_id", coverage.is_fresh(F.col("first"), F.lit("2024-01-04 12:00:00").cast("timestamp")).alias("fresh"))


FRESH_USERS = "SELECT user_id, floor((epoch_us(TIMESTAMP '2024-01-04 12:00:00') - epoch_us(min(ts))) / 86400000000.0) <= 3 AS fresh FROM events GROUP BY 1"


def title_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and telling words of titles."""
    d = _numbered(spark, sf_dir).withColumn("full", F.concat(F.expr("CASE n % 5 WHEN 0 THEN 'Villa-Maison ' WHEN 1 THEN 'STUDIO 974 ' WHEN 2 THEN 'Été 2024 ' ELSE '' END"), "title"))
    return d.select("id", entity.property_family(F.col("full")).alias("family"), F.array_join(entity.title_tokens(F.col("full")), " ").alias("tokens"))


TITLE_FEATURES = f"""{_N}, f AS (SELECT id, n, replace(strip_accents(lower(CASE n % 5 WHEN 0 THEN 'Villa-Maison ' WHEN 1 THEN 'STUDIO 974 ' WHEN 2 THEN 'Été 2024 ' ELSE '' END || title)), '-', ' ') AS t FROM l),
 w AS (SELECT *, list_filter(regexp_extract_all(t, '[a-z0-9]{{3,}}'), lambda x: NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ('villa', 'maison', 'studio')) AS ws FROM f)
SELECT id, CASE WHEN n % 5 = 0 THEN 'maison' WHEN n % 5 = 1 OR regexp_matches(t, 't[1-5]') THEN 'appartement' ELSE 'unknown' END AS family, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS tokens FROM w"""

_PLACED = {"title": "CASE n % 3 WHEN 0 THEN 'T2 à Saint-Pierre' WHEN 1 THEN 'T2 calme' ELSE 'T2 à Saint-Denis' END", "commune": "CASE n % 2 WHEN 0 THEN 'Saint-Denis' END"}


def location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the places inferred from titles and declared communes."""
    d = _numbered(spark, sf_dir).select("id", "n", *[F.expr(e).alias(c) for c, e in _PLACED.items()])
    return coverage.location_summary(geo.infer_location(d))


LOCATION_SUMMARY = f"""{_N}, p AS (SELECT CASE WHEN n % 3 = 0 THEN 'Saint-Pierre' WHEN n % 3 = 2 OR n % 2 = 0 THEN 'Saint-Denis' ELSE 'Non précisée' END AS c, CASE WHEN n % 3 = 0 THEN 'moyenne' WHEN n % 2 = 0 THEN 'haute' WHEN n % 3 = 2 THEN 'moyenne' ELSE 'faible' END AS q FROM l)
SELECT 'listings' AS figure, '' AS key, count(*) AS n FROM p UNION ALL SELECT 'focus', '', count(*) FILTER (c = 'Saint-Denis') FROM p UNION ALL SELECT 'quality', q, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'commune', c, count(*) FROM p GROUP BY 2"""


def vetoed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone's listings, but not those whose own text names a place that speaks against it."""
    d = listings(spark, sf_dir).drop("description")
    p = matching.search_predicate(d, {"zones": ["Brand#12", "Brand#2"]}, {"Brand#2": ["Brand#34"]}, {"Brand#12": ["almond"], "Brand#2": ["pale", "tin"]})
    return d.where(p).select("id")


VETOED_SEARCH = f"{_N} SELECT id FROM l WHERE (commune LIKE '%Brand#12%' OR commune LIKE '%Brand#2%' OR commune LIKE '%Brand#34%') AND NOT regexp_matches(lower(title), '\\b(almond|pale|tin)\\b')"


def export_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two exports has."""
    d = _numbered(spark, sf_dir)
    return coverage.round_trip(d.where("rent_eur < 1300"), d.where("surface_m2 > 30"), "id").select("id", "side")


EXPORT_DIFFERENCES = f"{_N} SELECT id, CASE WHEN rent_eur < 1300 THEN 'left' ELSE 'right' END AS side FROM l WHERE (rent_eur < 1300) <> (surface_m2 > 30)"


def volume_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir)
    return coverage.volume_checks(d, "source_site", F.col("image_url") != "", 150, {"src1": 20, "src9": 1}, 0.9)


VOLUME_CHECKS = f"""{_N}, a AS (SELECT count(*)::DOUBLE AS n, avg((image_url <> '')::INT) AS p, count(*) FILTER (source_site = 'src1')::DOUBLE AS s FROM l)
SELECT 'total' AS "check", n AS value, n >= 150 AS ok FROM a UNION ALL SELECT 'photo_share', p, p >= 0.9 FROM a UNION ALL SELECT 'source:src1', s, s >= 20 FROM a UNION ALL SELECT 'source:src9', 0.0, false"""


def gate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of gate families and whether they passed: event types, by the size of their values."""
    return coverage.run_groups(table(spark, sf_dir, "events"), "event_type", F.col("value") < 400)


GATE_FAMILIES = "SELECT event_type, count(*) AS steps, count(*) FILTER (value < 400) AS passed, bool_and(value < 400) AS ok FROM events GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        product_view, changes_since, failed_notices, residential_gate, best_opportunities, exported_page, group_page, fresh_users, title_features, location_summary, vetoed_search,
        export_differences, volume_checks, gate_families,
    )
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

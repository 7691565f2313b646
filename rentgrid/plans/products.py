"""The public product over listings made of the driver's tables: labels, tabs, sidecars and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators import public
from rentgrid.plans.stand_in import LISTING_SQL, listings, table

_RAW = "CASE cast(id as int) % 6 WHEN 0 THEN concat(commune, ' - ', source_site, ' - ', property_type) WHEN 1 THEN commune WHEN 2 THEN 'Non précisé' WHEN 3 THEN concat(commune, ' - ') WHEN 4 THEN concat(' ', source_site, ' ') END"
_ZONE = "CASE cast(id as int) % 4 WHEN 0 THEN 'Moufia' WHEN 1 THEN commune WHEN 2 THEN 'Zone non précisée' END"
_PLACED = f"placed AS (SELECT *, {_RAW} AS district, {_ZONE} AS zone FROM listing)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumns({"district": F.expr(_RAW), "zone": F.expr(_ZONE)})


def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir)
    label = public.district_label(F.col("district"), F.col("commune"))
    geo = public.geo_level(F.when(F.col("score") % 5 == 0, "Quartier").otherwise(F.col("zone")), F.col("commune"), label)
    return d.select("id", label.alias("district"), public.place_label(label, F.col("commune"), F.col("zone")).alias("place"), geo["level"].alias("level"), geo["score"].alias("geo_score"))


PLACE_LABELS = f"""WITH {LISTING_SQL}, {_PLACED}, d AS (SELECT *, CASE id::INT % 6 WHEN 0 THEN source_site || ' · ' || property_type WHEN 4 THEN source_site END AS label FROM placed)
SELECT id, label AS district, coalesce(label || ' · ', '') || CASE WHEN zone = 'Moufia' THEN 'Moufia · ' ELSE '' END || commune AS place,
 CASE WHEN score % 5 = 0 THEN 'haute' WHEN label IS NOT NULL THEN 'moyenne' ELSE 'commune' END AS level, CASE WHEN score % 5 = 0 THEN 0.8 WHEN label IS NOT NULL THEN 0.65 ELSE 0.45 END::DOUBLE AS geo_score FROM d"""


def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir).withColumns({"zones": F.when(F.col("zone").isNotNull(), F.array("zone")), "primary_zone": F.when(F.col("score") % 7 == 0, "La Bretagne"), "duplicate_group_size": F.when(F.col("score") % 9 == 0, 2)})
    named = F.array_compact(F.array(*[F.when(p, k) for k, p in public.tabs(d).items()]))
    return d.select(F.explode(named).alias("tab")).groupBy("tab").agg(F.count("*").alias("n"))


TAB_COUNTS = f"""WITH {LISTING_SQL}, {_PLACED}, z AS (SELECT *, coalesce(zone = 'Moufia', false) OR score % 7 = 0 AS target, surface_m2 >= 60 AND rent_eur BETWEEN 600 AND 1000 AS fits FROM placed),
 t AS (SELECT 'strict' AS tab FROM z WHERE target AND fits AND (coalesce(bedrooms, 0) >= 1 OR rooms >= 2) UNION ALL SELECT 'target' FROM z WHERE target UNION ALL SELECT 'sameBudgetElsewhere' FROM z WHERE NOT target AND fits
  UNION ALL SELECT 'furnished' FROM z WHERE furnished = 'Meublé' UNION ALL SELECT 'duplicates' FROM z WHERE score % 9 = 0) SELECT tab, count(*) AS n FROM t GROUP BY 1"""


def portal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir).selectExpr("id", "commune as city", "district", "property_type as type", "title", "description", "rent_eur as price", "surface_m2 as surface", "if(rooms = 5, 0, rooms) as rooms", "bedrooms", "score", "if(score = 50, false, null) as display_canonical")
    return d.where(public.portal_predicate(d, {"maxPrice": 1200, "minPrice": 600, "minSurface": 40, "minRooms": 2, "minBedrooms": 1, "minScore": 20, "zones": ["Almond", " BLUE "]})).select("id")


PORTAL_FILTER = f"""WITH {LISTING_SQL}, {_PLACED} SELECT id FROM placed WHERE score <> 50 AND rent_eur BETWEEN 600 AND 1200 AND surface_m2 >= 40 AND rooms IN (2, 3, 4) AND coalesce(bedrooms, 0) >= 1 AND score >= 20
 AND (lower(concat_ws(' ', commune, district, title, description)) LIKE '%almond%' OR lower(concat_ws(' ', commune, district, title, description)) LIKE '%blue%')"""


def public_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir).withColumn("local_image_urls", F.transform(F.sequence(F.lit(1), F.col("rooms") * 3), lambda i: F.concat(F.col("id"), F.lit("-"), i.cast("string"))))
    d = d.withColumn("local_image_urls", F.when(F.col("rooms") == 4, F.slice("local_image_urls", 1, 0)).otherwise(F.col("local_image_urls"))).withColumn("price", F.when(F.col("score") != 3, (F.col("rent_eur") - 501).cast("string")))
    shown = d.where(public.price_publishable(F.col("price")))
    return shown.select("id", public.without_empties(shown, ["id", "title", "bedrooms", "image_url", "local_image_urls", "secret"], ("local_image_urls",)).alias("item"))


PUBLIC_ITEMS = f"""WITH {LISTING_SQL} SELECT id, '{{"id":"' || id || '","title":"' || title || '"' || coalesce(',"bedrooms":' || bedrooms, '') || CASE WHEN image_url <> '' THEN ',"image_url":"' || image_url || '"' ELSE '' END ||
 CASE WHEN rooms <> 4 THEN ',"local_image_urls":[' || array_to_string(list_transform(range(1, least(8, rooms * 3) + 1), lambda i: '"' || id || '-' || i || '"'), ',') || ']' ELSE '' END || '}}' AS item
FROM listing WHERE score <> 3 AND rent_eur > 501"""


def exported_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir).withColumns({"rent_eur": F.when(F.col("score") == 5, 20_000).otherwise(F.col("rent_eur")), "residential_status": F.when(F.col("score") % 10 == 0, "excluded_type").otherwise("residential_candidate"), "residential_reasons": F.when(F.col("score") % 10 == 0, F.array(F.lit("type")))})
    return public.partitioned(d).select("id", "list", "residential_status", F.array_join("residential_reasons", ",").alias("reasons"))


EXPORTED_LISTS = f"""WITH {LISTING_SQL} SELECT id, CASE WHEN score = 5 OR score % 10 = 0 THEN 'suspect' ELSE 'kept' END AS list, CASE WHEN score = 5 THEN 'excluded_bad_rent' WHEN score % 10 = 0 THEN 'excluded_type' ELSE 'residential_candidate' END AS residential_status,
 CASE WHEN score = 5 THEN 'rent_eur>10000' WHEN score % 10 = 0 THEN 'type' ELSE '' END AS reasons FROM listing"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with details and photos of some of them, on (source_site, source_id)."""
    d = listings(spark, sf_dir).select("source_site", "source_id", "score", "image_url")
    detail = d.where("score % 2 = 0").select("source_site", "source_id", F.when(F.col("score") % 4 == 0, 200).otherwise(404).alias("http_status"))
    photo = d.where("image_url != ''").select("source_site", "source_id", F.length("image_url").alias("bytes"))
    out = public.with_sidecars(d.select("source_site", "source_id"), ["source_site", "source_id"], {"detail": detail, "photo": photo}, {"photo_bytes": 0})
    again = public.to_reparse(d, detail, ["source_site", "source_id"]).select("source_site", "source_id", F.lit(True).alias("again"))
    return out.join(again, ["source_site", "source_id"], "left").select("source_id", "detail_http_status", "photo_bytes", F.coalesce("again", F.lit(False)).alias("again"))


SIDECARS = f"""WITH {LISTING_SQL} SELECT source_id, CASE WHEN score % 4 = 0 THEN 200 WHEN score % 2 = 0 THEN 404 END AS detail_http_status, length(image_url) AS photo_bytes, score % 4 = 0 AS again FROM listing"""


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their six latest orders, as a listing's history."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    out = public.with_history(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), o, "o_custkey", "o_orderdate", ["o_orderkey"])
    return out.select(F.col("o_custkey").alias("custkey"), F.array_join(F.transform("history", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


LATEST_ORDERS = """WITH r AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 6),
 l AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM r GROUP BY 1) SELECT c_custkey AS custkey, coalesce(orders, '') AS orders FROM customer LEFT JOIN l ON o_custkey = c_custkey"""


def key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir)
    known = d.where("score % 3 != 0").select("source_site", "source_id", F.when(F.col("score") % 2 == 0, F.col("url")).otherwise("moved").alias("url"), F.col("score").alias("found"))
    return public.by_full_or_short_key(d.select("id", "source_site", "source_id", "url"), known, ["source_site", "source_id", "url"], ["source_site", "source_id"], ["found"]).select("id", "matched", "found")


KEY_FALLBACK = f"""WITH {LISTING_SQL} SELECT id, CASE WHEN score % 3 = 0 THEN 'none' WHEN score % 2 = 0 THEN 'exact' ELSE 'fallback' END AS matched, CASE WHEN score % 3 <> 0 THEN score END AS found FROM listing"""


def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, score bands and the enrichment summary in one row."""
    d = listings(spark, sf_dir).withColumns({"city": F.when(F.col("score") % 8 == 0, "Non précisée").otherwise(F.col("commune")), "group_key": F.when(F.col("score") < 20, F.col("score")), "is_residential": F.col("score") % 2, "is_canonical": F.col("score") % 3})
    lists = public.distinct_figures(d, ["commune", "property_type"], ["source_site"]).withColumn("source_site", F.array_join("source_site", ","))
    return lists.crossJoin(public.score_bands(d)).crossJoin(public.enrichment_summary(d))  # one row each


RUN_FIGURES = f"""WITH {LISTING_SQL}, g AS (SELECT count(*) AS n FROM listing WHERE score < 20 GROUP BY score HAVING count(*) > 1)
SELECT count(DISTINCT commune) AS n_commune, count(DISTINCT property_type) AS n_property_type, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source_site AS s FROM listing)) AS source_site,
 count_if(score >= 75) AS strong_75_plus, count_if(score BETWEEN 55 AND 74) AS medium_55_74, count_if(score < 55) AS low_under_55, count(*) AS active_rows, count_if(score % 8 = 0) AS city_missing,
 round_even(100.0 * count_if(score % 8 <> 0) / count(*), 1)::DOUBLE AS city_coverage_pct, count_if(score % 2 = 1) AS residential, count_if(score % 2 = 1 AND score % 3 = 1) AS canonical_residential,
 (SELECT count(*) FROM g) AS duplicate_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS duplicate_items FROM listing"""


def scrape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir).withColumns({"status": F.when(F.col("score") % 3 == 0, "new").when(F.col("score") % 3 == 1, "changed").otherwise("seen"), "urls": F.when(F.col("score") % 4 != 0, F.array_repeat("image_url", F.col("rooms")))})
    return public.scrape_summary(d).join(public.gallery_stats(d, "source_site", "urls").drop("n"), "source_site")


SCRAPE_REPORT = f"""WITH {LISTING_SQL}, u AS (SELECT *, CASE WHEN score % 4 <> 0 THEN rooms ELSE 0 END AS k FROM listing) SELECT source_site, count(*) AS n, count_if(image_url <> '') AS with_image, count_if(score % 3 = 0) AS "new",
 count_if(score % 3 = 1) AS changed, count_if(score % 3 = 2) AS seen, sum(k)::BIGINT AS urls, round_even(avg(k), 2)::DOUBLE AS avg_urls, count_if(k > 1) AS multi FROM u GROUP BY 1"""


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 4 != 0).alias("ok"), F.when(F.col("page_id") % 8 == 0, "timeout").alias("reason"))
    return public.fetch_report(p)


FETCH_OUTCOMES = """SELECT CASE WHEN page_id % 4 <> 0 THEN 'host' ELSE 'failure' END AS kind, CASE WHEN page_id % 4 <> 0 THEN regexp_extract(url, '://([^/?#]+)', 1) WHEN page_id % 8 = 0 THEN 'timeout' ELSE 'unknown' END AS name,
 count(*) AS n FROM pages GROUP BY 1, 2"""


def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir).selectExpr("is_active = 1 as active", "if(score % 2 = 0, 1.0, null) as lat", "image_url as image", "score % 5 = 0 as detail_read", "score < 10 as fresh", "furnished as precision")
    return public.feed_figures(d)


FEED_COUNTS = f"""WITH {LISTING_SQL}, f AS (SELECT unnest(list_filter(['total', CASE WHEN is_active = 1 THEN 'active' END, CASE WHEN score % 2 = 0 THEN 'with_point' END, CASE WHEN image_url <> '' THEN 'with_photo' END,
 CASE WHEN is_active = 1 AND image_url = '' THEN 'active_without_photo' END, CASE WHEN score % 5 = 0 THEN 'detail_read' END, CASE WHEN is_active = 1 AND score < 10 THEN 'fresh' END, 'precision:' || furnished], lambda x: x IS NOT NULL)) AS name FROM listing)
SELECT name, count(*) AS n FROM f GROUP BY 1"""


def search_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public.search_scores(listings(spark, sf_dir), "source_site", F.when(F.col("score") % 6 != 0, F.col("score")))


SEARCH_AVERAGES = f"WITH {LISTING_SQL} SELECT source_site, count(*) AS n, round_even(avg(CASE WHEN score % 6 <> 0 THEN score ELSE 0 END), 1)::DOUBLE AS avg_score FROM listing GROUP BY 1"


def notable_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's limits are the feature: eight falls of price, four returns."""
    d = listings(spark, sf_dir).selectExpr("cast(id as int) as id", "case when score % 5 = 0 then 'reappeared' else 'price_changed' end as event_type", "cast(rent_eur as string) as old_value", "cast(rent_eur + score - 60 as string) as new_value", "if(score = 90, 'down', null) as direction")
    return public.notable_changes(d).select("id", "kind", "delta")


NOTABLE_CHANGES = f"""WITH {LISTING_SQL}, c AS (SELECT id::INT AS id, (score - 60)::DOUBLE AS delta, score % 5 = 0 AS back FROM listing)
(SELECT id, 'price_down' AS kind, delta FROM c WHERE NOT back AND delta < 0 ORDER BY abs(delta) DESC, id LIMIT 8) UNION ALL (SELECT id, 'reappeared', delta FROM c WHERE back ORDER BY id LIMIT 4)"""


def seen_lately(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir).withColumn("age", F.when(F.col("score") % 13 != 0, F.col("score") * 1.5))
    return d.groupBy(public.availability(F.col("age")).alias("status")).agg(F.count("*").alias("n"))


SEEN_LATELY = f"WITH {LISTING_SQL} SELECT CASE WHEN score % 13 = 0 THEN 'unknown' WHEN score * 1.5 <= 36 THEN 'fresh' WHEN score * 1.5 <= 96 THEN 'attention' ELSE 'stale' END AS status, count(*) AS n FROM listing GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        place_labels, tab_counts, portal_filter, public_items, exported_lists, sidecars, latest_orders, key_fallback, run_figures, scrape_report, fetch_outcomes, feed_counts,
        search_averages, notable_changes, seen_lately,
    )
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

"""Market references, saved searches, watches, profiles and duplicates over the stand-in listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.operators import entity, market, matching, profiles
from rentgrid.operators.graph import components
from rentgrid.plans.stand_in import LISTING_SQL, listings, table


def market_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of line items against the median of type and brand, of the type, or of all."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    r = market.references(l.join(p, "l_partkey"), "v", ["p_type", "p_brand"], ["p_type"], least=40)
    return r.groupBy("p_type", "p_brand", "reference_scope").agg(F.max(N.half_even(F.col("reference"), 4)).alias("reference"), F.max("reference_n").alias("n"), F.count_if(F.col("v") < F.col("reference")).alias("below"))


MARKET_REFERENCE = """
WITH x AS (SELECT p_type, p_brand, l_extendedprice / l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT p_type, p_brand, median(v) AS m, count(*) AS n FROM x GROUP BY 1, 2),
 c AS (SELECT p_type, median(v) AS m, count(*) AS n FROM x GROUP BY 1), a AS (SELECT median(v) AS m, count(*) AS n FROM x),
 r AS (SELECT x.*, CASE WHEN f.n >= 40 THEN f.m WHEN c.n >= 40 THEN c.m ELSE a.m END AS ref, CASE WHEN f.n >= 40 THEN f.n WHEN c.n >= 40 THEN c.n ELSE a.n END AS n,
  CASE WHEN f.n >= 40 THEN 'fine' WHEN c.n >= 40 THEN 'coarse' ELSE 'global' END AS s FROM x JOIN f USING (p_type, p_brand) JOIN c USING (p_type), a)
SELECT p_type, p_brand, s AS reference_scope, round_even(max(ref), 4) AS reference, max(n) AS n, count(*) FILTER (v < ref) AS below FROM r GROUP BY 1, 2, 3"""


def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.group_medians(listings(spark, sf_dir), "commune", "rent_eur")


GROUP_MEDIANS = f"WITH {LISTING_SQL} SELECT commune, round_even(median(rent_eur)::DOUBLE, 2) AS median, count(*) AS n FROM listing GROUP BY 1 HAVING count(*) >= 3"


def exclusive_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.exclusive_quartiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


EXCLUSIVE_QUARTILES = """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
 q AS (SELECT l_returnflag, n, p, greatest(1, least(n - 1, (p * (n + 1)) // 100)) AS j FROM (SELECT DISTINCT l_returnflag, n FROM r WHERE n >= 100), (SELECT unnest([25, 75]) AS p)),
 v AS (SELECT q.l_returnflag, q.n, p, max(v) FILTER (r = j) AS a, max(v) FILTER (r = j + 1) AS b, max(p * (q.n + 1) - j * 100) AS d FROM q JOIN r USING (l_returnflag) GROUP BY 1, 2, 3)
SELECT l_returnflag, n, max(trunc((a * (100 - d) + b * d) / 100.0)) FILTER (p = 25)::BIGINT AS p25, max(trunc((a * (100 - d) + b * d) / 100.0)) FILTER (p = 75)::BIGINT AS p75 FROM v GROUP BY 1, 2"""


def opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumns({"local_image_url": F.col("image_url"), "location_quality": F.when(F.col("rooms") > 3, "haute").when(F.col("rooms") > 1, "moyenne"), "is_new": F.col("rooms") == 2})
    return market.opportunity(rows).select("id", "score", "label", "confidence", "reference_scope", "market_price", "listing_quality", "location_fit", "freshness", "risk", "data_confidence")


OPPORTUNITY = f"""
WITH {LISTING_SQL}, x AS (SELECT *, rent_eur / surface_m2 AS v FROM listing), f AS (SELECT commune, property_type, median(v) AS m, count(*) AS n FROM x GROUP BY 1, 2), c AS (SELECT commune, median(v) AS m, count(*) AS n FROM x GROUP BY 1),
 a AS (SELECT median(v) AS m, count(*) AS n FROM x),
 r AS (SELECT x.*, CASE WHEN f.n >= 5 THEN f.m WHEN c.n >= 5 THEN c.m ELSE a.m END AS ref, CASE WHEN f.n >= 5 THEN f.n WHEN c.n >= 5 THEN c.n ELSE a.n END AS n, CASE WHEN f.n >= 5 THEN 'fine' WHEN c.n >= 5 THEN 'coarse' ELSE 'global' END AS reference_scope
  FROM x JOIN f USING (commune, property_type) JOIN c USING (commune), a),
 d AS (SELECT *, (ref - v) / ref AS delta, image_url <> '' AS pic FROM r),
 k AS (SELECT id, reference_scope, CASE WHEN delta >= .18 THEN 34 WHEN delta >= .08 THEN 27 WHEN delta >= -.05 THEN 18 ELSE greatest(0, round_even(16 + delta * 70, 0)::INTEGER) END AS market_price,
  greatest(0, least(22, CASE WHEN pic THEN 7 ELSE 0 END + CASE WHEN length(description) >= 350 THEN 8 WHEN length(description) >= 120 THEN 5 ELSE -4 END + CASE WHEN surface_m2 / rooms >= 18 THEN 4 ELSE 0 END)) AS listing_quality,
  CASE WHEN rooms > 3 THEN 10 WHEN rooms > 1 THEN 7 ELSE 3 END AS location_fit, CASE WHEN rooms = 2 THEN 5 ELSE 3 END AS freshness, CASE WHEN rent_eur > 3500 THEN 6 ELSE 12 END AS risk,
  least(10, CASE WHEN n >= 12 THEN 4 WHEN n >= 5 THEN 3 WHEN n >= 3 THEN 2 ELSE 0 END + 2 + CASE WHEN length(description) >= 120 THEN 2 ELSE 0 END + CASE WHEN pic THEN 1 ELSE 0 END + CASE WHEN rooms > 1 THEN 1 ELSE 0 END) AS data_confidence FROM d),
 s AS (SELECT *, greatest(0, least(100, market_price + listing_quality + location_fit + freshness + risk + data_confidence)) AS score FROM k)
SELECT *, CASE WHEN score >= 75 THEN 'opportunité forte' WHEN score >= 58 THEN 'à étudier' WHEN score >= 42 THEN 'standard' ELSE 'risque/bruit' END AS label,
 CASE WHEN data_confidence >= 8 THEN 'haute' WHEN data_confidence >= 5 THEN 'moyenne' ELSE 'faible' END AS confidence FROM s"""


def default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("primary_zone", F.element_at(F.array(F.lit("Moufia"), F.lit("Saint-Denis"), F.lit("Cilaos")), (F.col("rooms") % 3 + 1).cast("int")))
    return rows.select("id", market.default_score(rows).alias("score"), F.array_join(market.variant_tags(rows), ",").alias("tags"), market.decision_summary(rows).alias("summary"))


DEFAULT_SCORES = f"""
WITH {LISTING_SQL}, z AS (SELECT *, CASE rooms % 3 WHEN 0 THEN 'Moufia' WHEN 1 THEN 'Saint-Denis' ELSE 'Cilaos' END AS zone, rent_eur BETWEEN 600 AND 1000 AS bud FROM listing)
SELECT id, CASE zone WHEN 'Moufia' THEN 40 WHEN 'Saint-Denis' THEN 18 ELSE 0 END + CASE WHEN surface_m2 >= 60 THEN 16 ELSE 0 END + CASE WHEN bud THEN 18 ELSE 0 END + CASE WHEN bedrooms >= 1 THEN 10 WHEN rooms >= 2 THEN 8 ELSE 0 END
  + CASE furnished WHEN 'Non meublé' THEN 8 WHEN 'Non précisé' THEN 3 ELSE 0 END + CASE WHEN image_url <> '' THEN 10 ELSE 0 END AS score,
 array_to_string(list_filter([CASE WHEN zone <> 'Cilaos' THEN 'Zone ciblée' END, CASE WHEN zone = 'Moufia' THEN 'Zone prioritaire' END, CASE WHEN bud THEN 'Budget 600–1000€' WHEN rent_eur <= 1200 THEN 'Budget proche' END,
  CASE WHEN surface_m2 >= 60 THEN '≥ 60 m²' WHEN surface_m2 >= 50 THEN 'Surface proche' END, CASE WHEN furnished = 'Meublé' THEN 'Variante meublée' END, CASE WHEN zone = 'Cilaos' AND bud AND surface_m2 >= 60 THEN 'Même budget/surface ailleurs' END],
  lambda x: x IS NOT NULL)[1:4], ',') AS tags,
 coalesce(nullif(array_to_string(list_filter([CASE zone WHEN 'Moufia' THEN 'zone prioritaire' WHEN 'Saint-Denis' THEN 'secteur cible large' END, CASE WHEN bud THEN 'budget cible' WHEN rent_eur <= 1200 THEN 'budget proche' END,
  CASE WHEN surface_m2 >= 60 THEN 'surface confortable' END, CASE WHEN furnished = 'Non meublé' THEN 'non meublé' END], lambda x: x IS NOT NULL)[1:4], ' · '), ''), 'à vérifier manuellement') AS summary FROM z"""

SEARCHES = [
    ("small", {"rentMax": 800, "surfaceMin": 30, "furnished": ["Meublé"]}),
    ("brand", {"commune": ["Brand#3", "Brand#4"], "roomsMin": 2}),
    ("beds", {"bedroomsMin": 2, "rentMin": 700, "q": "red"}),
    ("zone", {"zones": ["Brand#1"], "rentMax": 1500}),
]
_SEARCH = {
    "small": "rent_eur <= 800 AND surface_m2 >= 30 AND furnished = 'Meublé'",
    "brand": "commune IN ('Brand#3', 'Brand#4') AND rooms >= 2",
    "beds": "bedrooms >= 2 AND rent_eur >= 700 AND (lower(title || ' ' || description || ' ' || commune || ' ' || property_type || ' ' || url)) LIKE '%red%'",
    "zone": "(lower(commune) LIKE '%brand#1%' OR lower(description) LIKE '%brand#1%') AND rent_eur <= 1500",
}


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return matching.match_all(rows, [(n, matching.search_predicate(rows, f)) for n, f in SEARCHES])


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("search_id", "id")


_ALL = " UNION ALL ".join(f"SELECT '{n}' AS search_id, {i} AS position, id, rent_eur, score FROM listing WHERE {p}" for i, (n, p) in enumerate(_SEARCH.items()))
SAVED_SEARCHES = f"WITH {LISTING_SQL}, m AS ({_ALL}) SELECT search_id, id FROM m"


def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New matches: those seen before are subtracted, the search never checked is silent, and the first
    search that a listing meets keeps it."""
    m = _matches(spark, sf_dir)
    seen = m.where(F.col("score") % 3 == 0).select("search_id", "id")
    checked = spark.createDataFrame([("small",), ("beds",), ("zone",)], "search_id string")
    return matching.first_search_wins(matching.new_matches(m, seen, checked)).select("search_id", "id")


NEW_ALERTS = f"WITH {LISTING_SQL}, m AS ({_ALL}) SELECT search_id, id FROM m WHERE search_id <> 'brand' AND score % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) = 1"

WATCHES = [(1, {"commune": ["brand#2"], "prix_max": 1300, "limit": 7}), (2, {"type": "economy", "surface_min": 60, "limit": 5}), (3, {"source": "SRC1", "q": "red"})]


def watch_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three watches send next: at most their limit, after the ledger; the limits are the feature."""
    rows = listings(spark, sf_dir).selectExpr("cast(id as bigint) AS id", "source_site AS source", "source_id AS site_id", "title", "url", "commune", "rent_eur AS prix", "surface_m2 AS surface", "property_type AS type")
    ledger = rows.where("id % 2 = 0").select(F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("watch_id"), F.col("id").alias("listing_id"))
    return matching.to_notify(rows, WATCHES, ledger).select("watch_id", "listing_id", "rank")


WATCH_NOTICES = f"""
WITH {LISTING_SQL}, m AS (SELECT 1 AS watch_id, 7 AS lim, id::BIGINT AS id FROM listing WHERE lower(commune) = 'brand#2' AND rent_eur <= 1300 AND id::BIGINT % 2 <> 0
 UNION ALL SELECT 2, 5, id::BIGINT FROM listing WHERE lower(property_type || ' ' || title || ' ' || url) LIKE '%economy%' AND surface_m2 >= 60 AND id::BIGINT % 2 <> 0
 UNION ALL SELECT 3, 20, id::BIGINT FROM listing WHERE source_site = 'src1' AND lower(title || ' ' || url || ' ' || commune || ' ' || source_site || ' ' || source_id) LIKE '%red%'),
 r AS (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY id) AS rank FROM m) SELECT watch_id, id AS listing_id, rank FROM r WHERE rank <= lim"""

PROFILE = {
    "id": "family", "criteria": {"zones": ["Brand#5", "Brand#6"], "rent_min_eur": 600, "rent_max_eur": 1200, "surface_min_m2": 50, "bedrooms_min": 2, "furnished_preference": "Non meublé"},
    "fallbacks": {"furnished": ["Non précisé"], "bedrooms_min": 1},
}


def profile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and near misses of a profile, 20 and 10 at most: the limits are the feature."""
    out = profiles.profile_matches(listings(spark, sf_dir), [PROFILE])
    return out.select("profile_id", "id", "decision", F.array_join("warnings", ",").alias("warnings"), F.array_join("misses", ",").alias("misses"), "rank")


PROFILE_MATCHES = f"""
WITH {LISTING_SQL}, b AS (SELECT *, rent_eur BETWEEN 600 AND 1200 AS rok, surface_m2 >= 50 AS sok FROM listing
  WHERE regexp_matches(replace(lower(title || ' ' || description || ' ' || url || ' ' || commune), '#', ' '), '\\bbrand [56]\\b') AND furnished <> 'Meublé'),
 w AS (SELECT *, concat_ws(',', CASE WHEN furnished = 'Non précisé' THEN 'furnished_fallback' END, CASE WHEN bedrooms = 1 THEN 'two_bedrooms_fallback' END) AS warnings FROM b),
 m AS (SELECT id, rent_eur, CASE WHEN warnings = '' THEN 'strict_match' ELSE 'fallback_match' END AS decision, warnings, '' AS misses, 0 AS gaps FROM w WHERE rok AND sok AND bedrooms >= 1),
 g AS (SELECT *, list_filter([CASE WHEN rent_eur < 600 THEN 'rent_below_target:' || rent_eur || '<600' WHEN rent_eur > 1200 THEN 'rent_above_target:' || rent_eur || '>1200' END,
   CASE WHEN NOT sok THEN 'surface_below_target:' || surface_m2::BIGINT || '<50' END, CASE WHEN bedrooms IS NULL THEN 'bedrooms_unknown' END], lambda x: x IS NOT NULL) AS ms FROM w
   WHERE (rok OR abs(rent_eur - CASE WHEN rent_eur < 600 THEN 600 ELSE 1200 END) / CASE WHEN rent_eur < 600 THEN 600.0 ELSE 1200.0 END <= 0.12) AND (sok OR abs(surface_m2 - 50) / 50.0 <= 0.10) AND (bedrooms IS NULL OR bedrooms >= 1)),
 a AS (SELECT * FROM m UNION ALL SELECT id, rent_eur, 'near_miss', warnings, array_to_string(ms, ','), len(ms) FROM g WHERE len(ms) > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY decision = 'near_miss' ORDER BY CASE decision WHEN 'strict_match' THEN 0 ELSE 1 END, gaps, rent_eur, id) AS rank FROM a)
SELECT 'family' AS profile_id, id, decision, warnings, misses, rank FROM r WHERE rank <= CASE WHEN decision = 'near_miss' THEN 10 ELSE 20 END"""

SCORED = {
    "one": {"zones": {1: ["Brand#1"], 2: ["Brand#2", "Brand#3"]}, "surface_min": 50, "loyer_min": 500, "loyer_max": 1000, "chambres_ideal": 2, "chambres_min": 1, "types": None, "non_meuble_prefere": False, "bonus_acces": False},
    "two": {"zones": {1: ["Brand#4"]}, "surface_min": 90, "loyer_min": 800, "loyer_max": 1500, "chambres_ideal": 3, "chambres_min": 2, "types": ["small", "large"], "non_meuble_prefere": False, "bonus_acces": False},
}


def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("id", "title", "commune", F.col("rent_eur").alias("rent"), F.col("surface_m2").alias("surface"), "rooms", "bedrooms", F.col("property_type").alias("type"))
    return profiles.best_profile(rows, SCORED).select("id", "best_profile", "best_score")


def _score_sql(p: dict, zone: str) -> str:
    low, high, need = p["loyer_min"], p["loyer_max"], p["surface_min"]
    kind = "CASE WHEN lower(property_type) LIKE '%small%' OR lower(property_type) LIKE '%large%' THEN 0 ELSE -12 END" if p["types"] else "0"
    return f"""greatest(0, least(100, round_even(({zone} + CASE WHEN rent_eur BETWEEN {low} AND {high} THEN 22 WHEN rent_eur < {low} THEN 12 ELSE greatest(0, 16 - (rent_eur - {high}) / {high}.0::DOUBLE * 60) END
 + CASE WHEN surface_m2 >= {need} THEN 22 ELSE greatest(0, 18 - ({need} - surface_m2) / {need} * 55) END + CASE WHEN ch >= {p["chambres_ideal"]} THEN 16 WHEN ch >= {p["chambres_min"]} THEN 11 ELSE 2 END + {kind})::DOUBLE, 0)::INTEGER))"""


_Z = "' ' || regexp_replace(lower(title || ' ' || commune), '[^a-z0-9]+', ' ', 'g')"
PROFILE_SCORES = f"""
WITH {LISTING_SQL}, c AS (SELECT *, coalesce(bedrooms, greatest(rooms - 1, 0)) AS ch, {_Z} AS z FROM listing),
 s AS (SELECT id, {_score_sql(SCORED["one"], "CASE WHEN z LIKE '%brand 1%' THEN 30 WHEN z LIKE '%brand 2%' OR z LIKE '%brand 3%' THEN 26 ELSE 4 END")} AS a, {_score_sql(SCORED["two"], "CASE WHEN z LIKE '%brand 4%' THEN 30 ELSE 4 END")} AS b FROM c)
SELECT id, CASE WHEN greatest(a, b) < 45 THEN NULL WHEN a >= b THEN 'one' ELSE 'two' END AS best_profile, CASE WHEN greatest(a, b) < 45 THEN 0 ELSE greatest(a, b) END AS best_score FROM s"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("key", entity.fingerprint(*[F.col(c) for c in ("commune", "property_type", "surface_m2", "rent_eur", "rooms", "title")]))
    return entity.groups_by_key(rows, "key", "id", F.col("score")).select("id", "key", "group_size", "group_rank", "canonical_id", "is_canonical")


DUPLICATE_KEYS = f"""
WITH {LISTING_SQL}, k AS (SELECT id, score, concat_ws('|', commune, property_type, round_even(surface_m2 / 5, 0)::BIGINT * 5, round_even(rent_eur / 50.0::DOUBLE, 0)::BIGINT * 50, rooms,
  array_to_string(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 2)[1:6], ' ')) AS key FROM listing)
SELECT id, key, count(*) OVER (PARTITION BY key) AS group_size, row_number() OVER (PARTITION BY key ORDER BY id) AS group_rank, first_value(id) OVER (PARTITION BY key ORDER BY score DESC, id DESC) AS canonical_id,
 first_value(id) OVER (PARTITION BY key ORDER BY score DESC, id DESC) = id AS is_canonical FROM k"""


def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("key", entity.audit_fingerprint(F.col("commune"), F.col("property_type"), (F.floor(F.col("rent_eur") / 600) * 600).cast("int"), F.lit(50), F.lit(2), F.split("title", " ")[0]))
    return entity.duplicate_audit(rows, "key", "source_site").select("key", "size", F.array_join("sources", ",").alias("sources"), "cross_source")


DUPLICATE_AUDIT = f"""
WITH {LISTING_SQL}, k AS (SELECT source_site, concat_ws('|', replace(lower(commune), '#', ' '), lower(property_type), CASE WHEN rent_eur < 600 THEN '?' ELSE (rent_eur // 600 * 600)::VARCHAR END, '50', '2', string_split(title, ' ')[1]) AS key FROM listing)
SELECT key, count(*) AS size, array_to_string(list_sort(list_distinct(list(source_site))), ',') AS sources, count(DISTINCT source_site) > 1 AS cross_source FROM k GROUP BY 1 HAVING count(*) >= 2"""


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the smallest id among those with the same text: copies folded by hash before any shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    lows = d.groupBy("h").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return d.join(lows, "h", "left").select("doc_id", F.coalesce("b", "doc_id").alias("root"))


EXACT_COPIES = "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS root FROM documents"


def linked_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts that large returned items link, directly or through others: components of a real graph, with
    its paths, cycles and hubs."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select("l_orderkey", "l_partkey")
    edges = items.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    named = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 12, "0"))
    return components(edges.select(named("c", "o_custkey").alias("a"), named("p", "l_partkey").alias("b"))).select("node", "root")


LINKED_RETURNS = """
WITH RECURSIVE l AS (SELECT DISTINCT 'c' || lpad(o_custkey::VARCHAR, 12, '0') AS u, 'p' || lpad(l_partkey::VARCHAR, 12, '0') AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 48),
 e AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r(node, low) AS (SELECT u, u FROM e UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node WHERE r.low < e.v)
SELECT node, min(low) AS root FROM r GROUP BY 1"""


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of listings, of which one in ten shares its address with others, by address and by decided pairs of a block.

    Titles are compared by Ratcliff-Obershelp, so SQL has no equal; the tests hold operator and query against
    all pairs, and ``duplicate_families`` against SQL."""
    shared = F.concat(F.lit("http://x.example/of/"), F.expr("cast(id as int) - cast(id as int) % 40"))
    rows = listings(spark, sf_dir).withColumn("url", F.when(F.expr("cast(id as int) % 10 = 0"), shared).otherwise(F.concat(F.lit("http://x.example/"), "id")))
    out = entity.duplicate_groups(rows, entity.duplicate_edges(rows))
    return out.select("group_id", "decision", "confidence", "canonical_id", F.array_join("member_ids", ",").alias("members"))


#: Members of a family of five by their place k: 0 and 1 are alike, 2 differs in title and price, 3 in rooms, and 4 shares the
#: address of 3; in every third family 2 is far off in price, in every fourth 3 and 4 have addresses of their own.
_FAMILY = {
    "g": "cast(floor(n / 5) as int)", "k": "n % 5", "commune": "concat('Commune ', cast(floor(n / 5) as {text}))", "property_type": "'appartement'", "source_site": "concat('src', cast(n % 5 as {text}))",
    "title": "CASE WHEN n % 5 = 2 THEN 'wwww' ELSE 'bcd fgh jkl' END", "rent_eur": "cast(1000 + CASE WHEN n % 5 = 2 THEN CASE WHEN floor(n / 5) % 3 = 0 THEN 500 ELSE 40 END ELSE 0 END as int)", "surface_m2": "cast(50 as double)",
    "rooms": "CASE WHEN n % 5 >= 3 THEN n % 5 ELSE 2 END", "url": "concat('http://x.example/', cast(CASE WHEN n % 5 = 4 AND floor(n / 5) % 4 > 0 THEN n - 1 ELSE n END as {text}))",
}


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir).select("id", F.lpad("id", 9, "0").alias("wide"), "description", "score", "image_url", F.expr("cast(id as int)").alias("n"))
    return d.withColumns({c: F.expr(e.replace("{text}", "string")) for c, e in _FAMILY.items()}).withColumn("id", F.col("wide"))


def duplicate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups among families of listings whose likeness is known."""
    rows = _families(spark, sf_dir)
    out = entity.duplicate_groups(rows, entity.duplicate_edges(rows))
    return out.select("group_id", "decision", "confidence", "canonical_id", F.array_join("member_ids", ",").alias("members"), F.array_join("sources", ",").alias("sources"))


DUPLICATE_FAMILIES = f"""
WITH {LISTING_SQL}, p AS (SELECT lpad(id, 9, '0') AS id, description, score, id::INT AS n FROM listing), f AS (SELECT id, description, score, {", ".join(f"{e.replace('{text}', 'VARCHAR')} AS {c}" for c, e in _FAMILY.items())} FROM p),
 m AS (SELECT *, CASE WHEN k < 2 OR k = 2 AND g % 3 > 0 THEN 'alike' WHEN k > 2 AND g % 4 > 0 THEN 'address' END AS kind FROM f),
 s AS (SELECT g, kind, count(*) AS n, bool_or(k = 2) AS odd, list_sort(list(id)) AS ids, list_sort(list(source_site)) AS sources, arg_max(id, (length(description), score, id)) AS canonical_id FROM m WHERE kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
 c AS (SELECT s.*, (SELECT count(*) FROM f WHERE f.g = s.g AND f.k < 2) AS alike FROM s)
SELECT 'D' || lpad((row_number() OVER (ORDER BY ids[1]))::VARCHAR, greatest(4, length((row_number() OVER (ORDER BY ids[1]))::VARCHAR))::INT, '0') AS group_id, CASE WHEN odd AND kind = 'alike' THEN 'needs_review' ELSE 'auto_duplicate' END AS decision,
 CASE WHEN kind = 'alike' AND alike = 2 THEN 1.0 WHEN kind = 'alike' THEN round_even(0.26 + 0.24 * (1 - 40 / 1040.0::DOUBLE) + 0.22 + 0.08, 3) ELSE 0.95 END::DOUBLE AS confidence, canonical_id, array_to_string(ids, ',') AS members, array_to_string(list_sort(list_distinct(sources)), ',') AS sources FROM c"""


def shown_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of the families with its group, its role there, and whether it is shown."""
    rows = _families(spark, sf_dir)
    return entity.annotate(rows, entity.duplicate_groups(rows, entity.duplicate_edges(rows))).select("id", "group_id", "dedup_decision", "role", "display_canonical")


SHOWN_DUPLICATES = f"""
WITH g AS ({DUPLICATE_FAMILIES}), m AS (SELECT unnest(string_split(members, ',')) AS id, group_id, decision, canonical_id FROM g)
SELECT lpad(p_partkey::VARCHAR, 9, '0') AS id, group_id, decision AS dedup_decision, CASE WHEN m.id = canonical_id THEN 'canonical' WHEN m.id IS NOT NULL THEN 'duplicate_or_variant' END AS role,
 NOT coalesce(decision = 'auto_duplicate' AND m.id <> canonical_id, false) AS display_canonical FROM part LEFT JOIN m ON m.id = lpad(p_partkey::VARCHAR, 9, '0')"""


QUERIES = {
    f.__name__: f
    for f in (
        market_reference, group_medians, exclusive_quartiles, opportunity, default_scores, saved_searches, new_alerts, watch_notices, profile_matches, profile_scores,
        duplicate_keys, duplicate_audit, exact_copies, linked_returns, duplicate_groups, duplicate_families, shown_duplicates,
    )
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n != "duplicate_groups"}

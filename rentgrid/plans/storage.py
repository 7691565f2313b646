"""Files, feeds and versions of tables: written from the driver's tables into the shared folder, and read back."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.operators import tables
from rentgrid.operators.lineage import shared_dir
from rentgrid.plans.stand_in import LISTING_SQL, listings, table
from rentgrid.sources import documents, files, pages, recovery


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings' images against stored files: pages by the remainder of their number, a few of them cut short."""
    path = _folder(spark, "images")
    html = F.when(F.col("page_id") % 53 < 5, F.left("html", F.lit(3))).otherwise(F.col("html"))
    bins = table(spark, sf_dir, "pages").select((F.col("page_id") % 53).alias("bin"), html.alias("html"))
    bins.repartition("bin").write.partitionBy("bin").text(path)  # a bin's rows meet in one task, so it is one file
    stored = files.sizes(spark, path, "part-*").select(F.concat(F.lit("thumbs/"), F.regexp_extract("path", r"bin=(\d+)", 1)).alias("name"), "bytes")
    n = F.expr("cast(id as int)")
    many = F.transform(F.sequence(n % 7, n % 7 + n % 4), lambda i: F.concat(F.lit("thumbs/"), (i * 9).cast("string")))
    rows = listings(spark, sf_dir).withColumns({"local_image_urls": F.when(n % 5 > 0, many), "local_image_url": F.when(n % 3 == 0, F.concat(F.lit("thumbs/"), (n % 7 * 9).cast("string")))})
    q = files.image_quality(rows, stored)
    return q.select("id", "status", "local_count", "valid_local_count", "bytes", F.array_join("issues", ",").alias("issues"))


IMAGE_QUALITY = f"""WITH {LISTING_SQL}, f AS (SELECT page_id % 53 AS bin, sum(1 + CASE WHEN page_id % 53 < 5 THEN strlen(left(html, 3)) ELSE strlen(html) END)::BIGINT AS bytes FROM pages GROUP BY 1),
 l AS (SELECT id, id::INT AS n FROM listing), p AS (SELECT id, n, unnest(CASE WHEN n % 5 > 0 THEN range(n % 7, n % 7 + n % 4 + 1) WHEN n % 3 = 0 THEN [n % 7] END) * 9 AS bin FROM l),
 j AS (SELECT p.id, f.bytes, CASE WHEN f.bin IS NULL THEN 'missing_file' WHEN f.bytes < 2048 THEN 'too_small' WHEN f.bytes > 900000 THEN 'heavy_image' END AS issue FROM p LEFT JOIN f USING (bin)),
 g AS (SELECT id, count(*) AS c, count(*) FILTER (issue IS NULL) AS v, coalesce(sum(bytes), 0)::BIGINT AS b, array_to_string(list_sort(list_distinct(list(issue) FILTER (issue IS NOT NULL))), ',') AS i FROM j GROUP BY 1)
SELECT l.id, CASE WHEN coalesce(v, 0) = 0 THEN 'no_valid_local_image' WHEN coalesce(i, '') <> '' THEN 'partial' ELSE 'ok' END AS status, coalesce(c, 0)::INT AS local_count, coalesce(v, 0) AS valid_local_count, coalesce(b, 0) AS bytes, coalesce(i, '') AS issues FROM l LEFT JOIN g ON l.id = g.id"""

_ITEM = """concat('<item><m:link>other</m:link><link>http://f.example/', id, '/x?a=1&amp;b=2</link><title>', CASE n % 3 WHEN 0 THEN '<![CDATA[Location <b>T3</b> & plus]]>' WHEN 1 THEN concat('Location &lt;i&gt;F', cast(rooms as {text}), '&lt;/i&gt;&#233;') ELSE 'Vente' END,
 '</title><description>', CASE n % 2 WHEN 0 THEN concat('Loyer ', cast(rent_eur as {text}), ' &#8364; &#x2014; ', cast(area as {text}), ' m² à Saint-Paul') ELSE '<![CDATA[sans prix]]>' END, '</description><!-- <item> --></item>')"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds of twenty listings with CDATA, entities, namespaces and comments; every seventh feed breaks off."""
    d = listings(spark, sf_dir).withColumns({"n": F.expr("cast(id as int)"), "area": F.expr("cast(surface_m2 as int)")}).withColumn("item", F.expr(_ITEM.replace("{text}", "string")))
    feed = F.floor(F.col("n") / 20)
    whole = d.groupBy(feed.alias("feed")).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"])).alias("items"))
    xml = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:m="http://m.example/"><channel><title>Location</title>'), "items", F.when(F.col("feed") % 7 == 0, "</chan").otherwise("</channel></rss>"))
    return pages.rss_items(whole.select(xml.alias("html")), "feed").select("url", "source_id", "title", "city", "price", "surface", "rooms")


FEED_ITEMS = f"""WITH {LISTING_SQL} SELECT 'http://f.example/' || id || '/x?a=1&b=2' AS url, id AS source_id, CASE id::INT % 3 WHEN 0 THEN 'Location T3 & plus' ELSE 'Location F' || rooms || ' é' END AS title,
 CASE WHEN id::INT % 2 = 0 THEN 'Saint-Paul' END AS city, CASE WHEN id::INT % 2 = 0 THEN rent_eur END::BIGINT AS price, CASE WHEN id::INT % 2 = 0 THEN surface_m2 END::DOUBLE AS surface, NULL::INT AS rooms
FROM listing WHERE id::INT % 3 < 2 AND (id::INT // 20) % 7 > 0"""


#: Listings' own pages by their number: structured data beside the agency's, meta tags, a map, an address in prose, a far place.
_PAGE = """CASE n % 5 WHEN 0 THEN concat('<script type="application/ld+json">[{"@type":"RealEstateAgent","address":{"streetAddress":"1 avenue Autre"},"geo":{"latitude":-21.0,"longitude":55.3}},{"@type":"Apartment","address":{"streetAddress":"', id,
  ' rue Pasteur","postalCode":"97400","addressLocality":"Saint-Denis"},"geo":{"latitude":"-20.9","longitude":"55.4"},"numberOfRooms":', cast(rooms as {text}), ',"image":["http://i/1","http://i/2","http://i/1"]}]</script>')
 WHEN 1 THEN '<meta property="og:latitude" content="-21.25"><meta content="55.5" property="og:longitude"><meta name="og:locality" content="Saint-Paul">' WHEN 2 THEN '<a href="https://maps.example/?q=-21.1,55.6">plan</a>'
 WHEN 3 THEN concat('<div class="bloc description">Appartement situé ', cast(1 + n % 90 as {text}), ' rue des Lilas, quartier calme, au 3ème étage avec ascenseur, charges : ', cast(20 + n % 50 as {text}), ' € par mois, proche de tout commerce.</div>')
 ELSE '<a href="https://maps.example/?q=48.8,2.3">Paris</a>' END"""


def located_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where listings' pages say they are, how precisely, and what told it."""
    d = listings(spark, sf_dir).withColumn("n", F.expr("cast(id as int)"))
    p = pages.page_details(d.select(F.col("id").alias("url"), F.expr(_PAGE.replace("{text}", "string")).alias("html")))
    return p.select(F.col("url").alias("id"), "address", "street", "lat", "lon", "postal_code", "locality", "bedrooms", F.size("images").alias("n_images"), "floor", "has_elevator", "charges_eur", "precision", "geo_source")


LOCATED_PAGES = f"""WITH {LISTING_SQL}, l AS (SELECT *, id::INT AS n, id::INT % 5 AS k FROM listing)
SELECT id, CASE WHEN k = 3 THEN (1 + n % 90) || ' rue des Lilas' END AS address, CASE k WHEN 0 THEN id || ' rue Pasteur' WHEN 3 THEN 'rue des Lilas' END AS street, CASE k WHEN 0 THEN -20.9 WHEN 1 THEN -21.25 WHEN 2 THEN -21.1 END::DOUBLE AS lat,
 CASE k WHEN 0 THEN 55.4 WHEN 1 THEN 55.5 WHEN 2 THEN 55.6 END::DOUBLE AS lon, CASE WHEN k = 0 THEN '97400' END AS postal_code, CASE k WHEN 0 THEN 'Saint-Denis' WHEN 1 THEN 'Saint-Paul' END AS locality, CASE WHEN k = 0 THEN rooms END::INT AS bedrooms,
 CASE WHEN k = 0 THEN 2 ELSE 0 END::INT AS n_images, CASE WHEN k = 3 THEN '3e etage' END AS floor, CASE WHEN k = 3 THEN 1 END::INT AS has_elevator, CASE WHEN k = 3 THEN 20 + n % 50 END::INT AS charges_eur,
 CASE k WHEN 0 THEN 'rue' WHEN 3 THEN 'adresse_exacte' WHEN 4 THEN 'inconnu' ELSE 'point_carte' END AS precision, ['jsonld', 'meta', 'carte', 'texte', 'aucun'][k + 1] AS geo_source FROM l"""


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings read back from documents of fifty: wrapped lists, bare lists, and lists with nulls beside a head."""
    path = _folder(spark, "documents")
    d = listings(spark, sf_dir).withColumn("n", F.expr("cast(id as int)"))
    one = F.to_json(F.struct("id", "title", "rent_eur"))
    docs = d.groupBy(F.floor(F.col("n") / 50).alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("items"))
    form = F.col("doc") % 3
    text = F.when(form == 0, F.concat(F.lit('{"listings":['), "items", F.lit("]}"))).when(form == 1, F.concat(F.lit("["), "items", F.lit("]"))).otherwise(F.concat(F.lit('{"meta":{"n":1},"listings":[null,'), "items", F.lit(",null]}")))
    docs.select("doc", text.alias("value")).write.partitionBy("doc").text(path)
    return documents.listings(spark, f"{path}/doc=*", T.StructType.fromDDL("id string, title string, rent_eur int")).select("id", "title", "rent_eur")


SCANNED_DOCUMENTS = f"WITH {LISTING_SQL} SELECT id, title, rent_eur FROM listing"


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table's manifests say and its readers see over a life: first version, a batch appended twice, a version that is
    never published, one that is refused, and a step back."""
    rows = listings(spark, sf_dir).select("id", "source_site", "rent_eur", "is_active")
    t = tables.VersionedTable(spark, _folder(spark, "table"))
    on = rows.where("is_active = 1")
    seen: list[tuple[str, int, int, int, str]] = []

    def look(step: str) -> None:
        m = t.manifest()
        r = t.read().agg(F.count("*").alias("n"), F.sum("rent_eur").alias("rent")).head()
        seen.append((step, m["rows"], r.n, r.rent, ",".join(m["batches"])))

    t.publish(t.stage(on.where("source_site != 'src0'"), "base"))
    look("1 base")
    for _ in range(2):
        t.append(on.where("source_site = 'src0'"), "late")
    look("2 appended")
    t.stage(on.limit(0), "lost")
    look("3 crashed")
    try:
        t.publish(t.stage(on.where("source_site != 'src1'"), "thin"), critical=("src1",))
    except tables.Conflict:
        look("4 refused")
    t.roll_back()
    look("5 back")
    return spark.createDataFrame(seen, "step string, rows long, read long, rent long, batches string")


TABLE_VERSIONS = f"""WITH {LISTING_SQL}, o AS (SELECT * FROM listing WHERE is_active = 1), a AS (SELECT count(*) AS n, sum(rent_eur)::BIGINT AS r FROM o), b AS (SELECT count(*) AS n, sum(rent_eur)::BIGINT AS r FROM o WHERE source_site <> 'src0')
SELECT '1 base' AS step, n AS rows, n AS read, r AS rent, 'base' AS batches FROM b UNION ALL SELECT s, n, n, r, 'base,late' FROM a, (VALUES ('2 appended'), ('3 crashed'), ('4 refused')) v(s) UNION ALL SELECT '5 back', n, n, r, 'base' FROM b"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of three sources, one of which fails, one finds nothing, and one is logged twice."""
    log = tables.VersionedTable(spark, _folder(spark, "runs"), "source")
    at = datetime.datetime(2024, 1, 1)
    rows = listings(spark, sf_dir)
    for _ in range(2):
        tables.logged_run(log, "part", at, lambda: rows.where("score > 50"))
    tables.logged_run(log, "none", at, lambda: rows.where("score < 0"))
    tables.logged_run(log, "gone", at, lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet"))
    return log.read().select("source", "statut", "n_rows", F.col("structure_hash").isNotNull().alias("hashed"), F.col("error").contains("no-such-table").alias("told"))


RUN_LOG = f"""WITH {LISTING_SQL} SELECT 'part' AS source, 'ok' AS statut, count(*) AS n_rows, true AS hashed, NULL::BOOLEAN AS told FROM listing WHERE score > 50
 UNION ALL SELECT 'none', 'empty', 0, false, NULL UNION ALL SELECT 'gone', 'error', 0, false, true"""


def manifest_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings(spark, sf_dir)
    n = F.expr("cast(id as int)")
    d = d.withColumns({"source": F.when(n % 6 > 0, F.col("source_site")).otherwise(""), "display_canonical": F.when(n % 4 == 0, False).when(n % 4 == 1, True), "local_image_url": F.nullif("image_url", F.lit("")), "local_image_urls": F.when(n % 3 > 0, F.slice(F.split("title", " "), 1, F.least(F.col("rooms"), F.lit(3))))})
    return tables.manifest_figures(d.drop("source_site"), d.groupBy("commune").count())


MANIFEST_FIGURES = f"""WITH {LISTING_SQL}, l AS (SELECT *, id::INT AS n FROM listing) SELECT 'listing_count' AS figure, '' AS key, count(*) AS n FROM l UNION ALL SELECT 'visible_listing_count', '', count(*) FILTER (n % 4 > 0) FROM l
 UNION ALL SELECT 'local_primary_photos', '', count(*) FILTER (image_url <> '') FROM l UNION ALL SELECT 'local_multi_galleries', '', count(*) FILTER (n % 3 > 0 AND rooms > 1) FROM l
 UNION ALL SELECT 'source_count', CASE WHEN n % 6 > 0 THEN source_site ELSE 'unknown' END, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'dedup_group_count', '', count(DISTINCT commune) FROM l"""

#: What is stored of a listing by its source, and what has to be recovered from it.
_PROSE = "concat('Bel appartement numéro ', id, ' lumineux et calme, proche des écoles et des commerces, avec une vue dégagée sur la mer et un grand jardin partagé')"
_STORED = {
    "html": """CASE n % 7 WHEN 1 THEN concat('<script type="application/ld+json">[{"@type":"Other","description":"no"},{"@type":"RealEstateListing","description":"', prose, '. Voir moins"}]</script>')
      WHEN 3 THEN concat('<meta name="description" content="short"><div><div class="bloc descriptif x"><p>', prose, '</p></div></div>') WHEN 4 THEN concat('<meta name="description" content="Meta ', id, '"><b>Dépôt de garantie</b> : 900 €')
      WHEN 5 THEN concat('<meta property="og:description" content="', prose, '">') WHEN 6 THEN concat('<meta name="description" content="de e"><div class="property__description-content">', prose, '</div>') ELSE '' END""",
    "payload": "CASE n % 7 WHEN 2 THEN concat('{\"id\":1,\"description\":\"<p>', prose, '</p> Géorisques: voir le site\"}') WHEN 5 THEN CASE n % 2 WHEN 0 THEN concat('{\"content\":\"', prose, ' Nos tarifs en ligne\"}') ELSE 'no json' END END",
    "text": "CASE n % 7 WHEN 0 THEN concat('T2 900 € CC Saint-Paul (97460) ', prose) END",
}
_RULES = {"src0": "card", "src1": "structured", "src2": "offer", "src3": "block", "src4": "price_details", "src5": "content", "src6": "content_block"}


def recovered_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of listings of seven sources, each by its source's rule."""
    d = listings(spark, sf_dir).withColumn("n", F.expr("cast(id as int)")).withColumn("prose", F.expr(_PROSE))
    d = d.select("id", F.concat(F.lit("src"), (F.col("n") % 7).cast("string")).alias("source"), *[F.expr(e).alias(c) for c, e in _STORED.items()])
    return recovery.recovered(d, _RULES).select("id", "source", "method", "recovered")


RECOVERED_DESCRIPTIONS = f"""WITH {LISTING_SQL}, l AS (SELECT id, id::INT AS n, {_PROSE} AS prose FROM listing)
SELECT id, 'src' || n % 7 AS source, ['card', 'structured', 'offer', 'block', 'price_details', 'content', 'content_block'][n % 7 + 1] AS method,
 CASE n % 7 WHEN 1 THEN prose || '.' WHEN 4 THEN 'Meta ' || id || ' Dépôt de garantie : 900 €' ELSE prose END AS recovered FROM l"""

QUERIES = {f.__name__: f for f in (image_quality, feed_items, recovered_descriptions, located_pages, scanned_documents, table_versions, run_log, manifest_figures)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}

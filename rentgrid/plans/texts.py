"""Documents and stored pages: normalisation, contact data, addresses and facts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import extract as X
from rentgrid.functions import text as T
from rentgrid.plans.stand_in import table
from rentgrid.sources import pages as P


def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts in two dialects."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.norm_alnum(F.col("text"))).alias("alnum"), F.md5(T.norm_keep_accents(F.col("text"))).alias("accents"))


NORMALISED_TEXTS = """SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'))) AS alnum,
 md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://', '', 'g'), '[^a-z0-9àâäéèêëîïôöùûüç]+', ' ', 'g'))) AS accents FROM documents"""


def emails_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(X.EMAIL)).alias("emails")).where("emails > 0")


EMAILS_IN_TEXTS = r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS emails FROM documents WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')"


def public_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without contact data; the phone pattern looks behind, which DuckDB's patterns can't."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.public_text(F.col("text")).alias("text"))


def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("m", X.masked_contacts(F.col("text")))
    return d.select("doc_id", "m.text", "m.emails", "m.phones")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.canonical_url(F.col("url")).alias("url"), X.url_part(F.col("url"), "HOST").alias("host"), F.size(X.links(F.col("html"))).alias("n_links"))


PAGE_LINKS = """SELECT page_id, trim(regexp_replace(translate(lower(rtrim(split_part(split_part(url, '#', 1), '?', 1), '/')), '-_''', '   '), '\\s+', ' ', 'g')) AS url, regexp_extract(url, '://([^/?#]+)', 1) AS host,
 len(list_distinct(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1))) AS n_links FROM pages"""


def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read as a listing's own page."""
    return P.detail_pages(table(spark, sf_dir, "pages"), "pages")


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_details(table(spark, sf_dir, "pages")).select("url", "precision", "geo_source", F.length("description_full").alias("n_description"), F.size("images").alias("n_images"))


def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("key", X.canonical_url(F.col("url")))
    return p.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")


DUPLICATE_PAGES = """SELECT key, count(*) AS n, min(page_id) AS "first" FROM (SELECT page_id, trim(regexp_replace(translate(lower(rtrim(split_part(split_part(url, '#', 1), '?', 1), '/')), '-_''', '   '), '\\s+', ' ', 'g')) AS key FROM pages) GROUP BY 1 HAVING count(*) > 1"""

QUERIES = {f.__name__: f for f in (normalised_texts, emails_in_texts, public_texts, masked_texts, page_links, page_listings, page_facts, duplicate_pages)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}

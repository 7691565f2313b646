"""Listings and run logs made of the driver's tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = {
    "id": "cast(p_partkey as string)",
    "source_site": "concat('src', cast(p_partkey % 7 as string))",
    "source_id": "cast(p_partkey as string)",
    "title": "concat(p_name, ' T', cast(1 + p_size % 5 as string), ' ', lower(p_type))",
    "commune": "p_brand",
    "property_type": "p_type",
    "rent_eur": "cast(500 + (p_partkey * 37) % 1100 as int)",
    "surface_m2": "cast(p_size * 2 + 15 as double)",
    "rooms": "cast(1 + p_size % 5 as int)",
    "bedrooms": "case when p_partkey % 3 = 0 then null else cast(p_size % 4 as int) end",
    "image_url": "case when p_partkey % 5 = 0 then '' else concat('http://img.example/', cast(p_partkey as string), '.jpg') end",
    "description": "concat(p_name, ' proche ', p_brand, case when p_partkey % 4 = 0 then ' avec jardin' else '' end)",
    "url": "concat('http://x.example/', cast(p_partkey % 500 as string), '/?ref=', cast(p_partkey % 3 as string), '#top')",
    "is_active": "case when p_partkey % 11 = 0 then 0 else 1 end",
    "furnished": "case p_partkey % 3 when 0 then 'Meublé' when 1 then 'Non meublé' else 'Non précisé' end",
    "score": "cast(p_partkey % 97 as int)",
}
LISTING_SQL = "listing AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LISTING.items()) + " FROM part)"

#: One run a day and source of the event log; a few of them failed or saw little.
RUN = {
    "id": "min(event_id)",
    "source": "event_type",
    "ran_at": "max(ts)",
    "statut": "case when min(event_id) % 9 = 0 then 'error' else 'ok' end",
    "n_rows": "count(*)",
    "structure_hash": "case when min(event_id) % 5 = 0 then 'h2' else 'h1' end",
}
RUN_SQL = "run AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RUN.items()) + " FROM events GROUP BY event_type, cast(ts as date))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless}) if zoneless else df


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in LISTING.items()])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(*[F.expr(x).alias(n) for n, x in RUN.items() if n != "source"]).withColumnRenamed("event_type", "source").drop("day")

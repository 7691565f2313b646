"""Listing documents and tables.  Paths go through Spark's readers only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.functions import numbers as N
from rentgrid.functions import text as X

#: The public listing contract; every field may be null.
CONTRACT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "source", "source_id", "url")]
    + [T.StructField(n, T.DoubleType()) for n in ("price", "surface")]
    + [T.StructField(n, T.StringType()) for n in ("type", "city", "district", "location", "region")]
    + [T.StructField(n, T.DoubleType()) for n in ("rooms", "bedrooms")]
    + [T.StructField(n, T.StringType()) for n in ("furnished", "image_url", "local_image_url")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("image_urls", "local_image_urls")]
    + [T.StructField("display_canonical", T.BooleanType()), T.StructField("canonical_display_id", T.StringType())]
)


def listings(spark: SparkSession, path: str, schema: T.StructType | None = None, bare: bool = True) -> DataFrame:
    """Rows of a document {meta, listings: [..]}, or of a bare list if ``bare``; what is no object is dropped.

    With a schema nothing is inferred.  A document's list is exploded in the scan's own stage."""
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if schema is not None:
        read = read.schema(T.StructType([*schema.fields, T.StructField("listings", T.ArrayType(schema))]) if bare else T.StructType([T.StructField("listings", T.ArrayType(schema))]))
    df = read.json(path)
    rest = [c for c in df.columns if c not in ("listings", "_corrupt_record")]
    if "listings" not in df.columns:
        return df.select(*rest)
    inner = df.where(F.col("listings").isNotNull()).select(F.explode("listings").alias("l")).where("l is not null").select("l.*")
    plain = [c for c in rest if c in inner.columns]
    if not bare or not plain:
        return inner
    some = F.coalesce(*[F.col(c).isNotNull().cast("int") for c in plain[:1]])
    for c in plain[1:]:
        some = some + F.col(c).isNotNull().cast("int")
    own = df.where(F.col("listings").isNull() & (some > 0)).select(*plain)
    return inner.unionByName(own, allowMissingColumns=True)


def active(df: DataFrame) -> DataFrame:
    """Rows that are active; an unknown flag is active."""
    return df.where(F.coalesce(F.col("is_active"), F.lit(1)) == 1) if "is_active" in df.columns else df


def with_image(df: DataFrame) -> DataFrame:
    return df.where(F.trim("image_url") != "")


def product_view(raw: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Raw rows with their enrichment, both by (source_site, source_id)."""
    keys = ["source_site", "source_id"]
    return raw.join(enrichment.drop(*[c for c in enrichment.columns if c in raw.columns and c not in keys]), keys, "left")


def recent_first(df: DataFrame, at: str, *tie: str) -> DataFrame:
    return df.orderBy(F.desc(at), *tie)


def latest_file(df: DataFrame) -> DataFrame:
    """The rows of the file last modified among those a frame was read from."""
    m = F.struct("_metadata.file_modification_time", "_metadata.file_path")
    last = df.select(m.alias("m")).agg(F.max("m").alias("m")).select("m.file_path")  # one row
    return df.withColumn("_path", F.col("_metadata.file_path")).join(F.broadcast(last.withColumnRenamed("file_path", "_path")), "_path", "left_semi").drop("_path")


def sidecar(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file of a known schema; nothing if it is missing, and null fields for broken records."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def public_contract(df: DataFrame) -> DataFrame:
    """Technical or public rows in the public contract: both dialects of field names, images with the
    primary one first, shown unless said otherwise."""
    s = lambda *ns: F.coalesce(F.trim(N.first_present(df, *ns)), F.lit(""))
    num = lambda *ns: N.number_or_none(N.first_present(df, *ns))

    def images(many: str, one: Column) -> Column:
        kind = dict(df.dtypes).get(many, "")
        given = F.coalesce(F.col(many), F.array()) if kind.startswith("array") else F.array_compact(F.array(F.nullif(N.column(df, many), F.lit(""))))
        clean = F.filter(F.transform(given.cast("array<string>"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when((one != "") & ~F.array_contains(clean, one), F.concat(F.array(one), clean)).otherwise(clean)

    primary, local = s("image_url"), s("local_image_url")
    return df.select(
        s("id").alias("id"), s("source", "source_site").alias("source"), s("source_id").alias("source_id"), s("url", "source_url").alias("url"),
        num("price", "rent_eur").alias("price"), num("surface", "surface_m2").alias("surface"), s("type", "property_type", "property_type_normalized").alias("type"),
        s("city", "commune").alias("city"), s("district").alias("district"), s("location", "location_label", "primary_zone").alias("location"), s("region").alias("region"),
        num("rooms").alias("rooms"), num("bedrooms").alias("bedrooms"), s("furnished").alias("furnished"), primary.alias("image_url"), local.alias("local_image_url"),
        images("image_urls", primary).alias("image_urls"), images("local_image_urls", local).alias("local_image_urls"),
        F.coalesce(N.column(df, "display_canonical", "boolean").cast("boolean"), F.lit(True)).alias("display_canonical"), s("canonical_display_id").alias("canonical_display_id"),
    )


def photo_list(df: DataFrame) -> Column:
    """All images of a row, lists before single ones and local before remote, each once."""
    many = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("local_image_urls", "image_urls") if c in df.columns]
    one = [F.col(c) for c in ("local_image_url", "image_url") if c in df.columns]
    return F.filter(F.array_distinct(F.transform(F.array_compact(F.concat(*many, F.array(*one))), lambda x: F.trim(x))), lambda x: x != "")


def fingerprints(hashes: Column) -> Column:
    """Given image hashes that are 16 hexadecimal digits, lower-cased."""
    return F.filter(F.transform(hashes, lambda x: F.lower(F.trim(x))), lambda x: x.rlike("^[0-9a-f]{16}$"))


def url_fingerprint(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(16))


def importable(df: DataFrame, rows: int = 10, prices: int = 10, generated_at: Column | None = None, now: Column | None = None, max_age_hours: float | None = None) -> DataFrame:
    """(rows, prices, age_hours, ok): whether an artifact may be imported; checked before anything is written."""
    out = df.agg(F.count("*").alias("rows"), F.count_if(N.parse_int(N.first_present(df, "prix", "rent_eur", "price")) > 0).alias("prices"), *([F.max(N.hours_between(generated_at, now)).alias("age_hours")] if generated_at is not None and now is not None else [F.lit(None).cast("double").alias("age_hours")]))
    fresh = (F.col("age_hours") <= max_age_hours) if max_age_hours is not None else F.lit(True)
    return out.withColumn("ok", (F.col("rows") >= rows) & (F.col("prices") >= prices) & F.coalesce(fresh, F.lit(False)))


def light_index(df: DataFrame, fields: list[str]) -> DataFrame:
    """(id, json): the fields of an index, empty ones left out."""
    kinds = dict(df.dtypes)
    kept = [N.present(F.col(c), kinds[c]).alias(c) for c in fields if c in kinds]
    return df.select(F.col("id"), F.to_json(F.struct(*kept)).alias("json"))


def documents(df: DataFrame) -> DataFrame:
    """One JSON document a row, for text or JSON sinks."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def clean_city(c: Column) -> Column:
    return X.clean(c)

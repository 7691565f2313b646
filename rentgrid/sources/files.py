"""Files as rows: sizes without their bytes, whole pages, digests, and the quality of stored images."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N


def sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files below a folder; their contents are not read.  No rows if the folder is missing."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))
    except AnalysisException:
        return spark.createDataFrame([], "path string, bytes long")


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, html): stored pages, a row each, for another reading without the network."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup="true", pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def below(path: Column, folder: str) -> Column:
    """A file's path relative to a folder, whatever the scheme it is read by."""
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    root = F.concat(F.regexp_replace(plain(F.lit(folder)), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(plain(path), root), F.substring(plain(path), F.length(root) + 1, F.lit(10_000)))


# fixed values: bytes of an image that is worth showing, and how many images are looked at
TOO_SMALL, TOO_HEAVY, LOOKED_AT = 2048, 900_000, 24


def image_quality(items: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, status, local_count, valid_local_count, bytes, issues) of items' local images; stored: (name, bytes).

    The first ``LOOKED_AT`` different paths count.  Items without images are rows too."""
    one = F.array(N.column(items, "local_image_url"))
    listed = F.coalesce(N.column(items, "local_image_urls", "array<string>"), F.array().cast("array<string>"))
    paths = F.array_distinct(F.filter(F.concat(listed, one), lambda x: x != ""))
    asked = items.select(F.col(id_col).alias("id"), F.size(paths).alias("local_count"), F.explode_outer(F.slice(paths, 1, LOOKED_AT)).alias("name"))
    sized = stored.groupBy("name").agg(F.max("bytes").alias("bytes"), F.lit(True).alias("there"))
    met = asked.join(sized, "name", "left")
    issue = F.when(F.col("name").isNull(), None).when(F.col("there").isNull(), "missing_file").when(F.col("bytes") < TOO_SMALL, "too_small").when(F.col("bytes") > TOO_HEAVY, "heavy_image")
    out = met.withColumn("issue", issue).groupBy("id").agg(
        F.max("local_count").alias("local_count"), F.count_if(F.col("there") & F.col("issue").isNull()).alias("valid_local_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.array_sort(F.collect_set("issue")).alias("issues"),
    )
    status = F.when(F.col("valid_local_count") == 0, "no_valid_local_image").when(F.size("issues") > 0, "partial").otherwise("ok")
    return out.withColumn("status", status)

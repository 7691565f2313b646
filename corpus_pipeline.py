"""The corpus pipeline: quality, near-duplicates, contamination, mixing, shards.

Each stage takes the table its predecessor wrote.  All but the last return the columns of
``documents``; the mixing stage's decision is the order of the rows it writes, which the sharding
stage reads off the table (its file names and row numbers) as its key, so that every shard is a run
of the mix.  SQL can't express the stages; the tests hold them against brute-force versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.llm import decontaminate, mixing, quality, sharding, simhash_dedup
from rentgrid.llm._common import PLACE, cut, fold, placed, read, shared_dir, small

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts, each row judged by its own text: by its place, so with a repeated or no id too."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("y"))
    mine = placed(docs)
    scored = quality.score(mine, labels, also=(PLACE,))
    bad = small(cut(scored.where("predicted = 0").select(F.col(PLACE).alias("_rg_bad"))))
    return mine.join(bad, F.col(PLACE) == F.col("_rg_bad"), "left_anti").drop(PLACE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; a row's place stands in for its id, as it is unique where that need not be."""
    numbered = placed(docs)
    plan = sharding.shard(numbered, key=F.col(PLACE), id_col=PLACE).select(F.col("doc_id").alias("_rg_at"), "shard", "slot")
    return numbered.join(plan, F.col(PLACE) == F.col("_rg_at")).drop(PLACE, "_rg_at")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", not_contaminated),
    ("mixing", mixed_to_weights),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's table is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

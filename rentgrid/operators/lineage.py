"""Cutting lineage in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset, as in tests."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="rentgrid-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Compute once into a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

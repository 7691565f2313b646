"""Helpers shared by the training-data operators: lineage cuts, shipping code, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.operators.lineage import cut, shared_dir

__all__ = ["PLACE", "cut", "fold", "placed", "read", "shared_dir", "ship", "small", "stored"]

#: Rows up to which a narrow side (a few dozen bytes a row) may be broadcast after it was counted.
BROADCAST_ROWS = 100_000
#: Name of the column that holds a row's place in its table.
PLACE = "_rg_place"


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it back.

    Unlike ``cut`` the copy is compressed and columnar, so later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rentgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame) -> DataFrame:
    """``df`` with a column ``PLACE``: each row's place in the table it is read from, in the order of the
    numbers of its files.  A frame that comes from no file is stored first, as only a table has places."""
    number = F.lpad(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1), 12, "0")
    at = F.concat_ws("/", number, F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))
    try:
        out = df.withColumn(PLACE, at)
        out.schema
    except AnalysisException:
        out = stored(df).withColumn(PLACE, at)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_rentgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="rentgrid-code-")
    target = os.path.join(folder, "rentgrid_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._rentgrid_shipped = True


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table if it has at most ``rows`` rows, else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id falls into fold 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Whitening of embeddings from a tiled covariance.

Components become integers floor(scale * c) + shift.  A first scan sums every dimension.  A second one
cuts the vectors into row blocks and column blocks of ``tile`` dimensions, less each dimension's whole
mean, as small integers.  The column blocks are stored, shuffled by row block, where every pair of
column blocks (one tile of the covariance) meets; a pair is centred by the rest of the mean and multiplied,
products are summed by tile within a task and by cell after it, and the assembled matrix, of dimensions
only, is decomposed by ``numpy.linalg.eigh``.  A last scan projects every vector.

The whitened vectors' own covariance is taken by the same tiles, and its distance from the identity is
returned with every row.

Defined results: null vectors, empty ones and vectors that hold null or non-finite components, or one of
2^40 or more, take no part; vectors of another than the commonest length (ties: the greater) take no part, as
they have no covariance with the rest; null and repeated ids are rows like any other; a component without variance
(below 1e-12 of the greatest) has null in ``whitened`` and takes no part in identity_error; an empty
table gives no rows.  ``deviation`` is exact: a long where a bound from the sums proves that it fits, else
decimal(38, 0)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.llm._common import ship, stored

#: Multiplier and shift of the integers; dimensions of a tile; rows of a block; components returned.
SCALE, SHIFT, TILE, BLOCK_ROWS, COMPONENTS = 64, 1_000_000, 32, 2048, 32
#: Least variance of a component, as a part of the greatest.
LEAST = 1e-12


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls, all of one length, as doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), dims)


@dataclass
class Fit:
    """Row count, and sum, least and greatest value of every dimension, all exact."""

    n: int
    sums: list[int]
    least: list[int]
    greatest: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s - self.n * int(w) for s, w in zip(self.sums, self.whole)]
        self.part = np.array([r / self.n for r in self.rest])  # of the mean, beyond ``whole``

    def widest(self) -> int:
        """Greatest distance of a component from its dimension's whole mean."""
        return max(max(int(g) - int(w), int(w) - int(l)) for w, l, g in zip(self.whole, self.least, self.greatest)) + 1


def taking_part(vectors: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their dimensions."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= F.lit(2.0**40)))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~bad)
    lengths = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.where(F.size(v) == lengths.d), lengths.d) if lengths else (rows, 0)


def integers(vectors: pa.Array, dims: int, scale: float, shift: int) -> np.ndarray:
    return np.floor(scale * matrix(vectors, dims)).astype(np.int64) + shift


def sums(rows: DataFrame, vec_col: str, dims: int, scale: float, shift: int) -> Fit:
    """``Fit`` of the integers: each task sums its batches, then dimensions are added up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * dims, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column(0), dims, scale, shift)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(0))]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            exact = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims), exact, pa.array(low), pa.array(high)], ["dim", "n", "total", "low", "high"])

    parts = rows.select(vec_col).mapInArrow(partial, "dim int, n long, total decimal(38,0), low long, high long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    return Fit(found[0].n, [int(r.total) for r in found], [r.low for r in found], [r.high for r in found])


def tiled(blocks: DataFrame, centre: np.ndarray, n: int, tile: int) -> np.ndarray:
    """Covariance of stored blocks (row_block, col_block, kind, cells) less ``centre``, divisor n."""
    dims = len(centre)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, kind_i, kind_j, left, right in zip(*[c.to_pylist() for c in b.columns]):
                x, y = (np.frombuffer(data, kind).reshape(-1, min(tile, dims - k * tile)) - centre[k * tile : (k + 1) * tile] for k, kind, data in ((i, kind_i, left), (j, kind_j, right)))
                product = x.T @ y
                out[i, j] = out[i, j] + product if (i, j) in out else product
        for (i, j), product in out.items():
            size = product.size
            yield pa.RecordBatch.from_arrays([pa.array([i] * size, pa.int32()), pa.array([j] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(product.ravel())], ["i", "j", "cell", "v"])

    a = blocks.select("row_block", F.col("col_block").alias("i"), F.col("kind").alias("kind_i"), F.col("cells").alias("left_cells"))
    b = blocks.select("row_block", F.col("col_block").alias("j"), F.col("kind").alias("kind_j"), F.col("cells").alias("right_cells"))
    pairs = a.join(b, "row_block").where("i <= j").select("i", "j", "kind_i", "kind_j", "left_cells", "right_cells")
    summed = pairs.mapInArrow(multiply, "i int, j int, cell int, v double").groupBy("i", "j", "cell").agg(F.sum("v").alias("v"))
    v = np.zeros((dims, dims))
    for r in summed.toLocalIterator():  # dims * (dims + tile) / 2 cells, however many rows there are
        row, col = r.i * tile + r.cell // min(tile, dims - r.j * tile), r.j * tile + r.cell % min(tile, dims - r.j * tile)
        v[row, col] = v[col, row] = r.v / n
    return v


def in_blocks(rows: DataFrame, vec_col: str, dims: int, tile: int, block_rows: int, turn=None) -> DataFrame:
    """Stored column blocks of the vectors.  ``turn`` makes what is stored of a list column; stored, so that a lost task can't pair blocks of two readings."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for low in range(0, b.num_rows, block_rows):
                own = b.column(0).slice(low, block_rows)
                x = turn(own) if turn else matrix(own, dims)
                out = [np.ascontiguousarray(x[:, k : k + tile]) for k in range(0, dims, tile)]
                n = len(out)
                columns = [pa.array([(part << 32) + seq] * n), pa.array(range(n), pa.int32()), pa.array([x.dtype.str] * n), pa.array([o.tobytes() for o in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row_block", "col_block", "kind", "cells"])
                seq += 1

    return stored(rows.select(vec_col).mapInArrow(cut_up, "row_block long, col_block int, kind string, cells binary"))


def covariance(rows: DataFrame, vec_col: str, fit: Fit, tile: int = TILE, block_rows: int = BLOCK_ROWS, scale: float = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Covariance of the integers, in tiles; cells travel in the smallest integer type that holds them."""
    dims, whole = len(fit.sums), fit.whole
    kind = np.min_scalar_type(-fit.widest())
    blocks = in_blocks(rows, vec_col, dims, tile, block_rows, lambda v: (integers(v, dims, scale, shift) - whole).astype(kind))
    return tiled(blocks, fit.part, fit.n, tile)


def real_covariance(rows: DataFrame, vec_col: str, dims: int, n: int, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Covariance of doubles, in tiles, about their own mean."""
    at = F.posexplode(vec_col).alias("at", "x")
    means = {r.at: r.m for r in rows.select(at).groupBy("at").agg(F.avg("x").alias("m")).collect()}
    return tiled(in_blocks(rows, vec_col, dims, tile, block_rows), np.array([means[k] for k in range(dims)]), n, tile)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
    tile: int = TILE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A row for each vector that takes part and each of its first ``components`` components, from the greatest variance down:
    vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark: SparkSession = vectors.sparkSession
    ship(spark)
    rows, dims = taking_part(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")), "vec")
    fit = sums(rows, "vec", dims, scale, shift) if dims else Fit(1, [0], [0], [0])
    v = covariance(rows, "vec", fit, tile, block_rows, scale, shift) if dims else np.zeros((1, 1))
    values, axes = np.linalg.eigh(v)
    count = min(components, len(values))
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    trace, live = float(np.trace(v)), int((values > LEAST * max(values[0], 0)).sum()) if values[0] > 0 else 0
    turn = axes[:, :live] / np.sqrt(values[:live])
    # (n x - S)^2 over all dimensions, at most; whole and rest of the mean give n x - S = n (x - whole) - rest
    fits = max(1, dims) * (fit.n * (fit.widest() + 1)) ** 2 < 2**63
    n, whole, part, rest = fit.n, fit.whole, fit.part, fit.rest

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, block_rows):
                own = b.slice(low, block_rows)
                d = integers(own.column(1), dims, scale, shift) - whole
                if fits:
                    deviation = pa.array(((n * d - np.array(rest, np.int64)) ** 2).sum(1))
                else:
                    deviation = pa.array([Decimal(int(x)) for x in ((n * d.astype(object) - np.array(rest, object)) ** 2).sum(1)], pa.decimal128(38, 0))
                out = (d - part) @ turn
                ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * live)
                yield pa.RecordBatch.from_arrays([own.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["vec_id", "deviation", "whitened"])

    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("deviation", T.LongType() if fits else T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = stored(rows.mapInArrow(project, schema)) if dims else spark.createDataFrame([], schema)
    error = float(np.abs(real_covariance(out, "whitened", live, n, tile, block_rows) - np.eye(live)).max()) if live else 0.0
    explained = [float(e) / trace if trace > 0 else math.nan for e in values]
    each = F.posexplode(F.array(*[F.lit(e) for e in explained])).alias("at", "share")
    return out.select("vec_id", "deviation", "whitened", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", _at("whitened", "at"),
        F.when(F.isnan("share"), None).otherwise(F.col("share")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _at(column: str, at: str) -> Column:
    """The entry of an array, null beyond its end."""
    return F.get(F.col(column), F.col(at)).alias(column)

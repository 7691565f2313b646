"""Exact top-k by inner product over a vector-approximation file.

Vectors become integers floor(scale * x).  Equal vectors are one class that keeps its ``k + 1``
smallest ids, all that any answer can name; so neither a vector that fills a third of the table nor
ties among its copies multiply any work.  The approximation file holds each class's quantised cell
in every dimension.  A scan of query blocks against file blocks bounds every score from both sides,
keeps what may still be among the best of its block, and the bounds of all blocks together give a
lower bound on the last wanted score.  Then exact vectors are read in order of the upper bound: the
best-bounded first, and of the rest only those whose bound still reaches the last wanted exact score.

Defined results: vectors that are null or empty, or hold null or non-finite components, and rows with a null
id take no part; an id that is repeated is a candidate with each of its vectors (rows that repeat both
are one) and, if asked for, gets the best scores of all of them, never its own id; vectors are compared only
with those of equal length; fewer than k candidates give fewer rows; ties go to the smaller id.
Scores must fit a signed long; block bounds are exact while scores stay below 2^53.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm._common import cut, ship, small, stored

QUERY_BLOCK, FILE_BLOCK, CHUNK = 2048, 16384, 128


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0)).where(~bad)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vec"))
    return rows.distinct()


def _codes(low: np.ndarray, width: np.ndarray, cells: int, x: np.ndarray) -> np.ndarray:
    return (x - low) * cells // width


def _bounds(low: np.ndarray, width: np.ndarray, cells: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest integer of each cell."""
    return low - (-code * width) // cells, low - (-(code + 1) * width) // cells - 1


def _ranges(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length, the smallest component and the number of values by dimension."""
    rows = classes.select(F.size("vec").alias("d"), F.posexplode("vec").alias("i", "x")).groupBy("d", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict[int, list] = {}
    for r in rows.collect():  # one row for each dimension
        out.setdefault(r.d, []).append((r.i, r.lo, r.hi))
    return {d: (np.array([x[1] for x in sorted(v)]), np.array([x[2] - x[1] + 1 for x in sorted(v)])) for d, v in out.items()}


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), len(flat) // max(1, len(col)))


def _scan(ranges, cells: int, keep: int):
    """For each query of a block the file rows whose upper bound reaches the block's keep-th lower bound."""

    def run(key, queries: pa.Table, file: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and file.num_rows:
            low, width = ranges.value[key[0].as_py()]
            lo, hi = _bounds(low, width, cells, _matrix(file["code"]))
            mid, half = ((lo + hi) / 2).T, ((hi - lo) / 2).T
            qid, cid, q = queries["qid"].to_numpy(), file["cid"].to_numpy(), _matrix(queries["vec"]).astype(float)
            for i in range(0, len(q), CHUNK):
                centre, slack = q[i : i + CHUNK] @ mid, np.abs(q[i : i + CHUNK]) @ half
                least, most = centre - slack, centre + slack
                k = min(keep, least.shape[1])
                last = np.partition(least, -k, axis=1)[:, -k]
                a, b = np.nonzero(most >= last[:, None])
                for o, x in zip(out, (qid[i : i + CHUNK][a], cid[b], least[a, b], most[a, b])):
                    o.append(x)
        cols = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["qid", "cid", "lb", "ub"])

    return run


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, cells: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query but itself.

    ``is_query`` is a predicate on the column ``id``; ``cells`` is the number of cells a dimension
    has in the file, 256 at most."""
    spark = vectors.sparkSession
    ship(spark)
    best = Window.partitionBy("vec").orderBy("id")
    rows = stored(integer_vectors(vectors, id_col, vec_col, scale))
    ranked = rows.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    classes = stored(ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("cid"), "vec", "ids"))
    asked = rows.where(is_query)
    # an id that is asked for names at most this many candidates that are no answers to it: 1 where ids are unique
    own = asked.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 1
    members = cut(asked.join(classes.select("cid", "vec"), "vec").select(F.col("cid").alias("qid"), F.col("id").alias("query_id")))
    asking = cut(members.select(F.col("qid").alias("cid")).distinct().join(classes.select("cid", "vec"), "cid").select(F.col("cid").alias("qid"), "vec"))

    ranges = spark.sparkContext.broadcast(_ranges(classes))
    n_file, n_query = classes.count(), asking.count()
    file_blocks = max(math.ceil(n_file / FILE_BLOCK), min(spark.sparkContext.defaultParallelism, math.ceil(n_file / 512)), 1)
    query_blocks = max(math.ceil(n_query / QUERY_BLOCK), 1)

    def encode(batches):
        for b in batches:
            for d, part in _by_length(b):
                low, width = ranges.value[d]
                code = _codes(low, width, cells, _matrix(part.column(1))).astype(np.uint8).astype(np.int16)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * d, pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(code), d), pa.int32()), rows], ["cid", "d", "code"])

    file = classes.select("cid", "vec").mapInArrow(encode, "cid long, d int, code array<short>")
    file = file.withColumn("fb", F.pmod(F.xxhash64("cid"), F.lit(file_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    blocks = asking.withColumn("d", F.size("vec")).withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"))
    blocks = blocks.withColumn("fb", F.explode(F.sequence(F.lit(0), F.lit(file_blocks - 1))))
    key = ["d", "qb", "fb"]
    bounded = stored(blocks.groupBy(*key).cogroup(file.groupBy(*key)).applyInArrow(_scan(ranges, cells, k + own), "qid long, cid long, lb double, ub double"))

    by_lb = Window.partitionBy("qid").orderBy(F.desc("lb"))
    last = bounded.withColumn("rn", F.row_number().over(by_lb)).where(F.col("rn") <= k + own).groupBy("qid").agg(F.min("lb").alias("last"), F.count("*").alias("n"))
    hopeful = bounded.join(last, "qid").where((F.col("n") < k + own) | (F.col("ub") >= F.col("last"))).select("qid", "cid", "ub")
    by_ub = Window.partitionBy("qid").orderBy(F.desc("ub"), "cid")
    ordered = cut(hopeful.withColumn("place", F.row_number().over(by_ub)))

    def exact(pairs: DataFrame) -> DataFrame:
        read = pairs.join(classes, "cid").join(asking.withColumnRenamed("vec", "qvec"), "qid")
        return read.select("qid", "ids", _product(F.col("qvec"), F.col("vec")).alias("score"))

    first = cut(exact(ordered.where(F.col("place") <= k + own)))
    certain = first.groupBy("qid").agg(F.min("score").alias("least"))
    more = ordered.where(F.col("place") > k + own).join(certain, "qid").where(F.col("ub") >= F.col("least"))
    scored = first.unionByName(exact(more.select("qid", "cid")))

    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    answers = scored.select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("rn", F.row_number().over(by_score)).where(F.col("rn") <= k + own).drop("rn")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    named = members.join(small(answers), "qid").where("vec_id != query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_length(b: pa.RecordBatch):
    sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), b if len(np.unique(sizes)) == 1 else b.take(pa.array(np.flatnonzero(sizes == d)))

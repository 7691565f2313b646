"""SimHash near-duplicates by pivot distance tables.

Every distinct 64-bit fingerprint gets a row of Hamming distances to fixed reference fingerprints.
The references come in pairs that agree inside one 16-bit block and are complementary outside it,
so half the sum of a pair's two distances (less a constant) is the distance within the block.  Two
fingerprints at distance 2 or less leave at least two of the four blocks untouched, so all
coordinates of two blocks agree: the coordinates of each two blocks are a cell, and partners share
one of six cells.  Pairs within a cell are discarded by their maximum coordinate difference (by
the triangle inequality it is at most the Hamming distance) and the survivors verified.

A cell with more than ``max_cell`` fingerprints is never paired off.  Its members go the exact
other way: two fingerprints at distance 2 or less have a common midpoint at distance 1 or less
from both, so each member emits its 65 midpoints and all members of one midpoint, at most 65 and
all within distance 2, are joined to the smallest.

Defined results: null and word-free texts have fingerprint zero and link like any other; rows with
equal fingerprints share a component whatever their ids; a null id never names a component unless
all ids of the component are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.llm._common import PLACE, cut, placed, ship, small, stored
from rentgrid.llm._graph import components

SEED, SHINGLE, RADIUS, BLOCK, PATTERNS = 42, 3, 2, 16, 8


def fingerprint(text: str | bytes | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of the k-word shingles, repeats included."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return _majority([xxhash.xxh64_intdigest(joined, seed)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    h = xxhash.xxh64_intdigest
    return _majority([h(joined[a:b], seed) for a, b in zip(starts[: 1 - k].tolist(), (ends[k - 1 :] - 1).tolist())])


def _majority(hashes: list[int]) -> int:
    h = np.array(hashes, dtype=np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``also``: fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *also)
    return rows.mapInArrow(_hash_batches, ", ".join(["doc_id long", "fp long", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in also]]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def references() -> list[tuple[int, int]]:
    """For each block and pattern the two reference fingerprints, patterns by Walsh's rule."""
    out = []
    for b in range(0, 64, BLOCK):
        mask = ((1 << BLOCK) - 1) << b
        for j in range(PATTERNS):
            p = sum(1 << (b + i) for i in range(BLOCK) if bin(i & (2 * j + 1)).count("1") & 1)
            out.append((p, p | (~mask & (1 << 64) - 1)))
    return out


def pivot_table(fp: Column) -> Column:
    """The distances to all references, as an array of small integers."""
    flat = [r for two in references() for r in two]
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("byte") for r in flat])


def _cells(table: Column) -> Column:
    """The six cells of a row of the pivot table."""
    n = 2 * PATTERNS
    inside = [
        [F.element_at(table, n * b + 2 * j + 1) + F.element_at(table, n * b + 2 * j + 2) for j in range(PATTERNS)]
        for b in range(4)
    ]
    two = [(x, y) for x in range(4) for y in range(x)]
    return F.array(*[F.xxhash64(F.lit(4 * x + y), *inside[x], *inside[y]) for x, y in two])


def links(fps: DataFrame, max_cell: int = 64) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect all pairs at distance 2 or less.

    Every link between fingerprints that share a cell of at most ``max_cell`` is returned itself;
    within larger cells a spanning set of exact links is."""
    table = fps.select("fp").distinct().withColumn("pivots", pivot_table(F.col("fp")))
    cells = table.select("fp", F.explode(_cells(F.col("pivots"))).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    busy = cut(cells.join(counts, "cell"))
    paired = busy.where(F.col("n") <= max_cell).withColumn("pivots", pivot_table(F.col("fp")))
    x, y = paired.alias("x"), paired.alias("y")
    gap = F.exists(F.zip_with("x.pivots", "y.pivots", lambda a, b: F.abs(a - b)), lambda d: d > RADIUS)
    verified = (
        x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")))
        .where(~gap)
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .distinct()
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    crowded = busy.where(F.col("n") > max_cell).select("fp").distinct()
    near = crowded.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    low = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    starred = near.join(low, "mid").where("fp != a").select("a", F.col("fp").alias("b")).distinct()
    return verified.unionByName(starred).distinct()


def _classes(rows: DataFrame, max_cell: int) -> DataFrame:
    """(fp, root, component_id, n_links) of every fingerprint of stored ``rows``: root is its component's smallest fingerprint."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = cut(links(fps, max_cell))
    degree = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(edges).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return cut(
        named.join(lows, "root").join(degree, "fp", "left").select("fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cell: int = 64) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id reachable), n_links of its fingerprint."""
    rows = stored(fingerprints(docs, id_col, text_col))
    return rows.join(small(_classes(rows, max_cell)), "fp").select("doc_id", "fp", "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cell: int = 64) -> DataFrame:
    """One row of each component of ``docs``: the smallest id's, of several the first by place.

    Rows are judged by their places, so repeated ids and rows without an id (after all with one) are decided too."""
    mine = placed(docs)
    rows = stored(fingerprints(mine, id_col, text_col, (PLACE,)))
    found = rows.join(small(_classes(rows, max_cell).select("fp", "root")), "fp")
    best = cut(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", PLACE)).alias("best"), F.count("*").alias("n")).where("n > 1"))
    gone = found.join(small(best.select("root", F.col(f"best.{PLACE}").alias("_rg_best"))), "root").where(F.col(PLACE) != F.col("_rg_best"))
    gone = small(cut(gone.select(F.col(PLACE).alias("_rg_gone"))))
    return mine.join(gone, F.col(PLACE) == F.col("_rg_gone"), "left_anti").drop(PLACE)

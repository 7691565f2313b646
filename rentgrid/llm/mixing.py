"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's rows are dealt into blocks.  With a target weight w, block i (from 0) is released at slot
floor(i / w) and due by slot ceil((i + 1) / w); in every slot the released block with the earliest
deadline goes (ties: the smaller source name).  As the weights add up to 1, every block goes within its
window, so at any time the number of blocks a source has had differs from its share by less than one,
whatever the weights: they are exact fractions, and so are releases and deadlines.

The schedule covers the whole table.  It is worked out when the plan is built and has at most
``MOST_BLOCKS`` blocks and one more a source: a block holds ``block_rows`` rows, or a ``MOST_BLOCKS``-th of the
table where that is more.  The driver so holds and broadcasts a bounded table, however many rows there are,
with the slot of every block and the position of its first row.

Ranks within a source are taken in hashed buckets of about ``bucket_rows`` rows with prefix sums over
the buckets' counts, so a source with a third of all rows is split.  Rows are hashed with their places in
the table's files, so rows of one repeated or null id are split too.

Every row is kept.  Slots that no source with rows left is released in stay empty, so the targets hold
until the first source runs out, and for the others after it.

Defined results: a null source is a source of its own, named in ``targets`` by the empty string
like an empty one; sources without a target share what the targets leave of 1, or the smallest given
weight if that is nothing, in proportion to the square root of their rows; a target for a source
without rows is ignored; repeated rows each get a position; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm._common import PLACE, placed

#: Least rows of a block, rows of a bucket, blocks of a schedule (and one more a source).
BLOCK_ROWS, BUCKET_ROWS, MOST_BLOCKS = 8, 20_000, 250_000


def weights(rows: dict[str, int], targets: dict[str, float] | None) -> dict[str, Fraction]:
    """The weight of each source with rows, as the fraction its decimals state; they add up to 1."""
    given = {s: Fraction(repr(w)) for s, w in (targets or {}).items() if s in rows and w > 0}
    roots = {s: Fraction(math.isqrt(n << 128)) for s, n in rows.items() if s not in given}  # to 64 binary places
    left = max(1 - sum(given.values()), min(given.values(), default=Fraction(1))) if roots else 0
    wanted = given | {s: left * x / sum(roots.values()) for s, x in roots.items()}
    total = sum(wanted.values())
    return {s: w / total for s, w in wanted.items()}


def rows_of_a_block(rows: dict[str, int], least: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> int:
    return max(least, -(-sum(rows.values()) // most_blocks))


def schedule(blocks: dict[str, int], wanted: dict[str, Fraction]) -> list[tuple[str, int, int]]:
    """(source, i, slot) of every block in the order of slots: earliest deadline first among the released blocks."""
    share = {s: w.as_integer_ratio() for s, w in wanted.items()}
    waiting = [(0, s, 0) for s, n in blocks.items() if n]  # a source's next block, by its release
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            a, q = share[s]
            heapq.heappush(ready, (-(-(i + 1) * q // a), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < blocks[s]:
            a, q = share[s]
            heapq.heappush(waiting, ((i + 1) * q // a, s, i + 1))
        slot += 1
    return out


def mix(
    docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", order_col: str | None = None,
    block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """(doc_id, source, block, slot, position) of every row; position numbers all rows from 0 without gaps.

    A source's rows are taken in the order of a hash of ``order_col``, which is the id if not given, and their places."""
    spark = docs.sparkSession
    docs = docs if PLACE in docs.columns else placed(docs)
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(order_col or id_col, PLACE).alias("order"), F.col(PLACE).alias("tie"), src.alias("src"), F.col(source_col).alias("source"))
    counts = {r.src: r.n for r in rows.groupBy("src").agg(F.count("*").alias("n")).collect()}  # a row for each source
    size = rows_of_a_block(counts, block_rows, most_blocks)
    plan = schedule({s: -(-n // size) for s, n in counts.items()}, weights(counts, targets)) if counts else []
    starts, at = [], 0
    for s, i, _ in plan:
        starts.append(at)
        at += min(size, counts[s] - i * size)
    columns = [pa.array([x[0] for x in plan], pa.string()), *[pa.array(v, pa.int64()) for v in ([x[1] for x in plan], [x[2] for x in plan], starts)]]
    table = F.broadcast(spark.createDataFrame(pa.table(columns, ["src", "block", "slot", "start"])))  # most_blocks rows and one more a source, at most
    split = spark.createDataFrame(pa.table([pa.array(list(counts), pa.string()), pa.array([-(-n // bucket_rows) for n in counts.values()], pa.int64())], ["src", "buckets"]))
    dealt = rows.join(F.broadcast(split), "src").withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(7)), "buckets"))
    sizes = dealt.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each ``bucket_rows`` rows
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("src", "bucket").orderBy("order", "tie"))).join(offsets, ["src", "bucket"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("rn") - 1).withColumn("block", F.expr(f"rank div {size}"))
    return ranked.join(table, ["src", "block"]).select("doc_id", "source", "block", "slot", (F.col("start") + F.expr(f"rank % {size}")).alias("position"))


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` in the order of the schedule: range-partitioned and sorted by position, columns unchanged.

    Rows are told apart by their places in the table's files, so null and repeated ids each keep their row;
    texts are moved twice, to meet their positions and to be put in order."""
    mine = placed(docs)
    places = mix(mine, targets, PLACE, order_col=id_col, **more).select(F.col("doc_id").alias("_rg_at"), F.col("position").alias("_rg_position"))
    met = mine.join(places, mine[PLACE] == places["_rg_at"])
    return met.repartitionByRange("_rg_position").sortWithinPartitions("_rg_position").select(*[mine[c] for c in docs.columns])

"""How filters interact: direct relational replay of every order in which they can be applied.

A document carries one bit for each filter it fails.  Its bits are crossed with the broadcast table
of all orders (120 for five filters), the step of its first failure is computed once for each order, the
order's steps are exploded, and the counts are conditional sums by part, order and step.  These sums are
taken in the map tasks, so that only 600 rows a part and task are shuffled, whichever part is hot.

Two facts come from outside a document: whether a smaller id has the same text, and its labels.  Both are
looked up by key over narrow rows (``look_up``).  Keys with more than a hundred-thousandth of the rows,
of which there are fewer than a hundred thousand, are broadcast; the rest are joined by key, and rows
that need no partner, null keys among them, are spread.

Defined results: a null text is empty, and an empty one fails A only; a null part is named by the empty
string; a null id has no labels and neither is nor has a smaller id; rows that repeat both id and text
fail E only if a smaller id has that text too; several label rows of an id count as their greatest
values; ties can't arise, as an order is total; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.llm._common import stored

#: Keys with more than this share of the rows are looked up by broadcast; there are fewer than 1 / HOT of them.
HOT = 1 / 100_000
#: Most filters for which all orders are replayed.
MOST_FILTERS = 6


def look_up(rows: DataFrame, n_rows: int, table: DataFrame, key: str, value: str, spread: str) -> DataFrame:
    """``rows`` with ``value`` from ``table`` (key, n, value; unique keys; n: rows that have the key).

    Rows of frequent keys meet the broadcast part of the table; they and null keys go through the other
    join under a salt made of ``spread``, so no task gets more than its share of them."""
    limit = math.ceil(n_rows * HOT)
    named = table.select(F.col(key).alias("_k"), "n", F.col(value).alias("_v"))
    hot = named.where(F.col("n") > limit).select(F.col("_k").alias("_hot"), F.col("_v").alias("_hot_v"), F.lit(True).alias("_met"))
    cold = named.where(F.col("n") <= limit).select("_k", "_v", F.lit(0).cast("long").alias("_salt"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    done = F.col("_met").isNotNull() | F.col(key).isNull()
    salted = met.withColumn("_at", F.when(done, 1 + F.pmod(F.xxhash64(spread, key), F.lit(1_000_003))).otherwise(0))
    out = salted.join(cold, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_salt")), "left")
    return out.withColumn(value, F.coalesce("_hot_v", "_v")).drop("_hot", "_hot_v", "_met", "_at", "_k", "_v", "_salt")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text by itself fails; ``words`` are its words."""
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n,
        "C": 100 * capitals > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic), a row for each row of ``docs``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = own.withColumn("words", F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), ""))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    rows = stored(split.select("doc_id", "part", *[c.alias(k) for k, c in failures(F.col("text"), F.col("words")).items()], digest))
    n_rows = rows.count()
    same = rows.where("doc_id is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    rows = look_up(rows, n_rows, same, "digest", "first", "doc_id")
    marked = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.struct(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).alias("label"))
    often = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > math.ceil(n_rows * HOT))
    counted = marked.join(F.broadcast(often), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = look_up(rows, n_rows, counted, "doc_id", "label", "digest")
    no = F.lit(False)
    return rows.select(
        "doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("label.good", no).alias("good"), F.coalesce("label.toxic", no).alias("toxic")
    )


def replay(flags: DataFrame, filters: str = "ABCDE", part_col: str = "part", good_col: str = "good", toxic_col: str = "toxic") -> DataFrame:
    """The audit of any filters with one-letter names, whose boolean columns say which rows fail them.

    One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"all orders of {len(filters)} filters are too many to replay")
    spark = flags.sparkSession
    bit = {f: 1 << k for k, f in enumerate(filters)}
    names = T.StructType([T.StructField("order_no", T.IntegerType()), T.StructField("filter_order", T.StringType()), T.StructField("bits", T.ArrayType(T.IntegerType()))])
    orders = spark.createDataFrame([(k, "".join(o), [bit[f] for f in o]) for k, o in enumerate(permutations(sorted(filters)))], names)
    fails = sum((F.when(F.col(f), b).otherwise(0) for f, b in bit.items()), F.lit(0))
    docs = flags.select(F.col(part_col).alias("part"), fails.alias("fails"), F.col(good_col).alias("good"), F.col(toxic_col).alias("toxic"))
    first = F.lit(len(filters) + 1)
    for k in reversed(range(len(filters))):
        first = F.when(F.col("fails").bitwiseAND(F.col("bits")[k]) != 0, k + 1).otherwise(first)
    crossed = docs.crossJoin(F.broadcast(orders.select("order_no", "bits"))).withColumn("first", first)
    steps = crossed.select("part", "order_no", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    here = F.col("first") == F.col("step")
    cases = {
        "kept": F.col("first") > F.col("step"), "removed": here,
        "redundant": (F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("fails") == F.col("bit"), "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic"),
    }
    counts = steps.groupBy("part", "order_no", "step", "bit").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in cases.items()])
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley")
    return counts.join(F.broadcast(orders.select("order_no", "filter_order")), "order_no").select("part", "filter_order", "step", *cases, shapley)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``replay`` of the five filters A to E over whole texts."""
    return replay(flagged(docs, labels, id_col, text_col, part_col))

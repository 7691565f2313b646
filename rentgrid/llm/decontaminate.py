"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window.  Of the hashed ``gram``-word grams of a text, winnowing keeps the smallest (the rightmost,
if several) of every ``window - gram + 1`` consecutive ones, so any span of ``window`` words that a
document shares with an item leaves one common fingerprint in both, at the same place of the span.
Documents and items are joined on fingerprints, and each hit is extended over the words around it:
the document's words that lie in a run of at least ``window`` common words are hit.  An item
shorter than a window is fingerprinted whole, and the documents' grams of that length looked up.

Every fingerprint carries the words around it, as many as any window over it can reach, so hits are
verified on words without reading a text again.  The items' fingerprints are first used as a
filter on the documents' side if there are at most ``filter_rows`` (16 MB); beyond that, or for the
join itself beyond the broadcast limit, the plan is a shuffled join.

Defined results: null texts and texts without a word have 0 words and no hits; an empty benchmark
hits nothing; repeated rows each get their row; items with equal texts are all reported; a null
item id is reported as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm._common import PLACE, cut, placed, ship, small, stored

WINDOW, GRAM = 13, 7
#: A fixed mapping: A-Z to lower case, all other ASCII characters that are no word characters to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HITS = pa.list_(pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("k", pa.int32()), ("off", pa.int32()), ("ctx", pa.string())]))
_HITS_DDL = "array<struct<fp:long,pos:int,k:int,off:int,ctx:string>>"
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        self[word] = h
        return h


_HASH = _Hashes()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all k-word grams."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * _MUL + h[j : j + n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept grams: the rightmost smallest of every ``w`` consecutive ones."""
    if len(g) < w:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + (w - 1) - views.argmin(axis=1))


def _found(ws: list[bytes], k: int, positions, g: np.ndarray, reach: int) -> list[dict]:
    signed = g.view(np.int64)
    out = []
    for p in positions:
        p = int(p)
        a, b = max(0, p - reach), min(len(ws), p + k + reach)
        out.append({"fp": int(signed[p]), "pos": p, "k": k, "off": p - a, "ctx": b" ".join(ws[a:b]).decode()})
    return out


def fingerprint_rows(texts: DataFrame, lengths: list[int] | None, known, window: int, gram: int) -> DataFrame:
    """(uid, id, n_words, hits) of (uid, id, text).  lengths: of the short items to look up in
    documents; None makes items of the texts.  known: a broadcast sorted array of the only
    fingerprints wanted, or None."""

    def of(raw: bytes | None) -> tuple[int, list[dict]]:
        ws = words(raw)
        if not ws:
            return 0, []
        h = np.fromiter(map(_HASH.__getitem__, ws), np.int64, len(ws)).view(np.uint64)
        short = ([len(ws)] if len(ws) < window else []) if lengths is None else lengths
        out: list[dict] = []
        for k, whole in [(gram, False), *((k, True) for k in short)]:
            g = grams(h, k)
            at = np.arange(len(g)) if whole else winnow(g, window - gram + 1)
            if known is not None and len(at):
                v, mine = known.value, g[at].view(np.int64)
                i = np.searchsorted(v, mine)
                at = at[(i < len(v)) & (v[np.minimum(i, len(v) - 1)] == mine)] if len(v) else at[:0]
            out += _found(ws, k, at, g, 0 if whole else window - gram)
        return len(ws), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [of(x.as_py()) for x in part.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], _HITS)], ["uid", "id", "n_words", "hits"]
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"uid long, id {kind}, n_words long, hits {_HITS_DDL}")


def extend(doc: list[str], off: int, item: list[str], item_off: int, k: int) -> tuple[int, int] | None:
    """The common words before and after a common gram, or None if the grams differ."""
    if doc[off : off + k] != item[item_off : item_off + k]:
        return None
    a = 0
    while a < min(off, item_off) and doc[off - a - 1] == item[item_off - a - 1]:
        a += 1
    b = 0
    while b < min(len(doc) - off, len(item) - item_off) - k and doc[off + k + b] == item[item_off + k + b]:
        b += 1
    return a, b


def _verify(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for uid, pos, k, off, ctx, ioff, ictx, whole, cid in zip(*(c.to_pylist() for c in batch.columns)):
                got = extend(ctx.split(" "), off, ictx.split(" "), ioff, k)
                if got and (whole or sum(got) + k >= window):
                    out.append((uid, cid, pos - got[0], pos + k + got[1]))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["uid", "cid", "a", "b"])

    return run


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM, filter_rows: int = 2_000_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted array of item ids as strings), contaminated."""
    spark = docs.sparkSession
    ship(spark)
    uid = F.monotonically_increasing_id().alias("uid")
    bench = items.select(uid, F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    marks = fingerprint_rows(bench, None, None, window, gram)
    marks = marks.select("id", "n_words", F.explode("hits").alias("h")).select("id", (F.col("n_words") < window).alias("whole"), "h.fp", "h.k", "h.off", "h.ctx")
    # an item shorter than a window but longer than a gram has no winnowed gram, as it has no full window
    marks = stored(marks.withColumn("cid", F.xxhash64("fp", "k", "off", "ctx", "whole")))
    contexts = cut(marks.drop("id").distinct())
    named = marks.select("cid", "id").distinct()
    lengths = [r[0] for r in contexts.where("whole").select("k").distinct().collect()]  # below ``window``
    known = None
    if contexts.count() <= filter_rows:
        wanted = np.array([r[0] for r in contexts.select("fp").distinct().collect()], np.int64)
        known = spark.sparkContext.broadcast(np.sort(wanted))
    rows = stored(fingerprint_rows(docs.select(uid, F.col(id_col).alias("id"), F.col(text_col).alias("text")), lengths, known, window, gram))
    hits = rows.select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    other = contexts.select("fp", "k", F.col("off").alias("ioff"), F.col("ctx").alias("ictx"), "whole", "cid")
    met = hits.join(small(other), ["fp", "k"]).select("uid", "pos", "k", "off", "ctx", "ioff", "ictx", "whole", "cid")
    runs = cut(met.mapInArrow(_verify(window), "uid long, cid long, a int, b int"))
    # the union of the runs: each adds what lies beyond the furthest end so far
    spans = runs.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc, x):
        return F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))

    counted = spans.select("uid", F.aggregate("s", zero, step)["n"].alias("n_hit"))
    held = runs.select("uid", "cid").distinct().join(small(named), "cid").groupBy("uid").agg(F.sort_array(F.collect_set("id")).alias("items"))
    found = small(cut(counted.join(held, "uid")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("uid", "id", "n_words").join(found, "uid", "left").select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the contaminated ones, each row judged by itself: by its place, so with a repeated or no id too."""
    mine = placed(docs)
    bad = contamination(mine, items, PLACE, text_col, **more).where("contaminated").select(F.col("doc_id").alias("_rg_bad"))
    return mine.join(small(cut(bad)), F.col(PLACE) == F.col("_rg_bad"), "left_anti").drop(PLACE)

"""Packing by powers of two: every sequence is a piece of one document.

A document is encoded whole, closed by an end id, and cut into pieces of ``largest`` ids and then the
powers of two of what remains, from the greatest down.  A piece is a sequence by itself; sequences of
equal length form a bucket, and a batch is taken from one bucket.  So nothing is padded and no sequence
holds ids of two documents.

One scan encodes and cuts; each task numbers the pieces it makes of each length, and the pieces are
stored.  A bucket's sequences get consecutive numbers (buckets from the longest down) from prefix sums
over the counts by length and task: a few rows a task, and no text or id is shuffled.

Defined results: a null or empty text is the end id alone, one piece; a repeated row is packed again;
equal lengths are told apart by the place where they were made; a document longer than ``largest`` gives
several sequences; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.llm._common import ship, small, stored
from rentgrid.llm.token_counts import BEYOND_LATIN, _latin_bpe, tokenizer_digest

LARGEST, END_ID = 2048, 1
#: Documents encoded together.
TOGETHER = 64
_LOADED: dict[str, Callable[[list[str]], list[np.ndarray]]] = {}


def cuts(n: int, largest: int = LARGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones of ``largest``, a power of two, then the binary digits of the rest."""
    whole, rest = divmod(n, largest)
    out = [(k * largest, largest) for k in range(whole)]
    at, size = whole * largest, largest >> 1
    while size:
        if rest & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def encoder(kind: str, content: bytes, key: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their ids; loaded once per worker process.

    Texts of printable Latin characters take the same merges in tiktoken, as for ``token_counts``."""
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            _LOADED[key] = lambda texts: [np.array(x, np.uint32) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_buffer(content)
            model.no_truncation()
            model.no_padding()
            fast = _latin_bpe(model)

            def encode(texts: list[str]) -> list[np.ndarray]:
                rest = [i for i, t in enumerate(texts) if not fast or BEYOND_LATIN(t)]
                own = dict(zip(rest, model.encode_batch([texts[i] for i in rest], add_special_tokens=False))) if rest else {}
                return [np.array(own[i].ids, np.uint32) if i in own else np.array(fast.encode(t, allowed_special="all"), np.uint32) for i, t in enumerate(texts)]

            _LOADED[key] = encode
    return _LOADED[key]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank[, ids]): the pieces, numbered by length within the task that made them."""
    if largest < 1 or largest & (largest - 1):
        raise ValueError(f"{largest} is no power of two")
    spark = docs.sparkSession
    ship(spark)
    kind, key = "sentencepiece" if tokenizer_path.endswith(".model") else "tokenizers", tokenizer_digest(tokenizer_path)
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbers = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType())]
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in numbers]]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else fields)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(kind, model.value, key), TaskContext.get().partitionId(), {}
        for b in batches:
            for low in range(0, b.num_rows, TOGETHER):
                own = b.slice(low, TOGETHER)
                found, parts = [], []
                for row, these in enumerate(encode(own.column(1).to_pylist())):
                    whole = np.append(these, np.uint32(end_id)).astype("<u4")
                    for start, length in cuts(len(whole), largest):
                        piece = whole[start : start + length]
                        made[length] = made.get(length, -1) + 1
                        found.append((row, start, length, zlib.crc32(piece.tobytes()), len(whole), part, made[length]))
                        parts.append(piece)
                table = list(zip(*found))
                columns = [own.column(0).take(pa.array(table[0])), *[pa.array(v, pa.int32() if n == "part" else pa.int64()) for v, (n, _) in zip(table[1:], numbers)]]
                if ids:
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return rows.mapInArrow(cut_up, schema)


def numbered(made: DataFrame) -> DataFrame:
    """Stored ``pieces`` with sequence_id, consecutive within a bucket of equal lengths, and offset."""
    counts = stored(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each power of two
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("bucket"))
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(F.broadcast(buckets), "length")
    first = stored(bases.select("length", "part", (F.col("bucket") + F.col("base")).alias("first")))
    return made.join(small(first), ["length", "part"]).withColumns({"sequence_id": F.col("first") + F.col("rank"), "offset": F.lit(0).cast("long")}).drop("first", "part", "rank")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids."""
    return numbered(stored(pieces(docs, tokenizer_path, id_col, text_col, largest, end_id, ids)))


def write_buckets(docs: DataFrame, tokenizer_path: str, path: str, **more) -> None:
    """The sequences with their ids as Parquet, a folder for each length."""
    pack(docs, tokenizer_path, **more).write.partitionBy("length").parquet(path)

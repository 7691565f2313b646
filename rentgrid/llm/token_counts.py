"""Token counts through a digest cache.

A text is identified by the SHA-256 digest of its normalised content (null becomes the empty text;
nothing else is changed, as any other change could alter the count) and a tokenizer by the digest
of its file and library version.  Counts are stored in an append-only Parquet table by both
digests.  A run joins its digests to the table, encodes only the distinct texts it misses, appends
their counts, and then answers every row from the table.  Copies are folded within each map task
before anything is shuffled, so a text that fills a third of the rows crosses the network once a task.

Encoding takes most of the time.  A byte-level BPE file whose ids follow its merges, with no
normaliser, is also loaded into tiktoken, which applies the same merges several times faster.  It
counts the texts made of printable Latin characters only, where both libraries' patterns classify
every character alike; any other text goes to the file's own library.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their row;
an empty table gives no rows; a count that two runs appended twice is read once.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm._common import ship, small

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: A fixed value: the pattern by which byte-level BPE splits a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BEYOND_LATIN = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u024f]").search
_LOADED: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and the version of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _latin_bpe(model):
    """A tiktoken encoding with the merges of ``model``, or None where they can't be expressed so."""
    import tiktoken

    spec = json.loads(model.to_str())
    pre, bpe = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        bpe.get("type") == "BPE"
        and not any((spec.get("normalizer"), bpe.get("dropout"), bpe.get("continuing_subword_prefix"), bpe.get("end_of_word_suffix"), bpe.get("ignore_merges")))
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        and all(x["special"] and not any(x[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in spec["added_tokens"])
    )
    if not plain:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in bpe["vocab"].items() if token not in special}
    merged = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
    if len(ranks) != 256 + len(merged) or any(bpe["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merged)):
        return None
    return tiktoken.Encoding("same_merges", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


def counter(kind: str, content: bytes, key: str):
    """A function from a list of texts to their token counts; loaded once per worker process."""
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            _LOADED[key] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_buffer(content)
            model.no_truncation()
            model.no_padding()
            fast = _latin_bpe(model)

            def count(texts: list[str]) -> list[int]:
                rest = [i for i, t in enumerate(texts) if not fast or BEYOND_LATIN(t)]
                own = dict(zip(rest, map(len, model.encode_batch([texts[i] for i in rest], add_special_tokens=False)))) if rest else {}
                return [own[i] if i in own else len(fast.encode(t, allowed_special="all")) for i, t in enumerate(texts)]

            _LOADED[key] = count
    return _LOADED[key]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``cache_path`` is a folder Spark can write; it is created when missing and appended to."""
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(tokenizer_path)
    kind = "sentencepiece" if tokenizer_path.endswith(".model") else "tokenizers"
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cached() -> DataFrame:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return table.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(kind, model.value, version)
        for b in batches:
            n: list[int] = []
            for i in range(0, b.num_rows, 64):
                n += count(b.column(1).slice(i, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([version] * len(n))], ["digest", "n_tokens", "tokenizer"])

    misses = rows.select("digest", "text").join(cached().select("digest"), "digest", "left_anti")
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))
    distinct.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    keys = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keys.join(small(cached()), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.llm import decontaminate, filter_audit, langid, line_dedup, mixing, packing, pii, quality, sharding, simhash_dedup, token_counts, vector_file, whitening
from rentgrid.llm._common import fold, read, shared_dir


def op1_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_file.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = F.col("doc_id")
    found = langid.identify(docs, docs.where(fold(out, 5) != 0))
    return found.select("doc_id", (fold(out, 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_similar_lines(read(spark, sf_dir, "documents"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == F.lit(kind)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["a"].alias("a"), s["b"].alias("b")))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", terms)).alias("spans"), F.size("terms").cast("long").alias("n_term")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    labels = read(spark, sf_dir, "labels").where(fold(id_, 3) != 1).select("doc_id", F.col("quality").alias("y"))
    found = quality.score(read(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (fold(id_, 3) == 1).alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"), n_shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own per call, so that every run encodes all of its distinct texts."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the ids themselves, of which the query returns a digest."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_vector_file, op2_language_id, op3_line_dedup, op4_pii, op5_quality, op6_decontaminate, op7_mixing, op8_simhash_dedup, op9_sharding, op10_token_counts, op11_filter_audit, op12_whitening, op13_packing)
}

#: DuckDB's SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_vector_file": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                  MAP {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
                       'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)} AS m
           FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
     n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
     o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
     r AS (SELECT f.*, o, coalesce(list_position(list_transform(o, lambda k: m[k]), true), 6) AS first, len(list_filter(o, lambda k: m[k])) AS n_fails FROM f, o),
     s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM r),
     c AS (SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS k,
                  count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (first < step AND m[o[step]]) AS redundant,
                  count(*) FILTER (m[o[step]] AND n_fails = 1) AS unique_fails, count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost
           FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM c""",
}

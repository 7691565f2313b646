"""The pipeline against a brute-force version of each stage, and on an awkward table."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from rentgrid.llm import quality
from rentgrid.llm._common import fold
from tests.llm.test_operators import AWKWARD, DOC, brute_classes, brute_fingerprint, brute_hits


def test_run_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("y"))
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    classes = brute_classes([brute_fingerprint(t) for _, t in left])
    left = [d for i, d in enumerate(left) if classes[i] == i]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {x[0] for x in brute_hits(left, bench) if not x[4]}
    out = corpus_pipeline.run(spark, sf)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(clean) and set(docs.columns) < set(out.columns)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 16
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(len(r.text.encode()) for r in got) + 16
    assert max(size.values()) - min(size.values()) <= 2 * largest + 0.01 * sum(size.values())


def test_rows_without_an_id_are_judged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = corpus_pipeline.good_quality(spark, docs, sf)
    # the labelled rows keep their ids, so the same model is learned
    blank = docs.withColumns({"own": F.col("doc_id"), "doc_id": F.when(F.col("doc_id").isin([r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]), F.col("doc_id"))})
    got = {r.own for r in corpus_pipeline.good_quality(spark, blank, sf).collect()}
    assert got == {r.doc_id for r in named.collect()} and len(got) < docs.count()


def test_shards_are_runs_of_the_mix(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.mixed_to_weights(spark, docs, sf).write.parquet(str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    order = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    got = [r.doc_id for r in corpus_pipeline.sharded(spark, mixed, sf).orderBy("shard", "slot").collect()]
    assert got == order


def test_stages_keep_the_columns_and_stand_awkward_tables(spark, sf):
    for table in (spark.createDataFrame(AWKWARD, DOC).withColumn("n_chars", F.length("text").cast("long")), spark.createDataFrame([], DOC).withColumn("n_chars", F.lit(1).cast("long"))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, sf)
            assert set(table.columns) <= set(out.columns) and out.count() <= table.count()
            if i < 4:
                assert out.columns == table.columns

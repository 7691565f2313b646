"""Filter audit, whitening and packing against brute force, and on awkward tables."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.llm import filter_audit, packing, whitening
from tests.llm.test_operators import AWKWARD, awkward, docs, nothing, rows  # noqa: F401

# ---- op 11


def brute_audit(texts, labels):
    """texts: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    by_text = collections.defaultdict(list)
    for d, t, _ in texts:
        if d is not None:
            by_text[t or ""].append(d)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = collections.defaultdict(lambda: [0] * 6)
    for d, t, lang in texts:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and min(by_text[t]) < d else set()
        for order in map("".join, itertools.permutations("ABCDE")):
            first = next((k for k, f in enumerate(order) if f in fails), 5)
            for k, f in enumerate(order):
                row = out[lang or "", order, k + 1]
                row[0] += first > k
                row[1] += first == k
                row[2] += first < k and f in fails
                row[3] += fails == {f}
                row[4] += first == k and d in good
                row[5] += first == k and d in toxic
    shapley = collections.Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {(p, o, s, *row, shapley[p, o[s - 1]]) for (p, o, s), row in out.items()}


COUNTS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_is_the_brute_forces(spark, sf, docs, awkward, nothing):  # noqa: F811
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plain = rows(labels, "doc_id", "quality", "toxic")
    assert set(rows(filter_audit.audit(docs, labels), *COUNTS)) == brute_audit(rows(docs, "doc_id", "text", "lang"), plain)
    odd = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (None, 1, 1), (4, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = rows(filter_audit.audit(awkward, odd), *COUNTS)
    assert set(got) == brute_audit(rows(awkward, "doc_id", "text", "lang"), rows(odd, "doc_id", "quality", "toxic")) and len(got) == len(set(got)) == 600 * 3
    assert rows(filter_audit.audit(nothing, labels)) == []
    assert len(rows(filter_audit.audit(docs, labels.where("false")))) == 600 * docs.select("lang").distinct().count()


@pytest.mark.parametrize("share", [1 / 100_000, 0.01, 0.9])
def test_audit_of_hot_texts_and_ids(spark, monkeypatch, share):
    """A third of the rows share a text, a third an id, some have none: as broadcast and as joined keys."""
    monkeypatch.setattr(filter_audit, "HOT", share)
    words = ["Alpha beta", "# x", "plain words that differ"]
    data = [(None if i % 11 == 0 else 7 if i % 3 == 1 else i, "same TEXT" if i % 3 == 0 else words[i % 3] + str(i % 5), "en" if i % 2 else None) for i in range(300)]
    labels = [(7, 1, 0), (12, 1, 1), (15, 0, 1)]
    got = filter_audit.audit(spark.createDataFrame(data, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(rows(got, *COUNTS)) == brute_audit(data, labels)


def test_replay_takes_other_filters_and_shuffles_sums_only(spark):
    flags = spark.createDataFrame([("p", True, False, True, False), ("p", False, True, False, True)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = {r.filter_order + str(r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.replay(flags, "XY").collect()}
    assert got == {"XY1": (1, 1, 0, 1, 2), "XY2": (0, 1, 0, 1, 2), "YX1": (1, 1, 0, 1, 2), "YX2": (0, 1, 0, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.replay(flags, "ABCDEFG")


# ---- op 12


def brute_whitening(vectors, components=32):
    x = np.floor(64 * np.array([v for _, v in vectors], np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    s = [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[float((n * int(a) - b)) / n for a, b in zip(row, s)] for row in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, centred @ axes / np.sqrt(e), e / np.trace(v), axes


@pytest.mark.parametrize("tile,block_rows", [(32, 2048), (5, 7)])
def test_whitening_is_the_whole_matrixs(spark, tile, block_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.3, (300, 12)) * np.arange(1, 13)
    base[:100] = base[0]  # a third of the rows
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    n, deviation, whitened, explained, _ = brute_whitening(vectors, 8)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(6)
    got = collections.defaultdict(dict)
    for r in whitening.whiten(df, components=8, tile=tile, block_rows=block_rows).collect():
        assert (r.n, r.deviation) == (n, deviation[r.vec_id]) and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got[r.vec_id][r.component] = r.whitened
    mine = np.array([[got[i][c] for c in range(1, 9)] for i in range(300)])
    signs = np.sign((mine * whitened).sum(0))
    assert np.allclose(mine, whitened * signs, atol=1e-9)
    assert np.allclose(mine.T @ mine / n, np.eye(8), atol=1e-9)


def test_whitening_leaves_bad_vectors_out(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1e30, 0.0]), (7, [1.0, 2.0, 3.0])]
    fine = [(None, [0.5, 0.1]), (10, [0.1, 0.9]), (10, [0.1, 0.9]), (11, [-0.7, 0.3]), (12, [0.2, -0.4])]
    df = spark.createDataFrame(bad + fine, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("n", "component", "whitened", "vec")})
    n, deviation, *_ = brute_whitening(fine)
    got = rows(whitening.whiten(df), "vec_id", "component", "n", "deviation")
    assert collections.Counter(got) == collections.Counter((i, c, n, d) for (i, _), d in zip(fine, deviation) for c in (1, 2))
    assert rows(whitening.whiten(df.where("false"))) == []
    assert rows(whitening.whiten(df.where("vec_id = 1"))) == []


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25 * (i % 2)]) for i in range(6)], "vec_id long, embedding array<float>")
    got = rows(whitening.whiten(same), "component", "whitened", "explained", "identity_error")
    assert {(c, w is None, e) for c, w, e, _ in got} == {(1, False, 1.0), (2, True, 0.0)} and max(x[3] for x in got) < 1e-12
    one = rows(whitening.whiten(same.where("vec_id = 0")), "vec_id", "component", "deviation", "whitened", "explained", "identity_error")
    assert one == [(0, 1, 0, None, None, 0.0), (0, 2, 0, None, None, 0.0)]


def test_deviation_beyond_a_long_is_exact(spark):
    data = [(0, [0.0]), (1, [3e10]), (2, [1.0])]
    got = dict(rows(whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vec_id", "deviation"))
    x = [int(64 * v[0]) + 1_000_000 for _, v in data]
    assert got == {i: (3 * x[i] - sum(x)) ** 2 for i in range(3)} and max(got.values()) > 2**63


def test_large_means_do_not_blur_the_covariance(spark):
    rng = np.random.default_rng(6)
    x = 1e6 + rng.normal(0, 0.5, (400, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert max(r.identity_error for r in whitening.whiten(df).collect()) < 1e-9


# ---- op 13


def test_cuts_are_binary():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)] and packing.cuts(0) == []
    assert packing.cuts(5003) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 256), (4864, 128), (4992, 8), (5000, 2), (5002, 1)]
    for n in range(1, 5000, 7):
        c = packing.cuts(n, 64)
        assert sum(x for _, x in c) == n and all(a + x == b for (a, x), (b, _) in zip(c, c[1:])) and all(x & (x - 1) == 0 and x <= 64 for _, x in c)


def test_packed_ids_are_the_documents(spark, docs, awkward, nothing, tmp_path):  # noqa: F811
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = [(900, "a<|endoftext|>b <|endoftext|>"), (901, "it's  \n\n done now  naïve ½ ²³ ١٢ 東京 ­"), (902, "word " * 2047)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in rows(df)}
    got = packing.pack(df, path).collect()
    whole = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(whole[r.doc_id]) and r.length == len(r.ids) and r.doc_tokens == len(want[r.doc_id]) and r.offset == 0
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id] += r.ids
    assert whole == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    in_order = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order, reverse=True)
    odd = packing.pack(awkward, path, ids=False)
    assert sum(r.length for r in odd.collect()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, *_ in AWKWARD)
    assert {(r.length, r.doc_tokens) for r in odd.where("doc_id <= 2").collect()} == {(1, 1)} and odd.where("doc_id is null").count() > 0
    assert rows(packing.pack(nothing, path)) == []
    packing.write_buckets(df, path, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    with pytest.raises(ValueError):
        packing.pack(df, path, largest=1000)


def test_packing_with_another_tokenizer(docs):  # noqa: F811
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    few = docs.limit(10)
    got = collections.Counter()
    for d, n in rows(packing.pack(few, path, largest=256, end_id=2, ids=False), "doc_id", "length"):
        got[d] += n
    assert got == {d: len(s.encode(t)) + 1 for d, t in rows(few, "doc_id", "text")}

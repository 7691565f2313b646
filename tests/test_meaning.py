"""Semantics, nested projections, documents of any shape, exact ranks and the blocks of entity resolution."""

import itertools
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rentgrid.functions import nested, semantics, variant
from rentgrid.functions.nested import ALL, First, Most, Path
from rentgrid.operators import entity, market, products, ranks, windows
from rentgrid.operators.graph import components


def found(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("f", semantics.found_in(F.lit(""), F.col("t")))
    return {(m.rule, m.text, m.negated): (m.start, m.end) for m in df.head().f}


# ---- semantics


@pytest.mark.parametrize(
    "text,field,want",
    [
        ("sans parking", "parking", "denied"), ("pas de parking", "parking", "denied"), ("ni garage, ni box", "parking", "denied"), ("aucun grand parking", "parking", "denied"), ("Parking privatif", "parking", "affirmed"),
        ("sans vis-à-vis avec parking", "parking", "affirmed"), ("sans charme, parking", "parking", "affirmed"), ("sans garage mais parking", "parking", "affirmed"), ("pas d'ascenseur et jardin", "garden", "affirmed"),
        ("pas de jardin. Beau jardin en face", "garden", "affirmed"), ("rien", "garden", "unknown"), (None, "pool", "unknown"), ("PISCINE", "pool", "affirmed"), ("piscines", "pool", "unknown"),
    ],
)
def test_stance_under_negation(spark, text, field, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("f", semantics.found_in(F.lit(None), F.col("t")))
    assert df.select(semantics.stance(F.col("f"), field)).head()[0] == want


def test_evidence_is_cut_from_the_text_and_counts_code_points(spark):
    text = "😀 été : Location meublée, loyer 1 200 € CC + 50 € de charges, caution : 500,50 €, terrasse"
    got = found(spark, text)
    whole = "\n" + text
    assert all(whole[a:b] == piece for (_, piece, _), (a, b) in got.items())
    assert {r for r, _, _ in got} == {"furnished_positive", "rent_mentioned", "charges", "deposit_amount", "terrace"}
    df = spark.createDataFrame([(text,)], "t string").withColumn("f", semantics.found_in(F.lit(""), F.col("t")))
    a = df.select(semantics.analysis(F.lit(""), F.col("t"), F.lit(None).cast("string"), F.lit(500), F.col("f")).alias("a")).head().a
    sums = a.financials
    assert (sums.rent_mentioned_eur.value, sums.rent_mentioned_eur.charge_basis, sums.deposit.amount_eur, sums.agency_fees.amount_eur) == (1200, "cc", 50050, None)
    assert a.quality.warnings == ["description_short_or_sparse", "rent_field_mismatch: field price=500, text rent=1200"] and a.features.parking.present is None


def test_negatives_have_priority_wherever_they_stand(spark):
    df = spark.createDataFrame([("meublé ... non meublé",), ("meublé",), ("",)], "t string").withColumn("f", semantics.found_in(F.lit(""), F.col("t")))
    assert [r[0] for r in df.select(semantics.decided(F.col("f"), "furnished")["value"]).collect()] == ["non_meuble", "meuble", None]


# ---- nested projections


def test_specification_prunes_renames_and_drops_empties_at_any_depth(spark):
    df = spark.sql(
        """SELECT 1 AS id, named_struct('x', named_struct('y', 5, 'z', ''), 'list', array(named_struct('a', 'p', 'b', 1), named_struct('a', '', 'b', 2), named_struct('a', 'q', 'b', 3)),
        'empty', array(), 'none', named_struct('k', cast(null as string)), 'lists', array(array(named_struct('a', 'm', 'b', 1)))) AS n, '' AS t, 0 AS zero"""
    )
    spec = {"id": ALL, "deep": Path("n.x.y"), "n": {"x": ALL, "items": Path("list", Most(2, {"name": Path("a")})), "empty": ALL, "none": ALL, "lists": {"a": ALL}, "absent": ALL}, "t": First("t", "gone", default="?"), "zero": First("zero", "id"), "nothing": ALL}
    got = json.loads(df.select(nested.document(df, spec)).head()[0])
    assert got == {"id": 1, "deep": 5, "n": {"x": {"y": 5}, "items": [{"name": "p"}], "lists": [[{"a": "m"}]]}, "t": "?", "zero": 1}
    assert df.select(nested.document(df, {"n": {"x": {"z": ALL}}})).head()[0] == "{}"


def test_only_named_leaves_are_read(spark, tmp_path):
    spark.sql("SELECT named_struct('a', 1, 'b', 'long') AS s, array(named_struct('c', 1, 'd', 'long')) AS l, 'raw' AS raw").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = df.select(nested.document(df, {"s": {"a": ALL}, "l": {"e": Path("c")}}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "s:struct<a:int>" in plan and "l:array<struct<c:int>>" in plan and "raw" not in plan.split("ReadSchema")[1]
    assert out.head()[0] == '{"s":{"a":1},"l":[{"e":1}]}'


def test_local_images_by_the_digest_of_their_address(spark):
    import hashlib

    name = hashlib.sha256(b"http://i/1").hexdigest()[:32] + ".webp"
    rows = spark.createDataFrame([("1", "http://i/1", None), ("2", "http://i/2", None), ("3", "http://i/1", "mine.jpg"), ("4", None, "")], "id string, image_url string, local_image_url string")
    got = {r.id: r.local_image_url for r in products.with_local_image(rows, spark.createDataFrame([(name,), ("x.jpg",)], "name string")).collect()}
    assert got == {"1": f"thumbs/{name}", "2": None, "3": "mine.jpg", "4": None}


# ---- documents


def test_redaction_of_any_shape(spark):
    docs = ['[[{"db":1,"k":["Bearer x", {"path":"p","q":null}]}]]', '{"a":' * 3 + "1" + "}" * 3, "[1, 2", None, '"token=abc"', "[" * 100_000, json.dumps(["x" * 900] * 300)]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(variant.redacted("d")).collect()]
    assert got[:5] == ['[[{"k":["[REDACTED]x",{"q":null}]}]]', '{"a":{"a":{"a":1}}}', None, None, '"[REDACTED]abc"'] and got[5] is None
    assert [len(x) for x in json.loads(got[6])] == [500] * 200


def test_fields_by_several_paths(spark):
    docs = ['{"a":{"b":""},"c":0,"d":"x"}', '{"a":{"b":[1]},"c":false,"d":7}', '{"a":1}', "[1]", "{", None]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(variant.text_at(variant.parsed(F.col("d")), "$.a.b", "$.c", "$.d").alias("x"))
    assert [r.x for r in df.collect()] == ["x", "7", None, None, None, None]


# ---- ranks


def hot_values(n=6000):
    rng = random.Random(4)
    data = [("hot" if i % 10 else rng.choice(["a", "b", None]), rng.choice([rng.random(), round(rng.random(), 1), 0.5, None])) for i in range(n)]
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return data, groups


@pytest.mark.parametrize("big,accuracy", [(1_000_000, 10_000), (100, 10_000), (100, 50)])
def test_medians_and_ranks_with_one_hot_key(spark, monkeypatch, big, accuracy):
    """One key has nine rows in ten: ranked as it is, bracketed by a fine sketch, and by a coarse one."""
    monkeypatch.setattr(ranks, "BIG", big)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    data, groups = hot_values()
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r.k: (r.n, r.median) for r in ranks.medians(df, ["k"], "v").collect()}
    assert got == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in groups.items()}
    every = [x for v in groups.values() for x in v]
    assert [tuple(r) for r in ranks.medians(df, [], "v").collect()] == [(len(every), pytest.approx(statistics.median(every)))]
    wanted = {0.25: lambda n: F.array(F.floor(n / 4)), 1.0: lambda n: F.array(n - 1, n - 2)}
    at = {(r.k, r.rank): r.value for r in ranks.at_ranks(df, ["k"], "v", wanted).collect()}
    assert at == {(k, i): sorted(v)[i] for k, v in groups.items() for i in {len(v) // 4, len(v) - 1, len(v) - 2}}
    quartiles = {r.k: (r.n, r.p25, r.p75) for r in market.exclusive_quartiles(df.withColumn("v", F.col("v") * 1000), "k", "v", least=100).collect()}
    assert quartiles == {k: (len(v), *(int(statistics.quantiles([x * 1000 for x in v], n=4)[i]) for i in (0, 2))) for k, v in groups.items()}


def test_only_values_near_a_wanted_rank_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BIG", 1000)
    monkeypatch.setattr(ranks, "ACCURACY", 1000)
    kept = []
    monkeypatch.setattr(ranks, "_ranged", lambda df, order, f=ranks._ranged: kept.append(df.count()) or f(df, order))
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).cast("double").alias("v"))
    assert ranks.medians(df, [], "v").head().median == 19_999.5 and kept[0] < 800


def test_round_robin_and_numbers_over_ranges(spark):
    data = [("h" if i % 10 else "t", i) for i in range(500)] + [(None, 600 + i) for i in range(5)]
    df = spark.createDataFrame(data, "g string, o long").repartition(5)
    got = sorted((r.place, r.turn, r.g, r.o) for r in windows.round_robin(df, "g", ["o"]).collect())
    turns = {}
    want = sorted((turns.setdefault((g, o), sum(1 for x, y in data if x == g and y <= o)), g or "", o) for g, o in data)
    assert [(x[0], x[1], x[2] or "", x[3]) for x in got] == [(i + 1, *x) for i, x in enumerate(want)]


# ---- entity resolution


def listings(spark, rng, n, titles, communes, wide=False):
    rows = []
    for i in range(n):
        rows.append((f"{rng.randrange(10**6):06d}x{i}", f"http://x/{rng.choice(['s1', 's2'])}" if rng.random() < 0.03 else f"http://x/{i}", rng.choice(titles), rng.choice(communes), rng.choice(["maison", "appartement", None]),
                     rng.choice([0, None, 810, 820, 860, 990] if not wide else range(950, 1050)), rng.choice([40.0, 41.0, 44.0, None]), rng.choice([2, 3, 0, None]), rng.choice(["a", "b"]), "d" * rng.randrange(4)))
    return spark.createDataFrame(rows, "id string, url string, title string, commune string, property_type string, rent_eur int, surface_m2 double, rooms int, source_site string, description string")


def all_pairs_groups(df):
    """Groups from every pair of a block and of an address, decided by the library's rule but paired by brute force."""
    rows = {r.id: r for r in entity.prepared(df).collect()}
    spark = df.sparkSession
    urls, blocks = {}, {}
    for r in rows.values():
        urls.setdefault(r.url_key, []).append(r.id)
    shared = {i for u, ids in urls.items() if u and len(ids) > 1 for i in ids}
    for r in rows.values():
        if r.price and r.surface and r.id not in shared:
            blocks.setdefault((r.commune, r.family, round(r.price / 100), round(r.surface / 10), r.rooms or 0), []).append(r.id)
    pairs = [(a, b, kind) for kind, groups in (("url", urls), ("block", blocks)) for key, ids in groups.items() if key for a, b in itertools.combinations(sorted(ids), 2)]
    if not pairs:
        return []
    row = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entity.prepared(df).schema)
    table = spark.createDataFrame([(rows[a], rows[b]) for a, b, _ in pairs], f"a struct<{row.replace(' ', ':').replace(',:', ',')}>, b struct<{row.replace(' ', ':').replace(',:', ',')}>")
    decided = {(r.a, r.b): r for r in entity._decided(table).collect()}
    up = {i: i for i in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    kept = []
    for a, b, kind in pairs:
        d = decided[a, b]
        if kind == "url" or d.decision != "distinct":
            kept.append((a, "auto_duplicate" if kind == "url" else d.decision, max(0.95, d.confidence) if kind == "url" else d.confidence))
            x, y = sorted((top(a), top(b)))
            up[y] = x
    groups = {}
    for i in rows:
        groups.setdefault(top(i), []).append(i)
    return sorted((tuple(sorted(v)), all(d == "auto_duplicate" for a, d, _ in kept if top(a) == k), max(c for a, _, c in kept if top(a) == k)) for k, v in groups.items() if len(v) > 1)


@pytest.mark.parametrize("cell", [256, 2])
def test_groups_are_those_of_all_pairs(spark, cell):
    rng = random.Random(cell)
    titles = ["Bel appartement vue mer", "Bel appartement avec vue mer", "Villa calme", "", None, "T3 lumineux proche plage", "zzz"]
    for n, communes in ((60, ["Saint-Denis", "Saint-Paul", None]), (40, ["Saint-Denis"])):
        df = listings(spark, rng, n, titles, communes).cache()
        got = sorted((tuple(r.member_ids), r.decision == "auto_duplicate", r.confidence) for r in entity.duplicate_groups(df, entity.duplicate_edges(df, cell)).collect())
        assert got == all_pairs_groups(df)


def test_a_crowded_block_is_linked_through_its_vectors(spark):
    """50,000 listings of one block, of few kinds: pairs are made of kinds, not of listings."""
    df = spark.range(50_000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("Appartement "), F.element_at(F.array(F.lit("vue mer"), F.lit("calme")), (F.col("id") % 2 + 1).cast("int"))).alias("title"),
        F.lit("Saint-Denis").alias("commune"), F.lit("appartement").alias("property_type"), (F.lit(980) + F.col("id") % 40).cast("int").alias("rent_eur"), F.lit(50.0).alias("surface_m2"), F.lit(2).alias("rooms"), F.lit("s").alias("source_site"), F.lit("").alias("description"),
    )
    edges = entity.duplicate_edges(df).cache()
    assert edges.count() < 60_000
    (group,) = entity.duplicate_groups(df, edges).collect()
    assert len(group.member_ids) == 50_000 and group.decision == "needs_review" and group.confidence == 1.0


def test_components_with_hubs(spark, monkeypatch):
    from rentgrid.operators import graph

    monkeypatch.setattr(graph, "PLAIN", 0)
    monkeypatch.setattr(graph, "HUB", 1 / 20)
    edges = [(500, i) for i in range(600, 700)] + [(i, i + 1) for i in range(100, 130)] + [(130, 600), (1, 2), (2, 3), (3, 1)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k for k, v in got.items() if v == 1} == {1, 2, 3} and {v for k, v in got.items() if k > 3} == {100} and len(got) == 3 + 31 + 101


@pytest.mark.parametrize("low", [610, 990])
def test_groups_of_crowded_blocks_are_those_of_all_pairs(spark, low):
    """Few titles, near prices and surfaces, and missing rooms, with which titles decide whether there is a link at all."""
    rng = random.Random(low)
    titles = ["villa calme", "villa tres calme", "terrain", "zzzz", "bel appartement vue mer", ""]
    rows = [(f"{rng.randrange(10**6):06d}{i}", f"http://x/{i}", rng.choice(titles), rng.choice(["Saint-Denis", "Saint-Paul"]), "maison", low + rng.randrange(40) * 2, rng.choice([16.0, 20.0, 23.0]), rng.choice([None, None, 0, 2]), "s", "d") for i in range(120)]
    rows += [(f"{i}x", f"http://y/{i}", "seul", "Saint-Leu", "maison", 800, 40.0, None, "s", "d") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, url string, title string, commune string, property_type string, rent_eur int, surface_m2 double, rooms int, source_site string, description string").cache()
    got = sorted((tuple(r.member_ids), r.decision == "auto_duplicate", r.confidence) for r in entity.duplicate_groups(df, entity.duplicate_edges(df)).collect())
    assert got == all_pairs_groups(df)
    assert (("0x", "1x", "2x"), False, 0.92) in got


def test_a_block_of_many_vectors_is_not_paired_off(spark):
    """1,000 different vectors of one block: their groups need about two pairs each, not 500,000 in all."""
    df = spark.range(1_000).select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.element_at(F.array(*[F.lit(c * 12) for c in "abcdefghij"]), (F.col("id") % 10 + 1).cast("int")).alias("title"),
        F.lit("Saint-Denis").alias("commune"), F.lit("appartement").alias("property_type"), F.expr("cast(950 + floor(id / 10) as int)").alias("rent_eur"), F.lit(50.0).alias("surface_m2"), F.lit(2).alias("rooms"), F.lit("s").alias("source_site"), F.lit("").alias("description"),
    )
    edges = entity.duplicate_edges(df).cache()
    assert edges.count() < 2_000
    (group,) = entity.duplicate_groups(df, edges).collect()
    assert len(group.member_ids) == 1_000 and group.decision == "needs_review" and group.confidence == 1.0

"""Operators on small tables written for the cases that matter."""

import datetime as dt
import itertools
import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as S

from rentgrid.functions import extract as X
from rentgrid.functions import geo, plain, query
from rentgrid.functions import numbers as N
from rentgrid.functions import text as T
from rentgrid.operators import coverage, entity, health, history, market, matching, profiles, windows, writes
from rentgrid.sources import documents, pages
from rentgrid.streaming import state


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).head().r


def ts(s):
    return dt.datetime.fromisoformat(s)


# ---- functions


def test_dialects_differ_where_they_should(spark):
    v = "  L'Étang-Salé_les  Bains, St Ours "
    got = {f.__name__: one(spark, v, f) for f in (T.norm_translate, T.norm_nfd_space, T.norm_alnum, T.norm_slug, T.norm_keep_accents, T.norm_lower, T.norm_search)}
    assert got == {
        "norm_translate": "l'etang sale_les bains, st ours", "norm_nfd_space": "l etang sale les bains, st ours", "norm_alnum": "l etang sale les bains st ours",
        "norm_slug": "l-etang-sale-les-bains-saint-ours", "norm_keep_accents": "l étang salé les bains st ours", "norm_lower": "l'étang salé_les bains, st ours",
        "norm_search": "l etang sale les bains saint ours",
    }
    assert one(spark, None, T.norm_alnum) == ""
    assert plain.fold(v) == got["norm_alnum"] and plain.fold_space(v) == got["norm_nfd_space"] and plain.slug(v) == got["norm_slug"]
    assert {"saint-denis", "saint denis", "st denis", "st-denis"} <= set(T.variants("Saint-Denis"))


@pytest.mark.parametrize("value, number", [("1 234,5 €", 1234.5), ("45 m²", 45.0), ("", None), ("abc", None), ("1 200", 1200.0), ("-3", -3.0), (None, None), ("1e3", 1000.0)])
def test_numbers_from_text(spark, value, number):
    assert one(spark, value, N.number_or_none) == number


def test_rounding_is_half_to_even(spark):
    got = [one(spark, v, N.as_int) for v in ("2.5", "3.5", "-2.5", "nan", "1e30", "x", "")]
    assert got == [2, 4, -2, None, None, None, None]
    assert [one(spark, v, lambda c: N.band(c, 25)) for v in ("37.5", "0", "x", None, "62.5")] == ["50", "?", "?", "?", "50"]


def test_first_present_keeps_zero_and_skips_empty(spark):
    df = spark.createDataFrame([("", "b", 0), ("a", "b", 1), (None, None, None)], "x string, y string, n int")
    assert [r.r for r in df.select(N.first_present(df, "x", "gone", "y").alias("r")).collect()] == ["b", "a", None]
    assert [r.r for r in df.select(N.first_present(df, "n", kind="int").alias("r")).collect()] == [0, 1, None]


def test_exclusive_percentile_matches_the_standard_library(spark):
    import statistics

    for values in ([3.0, 1.0, 2.0, 10.0], [1.0, 2.0], [5.0] * 7 + [1.0], [float(i * i % 17) for i in range(30)]):
        q = statistics.quantiles(values, n=100)
        assert [pytest.approx(q[p - 1]) for p in (25, 50, 75)] == [one(spark, values, lambda c, p=p: N.quantile_exclusive(c, p), "array<double>") for p in (25, 50, 75)]


# ---- extraction


def test_facts_of_a_description(spark):
    text = "Appartement T3 meublé 65,5 m2, 12 bis rue Victor Hugo, 2ème étage sans ascenseur, 2 chambres, deux salles de bains, WC séparés, parking. Loyer 1 150 € charges comprises : 80 €"
    d = one(spark, text, X.details)
    assert (d.address, d.floor, d.has_elevator, d.furnished, d.bedrooms, d.charges_eur) == ("12 bis rue Victor Hugo", "2e etage", 0, 1, 2, 80)
    c = one(spark, text, X.comfort)
    assert (c.nb_sdb, c.wc_separe, c.parking, c.jardin) == (2, 1, 1, None)
    assert one(spark, text, X.rent) == 1150 and one(spark, text, X.surface) == 65.5
    assert one(spark, "3 pièces à 99 €", X.rent) is None and one(spark, "3 pièces à 99 €", X.rooms) == 3
    assert [one(spark, v, X.furnished_status) for v in ("T2 non meublé", "T2 meublé", "loué vide", "T2", None)] == ["Non meublé", "Meublé", "Non meublé", "Non précisé", "Non précisé"]


PAGE = """<html><head><title>Villa &amp; jardin</title><meta property="og:title" content="Villa T4 à Saint-Denis"><meta content="Belle villa de 120 m2, loyer 1800 €" name="description">
<script type="application/ld+json">{"@type":"WebPage","address":"1 rue de l'Agence","mainEntity":{"@type":"House","geo":{"latitude":"-20.9","longitude":"55.48"},"address":{"streetAddress":"5 rue Pasteur"},"image":["http://i/a.jpg","http://i/logo.png"]}}</script></head>
<body><a href="/annonce/1">x</a><a href="/annonce/1">x</a><a href='/b'>y</a><iframe src="https://maps?q=48.85,2.35"></iframe><p>Parking</p></body></html>"""


def test_page_facts_belong_to_the_property_not_the_agency(spark):
    df = spark.createDataFrame([("http://x/annonce/saint-denis-1.html", PAGE), ("http://x/none", None)], "url string, html string")
    a, b = sorted(pages.page_details(df).collect(), key=lambda r: r.url)
    assert (a.street, a.lat, a.precision, a.parking) == ("5 rue Pasteur", -20.9, "rue", 1) and "Agence" not in str(a.address)
    assert b.precision == "inconnu" and b.geo_source == "aucun"
    d = {r.url: r for r in pages.detail_pages(df, "p").collect()}["http://x/annonce/saint-denis-1.html"]
    assert (d.title, d.price, d.surface, d.city) == ("Villa T4 à Saint-Denis", 1800, 120.0, "Saint-Denis")
    assert pages.galleries(df).where("url like '%1.html'").head().images == ["http://i/a.jpg"]
    assert one(spark, PAGE, lambda c: X.links(c, "/annonce")) == ["/annonce/1"]
    assert one(spark, "<iframe src='https://maps?q=48.85,2.35'>", X.coordinates) is None  # a point outside the market is not taken


def test_scans_of_cards_feeds_and_offers(spark):
    card = "<article><a href='http://x/annonce/locations/t2-77.html'></a><h2 class='ville-type'><a title='T2 45 m2'>t</a></h2><div class='price-result'><b> 750 €</b></div></article>"
    df = spark.createDataFrame([("u", card + card + "<article>no</article>")], "url string, html string")
    r = pages.cards(df, pages.PORTALS["articles"]).collect()
    assert [(x.source_id, x.price, x.surface) for x in r] == [("77", 750, 45.0)]
    rss = "<rss><item><title><![CDATA[Location T3]]></title><link>http://x/123/a</link><description>Loyer 900 € à Saint Paul</description></item><item><title>Vente</title><link>http://y</link></item></rss>"
    r = pages.rss_items(spark.createDataFrame([(rss,)], "html string"), "rss").collect()
    assert [(x.source_id, x.city, x.price) for x in r] == [("123", "Saint-Paul", 900)]
    items = [{"id": "1", "title": "Location T2", "price": "800", "location": "REU"}, {"id": "2", "title": "Location", "price": "90", "location": "REU"}, {"id": "3", "title": "Location", "price": "800", "location": "X"}]
    for payload in (items, {"items": items}, {"data": items}):
        assert [x.source_id for x in pages.api_offers(spark.createDataFrame([(json.dumps(payload),)], "value string"), "api", "REU").collect()] == ["1"]
    escaped = '{"u":"https:\\/\\/x.re\\/a-louer-1","v":"https:\\/\\/x.re\\/vente-2"}'
    assert [x.url for x in pages.escaped_links(spark.createDataFrame([(escaped,)], "html string"), "https://x.re/", "/a-louer-").collect()] == ["https://x.re/a-louer-1"]


def test_contact_data_is_removed_or_masked(spark):
    assert one(spark, "Appelez 0692 12 34 56 ou a.b@c.re, http://x.y/z ?page=2", X.public_text) == "Appelez ou , ?"
    assert X.mask("tél 0692 123 456, réf 123456, a@b.co") == ("tél [téléphone masqué], réf 123456, [email masqué]", 1, 1)
    assert one(spark, None, X.public_text) is None


# ---- places


def test_location_inference(spark):
    rows = [
        ("Sainte Clotilde LA BRETAGNE", None, None, "Saint-Denis"), ("T2 à Sainte Marie", "près de Sainte-Suzanne", None, None), ("Vue sur la montagne", "belle vue sur la montagne", None, "Saint-Paul"),
        ("La Montagne T3", None, None, "Saint-Denis"), ("Sainte-Clotilde Moufia", None, None, None), ("Studio", None, None, "Cilaos"), ("Studio", None, None, None), ("grand beau séjour", None, None, "Saint-Paul"),
    ]
    df = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "i int, title string, description string, url string, commune string, region string")
    out = geo.infer_location(df)
    assert set(out.columns) == {*df.columns, "location"}
    got = [(r.location.commune_inferred, r.location.district_best) for r in out.orderBy("i").collect()]
    assert got == [
        ("Saint-Denis", "La Bretagne"), ("Sainte-Marie", None), ("Saint-Denis", None), ("Saint-Denis", "La Montagne"), ("Saint-Denis", "Moufia"), ("Cilaos", None), ("Non précisée", None), ("Saint-Paul", None),
    ]
    assert one(spark, "Tampon centre", geo.out_of_scope) and not one(spark, "Sainte-Marie", geo.out_of_scope) and not one(spark, None, geo.out_of_scope)
    assert one(spark, "97438 Duparc", geo.strict_commune) == "Sainte-Marie" and one(spark, "Beauséjour", geo.strict_commune) is None


# ---- queries


def test_query_parser_properties(spark):
    f = query.parse("F4 non meublé Beauséjour 900")
    assert (f.rooms, f.furnished, f.locations, f.price, f.price_op) == ([4], False, ["Beauséjour"], 900, "")
    assert query.parse("T4 NON MEUBLE beausejour 900") == query.parse("F4 non meublé Beauséjour 900")
    assert query.parse("studio entre 500 et 800 parking").amenities == ["Parking"] and query.parse("entre 500 et 800").max_price == 800
    assert query.parse("moins de 900").max_price == 900 and query.parse("plus de 900").min_price == 900 and query.parse("autour de 900").price_op == "around" and query.parse("= 900").price_op == "equal"
    assert query.replace_price("T3 900", 900, "max") == "T3 moins 900" and query.without("T3 meublé 900 €", "rooms") == "meublé 900 €"
    rows = [(str(i), f"T{1 + i % 5} jardin", "Saint-Denis", 400 + 50 * i, "Meublé" if i % 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, title string, commune string, rent_eur int, furnished string").withColumn("rooms", F.substring("title", 2, 1).cast("int"))
    n = lambda q: query.search(df, query.parse(q)).count()
    counts = [n(f"moins de {p}") for p in (500, 700, 900, 2000)]
    assert counts == sorted(counts) and counts[-1] == 20 and n("meublé") + n("non meublé") == 20 and n("jardin saint denis") == 20 and n("piscine") == 0


def test_query_grammar():
    f = query.parse("T3 st denis 60m2 entre 600 et 900 avec garage r2d2 vue mer")
    assert (f.rooms, f.min_surface, f.min_price, f.max_price, f.locations, f.amenities) == ([3], 60, 600, 900, ["Saint-Denis"], ["Parking"])
    assert f.tokens == ["r2d2", "vue", "mer"]
    f = query.parse("villa 4 pieces >= 700 location nue", {})
    assert (f.kind, f.rooms, f.price_op, f.min_price, f.furnished) == ("maison", [4], "min", 700, False)
    assert query.parse("", {}) == query.parse(None, {}) == query.FilterSpec() and query.parse("95000 12 m²", {}).price is None


def test_groups_beyond_ten_thousand_keep_their_numbers(spark):
    df = spark.range(1, 10_003).select(F.col("id").cast("string").alias("root"))
    out = windows.numbered(df, "root")
    got = [(r.root, r.number) for r in out.orderBy("number").collect()]
    assert got == [(x, i + 1) for i, x in enumerate(sorted(str(i) for i in range(1, 10_003)))]
    edges = spark.range(0, 20_002, 2).select(F.format_string("%06d", F.col("id")).alias("a"), F.format_string("%06d", F.col("id") + 1).alias("b"), F.lit("auto_duplicate").alias("decision"), F.lit(0.9).alias("confidence"))
    groups = entity.duplicate_groups(spark.createDataFrame([], "id string, source_site string"), edges)
    ids = sorted((r.member_ids[0], r.group_id) for r in groups.collect())
    assert ids[0][1] == "D0001" and ids[9999][1] == "D10000" and ids[10_000][1] == "D10001" and len({i for _, i in ids}) == 10_001


def test_json_ld_rules():
    page = """<script type="application/ld+json">{"@type":"RealEstateAgent","address":{"streetAddress":"agency"},"image":"logo.png",
     "makesOffer":{"@type":"Apartment","numberOfRooms":3,"address":{"@type":"PostalAddress","streetAddress":"1 rue A","postalCode":97400},
     "geo":[{"latitude":"x","longitude":1},{"latitude":"-20.9","longitude":55.4}],"image":[{"url":"a.jpg"},"b.jpg","a.jpg"]}}</script>
     <script type='application/ld+json'>not json</script>"""
    f = X.property_facts(page)
    assert (f["street"], f["postal_code"], f["lat"], f["lon"], f["bedrooms"], f["images"]) == ("1 rue A", "97400", -20.9, 55.4, 3, ["a.jpg", "b.jpg"])
    assert X.property_facts(None)["images"] == [] and X.property_facts(None)["lat"] is None


# ---- writes, history


def test_ingest_last_of_a_key_wins_and_keyless_rows_are_counted(spark):
    base = spark.createDataFrame([], "source string, site_id string, prix int, first_seen_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([("a", "1", 10, 0), ("a", "2", 20, 1), ("a", "1", 11, 2), ("a", None, 5, 3), ("b", "1", 9, 4)], "source string, site_id string, prix int, pos int")
    out = writes.upsert(base, batch, ["source", "site_id"], F.lit("2024-01-01").cast("timestamp"), "pos")
    assert sorted((r.source, r.site_id, r.prix) for r in out.collect()) == [("a", "1", 11), ("a", "2", 20), ("b", "1", 9)]
    assert writes.skipped(batch, ["source", "site_id"]).head() == Row(processed=5, skipped=1)
    again = writes.upsert(out, batch, ["source", "site_id"], F.lit("2024-01-02").cast("timestamp"), "pos")
    assert {(r.first_seen_at.day, r.updated_at.day) for r in again.collect()} == {(1, 2)}


def test_deactivation_touches_one_source_and_needs_a_batch(spark):
    base = spark.createDataFrame([("s", str(i), 1) for i in range(7)] + [("t", "0", 1)], "source_site string, source_id string, is_active int")
    seen = spark.createDataFrame([(str(i),) for i in range(5)], "source_id string")
    assert writes.deactivate_unseen(base, seen, "s").where("is_active = 0").count() == 2
    assert writes.deactivate_unseen(base, seen.where("false"), "s").where("is_active = 0").count() == 0


def test_three_snapshots(spark):
    state_ = spark.createDataFrame([], "id string, active boolean, rent_eur long, first_seen_at timestamp, last_seen_at timestamp")
    snaps = [[("1", 500), ("2", 600), ("3", None)], [("1", 450), ("2", 600), (" ", 1)], [("1", 450), ("2", 650), ("3", 700)]]
    seen = []
    for i, rows in enumerate(snaps):
        d = history.snapshot(state_, spark.createDataFrame(rows, "id string, rent_eur long"), F.lit(f"2024-01-0{i + 1}").cast("timestamp"))
        seen.append(sorted((r.listing_id, r.event_type, r.old_value, r.new_value) for r in history.events_of(d).collect()))
        state_ = spark.createDataFrame(history.next_state(d).collect(), state_.schema)
    assert seen[0] == [("1", "new", None, "500"), ("2", "new", None, "600"), ("3", "new", None, None)]
    assert seen[1] == [("1", "price_changed", "500", "450"), ("3", "disappeared", "1", "0")]
    assert seen[2] == [("2", "price_changed", "600", "650"), ("3", "reappeared", "0", "1")]


def test_stream_of_snapshots_gives_the_batch_events(spark, tmp_path):
    src, n = str(tmp_path / "in"), itertools.count()
    steps = [[("1", True, 500.0), ("2", True, 600.0)], [("1", True, 450.0), ("2", False, None)], [("2", True, 600.0)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame([(a, ts(f"2024-01-0{i + 1}T00:00:00"), b, c) for a, b, c in rows], "id string, event_at timestamp, seen boolean, rent_eur double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id string, event_at timestamp, seen boolean, rent_eur double").option("maxFilesPerTrigger", 1).parquet(src)
    name = f"events_{next(n)}"
    q = state.listing_events(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted((r.listing_id, r.event_type, r.old_value, r.new_value) for r in spark.table(name).collect())
    assert got == [("1", "new", None, "500"), ("1", "price_changed", "500", "450"), ("2", "disappeared", "1", "0"), ("2", "new", None, "600"), ("2", "reappeared", "0", "1")]


def test_ledger_is_written_once_a_pair(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([(1, 1, 0)], "watch_id long, listing_id long, batch long").write.parquet(path)
    write = state.ledger_writer(path, ["watch_id", "listing_id"])
    batch = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "watch_id long, listing_id long")
    write(batch, 7)
    write(batch, 7)  # replayed
    assert spark.read.parquet(path).count() == 3


# ---- matching, profiles, health


def test_watch_limit_is_taken_after_the_ledger(spark):
    rows = [(1, "a", "x", 900, "T2 appartement a louer"), (2, "a", "x", 800, "T3 appartement location"), (3, "a", "x", 700, "vente appartement"), (4, "a", "y", 700, "location maison")]
    df = spark.createDataFrame(rows, "id long, source string, commune string, prix int, title string").withColumns({"site_id": F.col("id").cast("string"), "url": F.lit(""), "surface": F.lit(50.0)})
    watch = [(1, {"commune": "X", "transaction": "location", "type": ["appartement"], "prix_max": 950, "limit": 1})]
    ledger = spark.createDataFrame([], "watch_id long, listing_id long")
    sent = []
    for _ in range(3):
        new = [(r.watch_id, r.listing_id) for r in matching.to_notify(df, watch, ledger).collect()]
        sent.append(new)
        ledger = ledger.unionByName(spark.createDataFrame(new, ledger.schema))
    assert sent == [[(1, 1)], [(1, 2)], []]


def test_saved_search_zone_is_vetoed_by_a_conflicting_place(spark):
    rows = [("1", "T2 Beauséjour", "Sainte-Marie", 800), ("2", "T2 beau sejour Saint-Paul", "Beauséjour", 800), ("3", "T2", "Beausejour", None), ("4", "Beauséjour près Saint Paul", None, 700)]
    df = spark.createDataFrame(rows, "id string, title string, commune string, rent_eur int").withColumn("description", F.lit(None).cast("string"))
    p = matching.search_predicate(df, {"zones": ["Beauséjour"], "rentMax": 900}, {}, {"Beauséjour": ["saint paul"]})
    assert [r.id for r in df.where(p).orderBy("id").collect()] == ["1", "4"]
    assert matching.validate({"searches": [{"id": "Bad Id"}, {"id": "ok"}, {"id": "ok", "filters": {"rentMax": "x"}}], "max_items_per_search": 99}) == [
        "max_items_per_search must be a number from 1 to 20", "searches[0].id must be a lower-case slug of 2 to 64 characters", "searches[2].filters.rentMax must be numeric", "searches: the id 'ok' is used 2 times",
    ]


def test_profiles_strict_fallback_and_near_miss(spark):
    p = {"id": "p", "criteria": {"zones": ["Duparc"], "rent_min_eur": 500, "rent_max_eur": 1000, "surface_min_m2": 50, "furnished_preference": "Non meublé"}, "fallbacks": {"furnished": ["Non précisé"]}}
    rows = [("1", "Duparc", 900, 60.0, "Non meublé"), ("2", "Duparc", 900, 60.0, None), ("3", "Duparc", 1060, 60.0, "Non meublé"), ("4", "Duparc", 900, 47.0, "Non meublé"), ("5", "Duparc", 1500, 60.0, "Non meublé"), ("6", "Moufia", 900, 60.0, "Non meublé")]
    df = spark.createDataFrame(rows, "id string, title string, rent_eur int, surface_m2 double, furnished string")
    got = {r.id: (r.decision, r.misses) for r in profiles.profile_matches(df, [p]).collect()}
    assert got == {"1": ("strict_match", []), "2": ("fallback_match", []), "3": ("near_miss", ["rent_above_target:1060>1000"]), "4": ("near_miss", ["surface_below_target:47<50"])}


def test_source_ages(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = [("a", "2024-01-08 00:00:00", 1), ("b", "2024-01-01 16:00:00", 1), ("c", "2024-01-09 23:00:00", 0), ("d", None, 1)]
    df = spark.createDataFrame(rows, "source_site string, seen string, is_active int").withColumn("seen_last_at", F.col("seen").cast("timestamp"))
    out = health.classify_sources(health.source_stats(df, active=F.col("is_active") == 1), ["a", "e"], now, ["b"])
    assert {r.source: (r.status, r.severity) for r in out.collect()} == {"a": ("aging", "warning"), "b": ("stale", "high"), "c": ("empty", "medium"), "d": ("unknown", "medium"), "e": ("empty", "medium")}


def test_run_alert_states(spark):
    runs = [(1, "s", "2024-01-01", "ok", 100, "h"), (2, "s", "2024-01-02", "ok", 100, "h"), (3, "s", "2024-01-03", "ok", 30, "g"), (4, "t", "2024-01-03", "error", 0, None)]
    df = spark.createDataFrame(runs, "id long, source string, ran_at string, statut string, n_rows long, structure_hash string").withColumn("ran_at", F.col("ran_at").cast("timestamp"))
    got = {(r.source, r.kind) for r in health.run_alerts(df, ["s", "t", "u"], F.lit("2024-01-03 12:00:00").cast("timestamp"), 30).collect()}
    assert got == {("s", "structure_hash_changed"), ("s", "n_rows_collapse"), ("t", "latest_not_ok"), ("t", "no_ok_runs"), ("u", "no_runs"), ("u", "no_ok_runs")}


# ---- duplicates


def test_duplicate_groups_keep_the_invariants(spark):
    rows = [
        ("a", "http://x/1?r=1", "Bel appartement vue mer", "Saint-Denis", 800, 50.0, 2, "s1", "long text"), ("b", "http://x/1#z", "Autre titre", "Saint-Denis", 900, 60.0, 3, "s2", ""),
        ("c", "http://x/3", "Villa calme piscine", "Saint-Paul", 1500, 120.0, 5, "s1", ""), ("d", "http://x/4", "Villa calme piscine", "Saint-Paul", 1510, 121.0, 5, "s2", "more"),
        ("e", "http://x/5", "Studio", "Saint-Leu", 400, 20.0, 1, "s1", ""), ("f", None, "Studio centre", "Saint-Leu", None, None, None, "s1", ""),
    ]
    df = spark.createDataFrame(rows, "id string, url string, title string, commune string, rent_eur int, surface_m2 double, rooms int, source_site string, description string").withColumn("property_type", F.lit("appartement"))
    groups = entity.duplicate_groups(df, entity.duplicate_edges(df))
    g = {r.group_id: r for r in groups.collect()}
    assert {tuple(r.member_ids) for r in g.values()} == {("a", "b"), ("c", "d")} and sorted(g) == ["D0001", "D0002"]
    assert g["D0001"].canonical_id == "a" and g["D0002"].canonical_id == "d" and all(r.decision == "auto_duplicate" and r.canonical_id in r.member_ids for r in g.values())
    shown = {r.id for r in entity.annotate(df, groups).where("display_canonical").collect()}
    assert shown == {"a", "d", "e", "f"} and entity.annotate(df, groups).count() == 6


def test_title_ratio_is_ratcliff_obershelp(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("villa calme", "villa au calme"), ("", "x"), (None, None)], "a string, b string")
    got = [r.r for r in df.select(entity.title_ratio("a", "b").alias("r")).collect()]
    assert got == [pytest.approx(SequenceMatcher(None, a, b).ratio()) for a, b in (("villa calme", "villa au calme"), ("", "x"), ("", ""))]


# ---- documents


def test_documents_bare_and_wrapped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {}, "listings": [{"id": "3"}, None, {"id": "4"}]}))
    schema = S.StructType().add("id", "string")
    assert sorted(r.id for r in documents.listings(spark, str(tmp_path / "a.json"), schema).collect()) == ["1", "2"]
    assert sorted(r.id for r in documents.listings(spark, str(tmp_path / "b.json"), schema).collect()) == ["3", "4"]
    assert documents.sidecar(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_public_contract_of_both_dialects(spark):
    df = spark.createDataFrame([("s", "9", "700 €", 45.5, ["i2"], "i1", None)], "source_site string, source_id string, rent_eur string, surface_m2 double, image_urls array<string>, image_url string, display_canonical boolean")
    r = documents.public_contract(df).head()
    assert (r.source, r.price, r.surface, r.image_urls, r.display_canonical, r.city) == ("s", 700.0, 45.5, ["i1", "i2"], True, "")
    assert [f.name for f in documents.public_contract(df).schema] == [f.name for f in documents.CONTRACT]


def test_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([], "id string, title string, commune string, property_type string, rent_eur int, surface_m2 double, rooms int, url string, source_site string, description string")
    assert entity.duplicate_groups(df, entity.duplicate_edges(df)).count() == 0
    assert market.opportunity(df).count() == 0 and coverage.field_coverage(df, ["title"]).head().percent == 0.0
    assert windows.round_robin(df, "source_site", ["id"]).count() == 0


@pytest.mark.parametrize("crowd", [1, 40])
def test_nearest_places_are_those_of_all_pairs(spark, crowd):
    """Sparse and crowded cells, ties, a place on a row, rows without a spot, and ids that repeat."""
    rng = random.Random(crowd)
    at = lambda: (rng.randrange(-300, 300) / 100, rng.randrange(-300, 300) / 100)
    rows = [(i // 2, *at()) for i in range(200)] + [(7, 0.0, 0.0), (8, None, 0.0), (9, 50.0, 50.0)]
    places = [(f"p{i:05d}", *at()) for i in range(100 * crowd)] + [(f"q{i:05d}", 1 + rng.random() / 1000, 1 + rng.random() / 1000) for i in range(10 * crowd)] + [("none", None, None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, id int, lat double, lon double")
    got = {r.n: (r.id, r.place) for r in windows.nearest_place(df, spark.createDataFrame(places, "place string, lat double, lon double"), "lat", "lon", 0.25, "id").collect()}
    far = lambda r, p: math.sqrt((p[1] - r[1]) ** 2 + (p[2] - r[2]) ** 2)
    want = {}
    for n, r in enumerate(rows):
        met = [(far(r, p), p[0]) for p in places if p[1] is not None and r[1] is not None and far(r, p) < 0.25]
        want[n] = (r[0], min(met)[1] if met else None)
    assert got == want


def test_nearest_place_meets_each_spot_once(spark):
    """Many rows and places on few spots of a few cells: 2,000 million pairs of rows and places, 90,000 of spots."""
    spot = lambda n: ((F.col("id") * n) % 300) / 6000
    rows = spark.range(100_000).select("id", spot(7).alias("lat"), spot(11).alias("lon"))
    places = spark.range(20_000).select(F.col("id").alias("place"), spot(13).alias("lat"), spot(17).alias("lon"))
    met = windows.nearest_place(rows, places, "lat", "lon", 0.045, "id").cache()
    assert met.count() == 100_000 and met.where("place >= 300").count() == 0 and met.select("lat", "lon", "place").distinct().count() == 300

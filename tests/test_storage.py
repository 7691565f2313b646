"""Files, feeds, stored pages and versions of tables, also where they are broken or a run dies in between."""

import datetime

import pytest
from pyspark.sql import functions as F

from rentgrid.functions import housing
from rentgrid.operators import tables
from rentgrid.sources import files, pages


@pytest.fixture
def table(spark, tmp_path):
    return tables.VersionedTable(spark, str(tmp_path / "table"), "source")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, source string")


def ids(t, version=None):
    return sorted(r.id for r in t.read(version).collect())


def test_a_run_that_dies_before_the_swap_leaves_the_old_table(spark, table, monkeypatch):
    assert table.current() is None and table.manifest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.publish(table.stage(rows(spark, (1, "a"), (2, "b")), "one"))
    monkeypatch.setattr(table, "_swap", lambda name, text, f=table._swap: (_ for _ in ()).throw(OSError("died")) if name == "CURRENT" else f(name, text))
    staged = table.stage_append(rows(spark, (3, None)), "two")
    with pytest.raises(OSError):
        table.publish(staged)
    monkeypatch.undo()
    assert ids(table) == [1, 2]
    table.append(rows(spark, (3, None)), "two")  # the next run does it again, and once
    table.append(rows(spark, (3, None)), "two")
    assert ids(table) == [1, 2, 3] and table.manifest()["sources"] == {"a": 1, "b": 1, "unknown": 1} and table.manifest()["batches"] == ["one", "two"]


def test_guards_conflicts_and_the_way_back(spark, table):
    table.publish(table.stage(rows(spark, *[(i, "a" if i < 3 else "b") for i in range(10)]), "one"))
    first = table.current()
    for thin, why in ((range(8), "dropped from"), (range(3, 12), "a dropped")):
        with pytest.raises(tables.Conflict, match=why):
            table.publish(table.stage(rows(spark, *[(i, "a" if i < 3 else "b") for i in thin]), "thin"), critical=("a",))
    left, right = (table.stage(rows(spark, *[(i, "a" if i < 3 else "b") for i in range(n)]), f"n{n}") for n in (10, 11))
    table.publish(right)
    with pytest.raises(tables.Conflict, match="meanwhile"):
        table.publish(left)
    with pytest.raises(tables.Conflict, match="rows"):
        table.roll_back(least=400)
    assert table.roll_back() == first and ids(table) == list(range(10))
    with pytest.raises(tables.Conflict):
        table.roll_back()


def test_a_damaged_version_is_not_published(spark, table):
    staged = table.stage(rows(spark, (1, "a"), (2, "a")), "one")
    assert table.verify(staged) == []
    (folder,) = table.manifest(staged)["folders"]
    rows(spark, (1, "a"), (3, "a")).write.mode("overwrite").parquet(f"{table.root}/{folder}")
    assert table.verify(staged) == ["digest differ"]
    with pytest.raises(tables.Conflict):
        table.publish(staged)
    assert table.current() is None and table.verify("v-none") == ["no manifest"]


def test_runs_are_logged_with_their_errors(spark, tmp_path):
    log = tables.VersionedTable(spark, str(tmp_path / "runs"), "source")
    at = datetime.datetime(2024, 5, 1)
    assert tables.logged_run(log, "s", at, lambda: 1 / 0) is None
    assert tables.logged_run(log, "s", at + datetime.timedelta(hours=1), lambda: rows(spark, (1, "a"))).count() == 1
    got = {(r.statut, r.n_rows, r.error) for r in log.read().collect()}
    assert got == {("error", 0, "division by zero"), ("ok", 1, None)}


def test_sizes_digests_and_pages_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "d" / "deep").mkdir(parents=True)
    (tmp_path / "d" / "a.html").write_text("<title>T</title>\nline")
    (tmp_path / "d" / "deep" / "b.html").write_bytes(b"x" * 5000)
    (tmp_path / "d" / "c.txt").write_text("no page")
    folder = str(tmp_path / "d")
    sizes = files.sizes(spark, folder, "*.html").withColumn("name", files.below(F.col("path"), folder))
    assert sorted((r.name, r.bytes) for r in sizes.collect()) == [("a.html", 21), ("deep/b.html", 5000)]
    assert "content" not in sizes._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert {r.sha256 for r in files.digests(spark, folder, "c.txt").collect()} == {hashlib.sha256(b"no page").hexdigest()}
    assert {r.html for r in files.pages(spark, folder, "a.html").collect()} == {"<title>T</title>\nline"}
    assert files.sizes(spark, str(tmp_path / "none")).count() == 0
    items = spark.createDataFrame([("1", ["a.html", "deep/b.html", "gone", "a.html", ""], None), ("2", None, "deep/b.html"), ("3", None, None)], "id string, local_image_urls array<string>, local_image_url string")
    got = {r.id: (r.status, r.local_count, r.valid_local_count, r.bytes, r.issues) for r in files.image_quality(items, sizes).collect()}
    assert got == {"1": ("partial", 3, 1, 5021, ["missing_file", "too_small"]), "2": ("ok", 1, 1, 5000, []), "3": ("no_valid_local_image", 0, 0, 0, [])}


def test_feeds_are_read_as_xml(spark):
    feed = lambda body: f"<rss xmlns:x='u'><channel>{body}</channel></rss>"
    one = "<item><title><![CDATA[Location <T2> & co]]></title><link>http://a/12/x</link><x:title>other</x:title><description>Loyer 800 &#8364;</description></item>"
    docs = [feed(one), feed("<item><title>Location</title></item><item><title>Location é</title><link>http://a/b</link></item>"), feed(one).replace("</channel>", ""), "no xml", "", None]
    df = spark.createDataFrame([(d,) for d in docs], "html string")
    got = {(r.url, r.source_id, r.title, r.price) for r in pages.rss_items(df, "s").collect()}
    assert {x[0] for x in got} == {"http://a/12/x", "http://a/b"} and ("http://a/12/x", "12", "Location & co", 800) in got
    assert pages.broken_feeds(df).count() >= 2


@pytest.mark.parametrize("text,bedrooms,want", [("RDC avec une chambre. À l'étage: deux chambres", 3, (1, 2, "ok")), ("rdc 2 chambres; à l'étage 2 chambres", 3, (None, None, "conflict")), ("rdc 2 chambres", 0, (2, None, "ok")), ("chambres", 2, (None, None, "unknown")), (None, None, (None, None, "unknown"))])
def test_contradicting_bedrooms_are_hidden(spark, text, bedrooms, want):
    df = spark.createDataFrame([(text, bedrooms)], "t string, b int").select(housing.details(F.lit(None), F.col("t"), F.col("b"))["bedroom_distribution"].alias("d"))
    d = df.head().d
    assert (d.ground_floor_count, d.upstairs_count, d.status) == want


def test_crawler_fragments_are_removed(spark):
    df = spark.createDataFrame([("Beau T2.  Annonce Site collectée par CDP. commune serp_view=a&b search=x fin",)], "t string")
    assert df.select(housing.visible(F.col("t"))).head()[0] == "Beau T2.   fin" or df.select(F.regexp_replace(housing.visible(F.col("t")), " +", " ")).head()[0] == "Beau T2. fin"


def test_recovery_by_the_sources_own_rules(spark):
    from rentgrid.sources import recovery

    long = "Un texte qui décrit longuement ce logement, ses pièces, sa vue, ses voisins et le chemin qui mène à la plage du village."
    rows = [
        ("s", f'<script type="application/ld+json">{{"@type":["RealEstateListing"],"description":"{long} {long}"}}</script><script type="application/ld+json">bad</script>', None, None),
        ("s", '<meta content="repli" name="description"><script type="application/ld+json">{"@type":"Thing","description":"x"}</script>', None, None),
        ("c", None, None, "L'annonce a bien été ajoutée à vos favoris (97400) " + long), ("c", None, None, "x" * 90 + " Dans " + long), ("c", None, None, "court"),
        ("z", '<meta name="description" content="trop court">', '{"content":"bref"}', None), ("z", f'<meta name="description" content="{long}">', "[]", None), ("unknown", "<p>a</p>", "{}", "t"), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, html string, payload string, text string")
    got = {r.i: (r.method, r.recovered) for r in recovery.recovered(df, {"s": "structured", "c": "card", "z": "content"}).collect()}
    assert got == {0: ("structured", long), 1: ("structured", "repli"), 2: ("card", long), 3: ("card", "Dans " + long), 4: ("card", ""), 5: ("content", ""), 6: ("content", long), 7: (None, ""), 8: (None, "")}

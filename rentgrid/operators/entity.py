"""Entity resolution: fingerprints, blocked pairs, conservative decisions, groups and what to show."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from rentgrid.functions import extract as X
from rentgrid.functions import numbers as N
from rentgrid.functions import text as T
from rentgrid.operators.graph import components
from rentgrid.operators.lineage import cut
from rentgrid.operators.windows import numbered

# fixed values: words that say nothing about a listing's identity
KEY_STOPWORDS = ("appartement", "maison", "location", "louer", "pieces", "piece", "saint", "denis", "sainte", "marie", "reunion", "974")
TITLE_STOPWORDS = ("location", "appartement", "maison", "villa", "pieces", "piece", "saint", "sainte", "denis", "marie", "reunion", "974", "louer", "annonce", "immobilier", "m2", "dans", "avec", "pour", "une", "des", "les", "studio", "type", "appart", "centre", "ville")


def _without(tokens: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def title_key(title: Column) -> Column:
    """The first six telling words of a title, 48 characters at most."""
    words = F.split(F.translate(T.norm_translate(title), "'_,.;:/()[]{}", "             "), r"\s+")
    return F.left(F.array_join(F.slice(_without(F.filter(words, lambda w: F.length(w) > 2), KEY_STOPWORDS), 1, 6), " "), F.lit(48))


def fingerprint(city: Column, kind: Column, surface: Column, rent: Column, rooms: Column, title: Column) -> Column:
    parts = (city, kind, N.rounded_to(surface, 5).cast("string"), N.rounded_to(rent, 50).cast("string"), F.coalesce(rooms, F.lit(0)).cast("string"), title_key(title))
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def audit_fingerprint(city: Column, kind: Column, rent: Column, surface: Column, rooms: Column, title: Column) -> Column:
    parts = (T.norm_keep_accents(city), T.norm_keep_accents(kind), N.band(rent, 25), N.band(surface, 5), F.coalesce(F.nullif(rooms.cast("string"), F.lit("0")), F.lit("?")), F.left(T.norm_keep_accents(title), F.lit(40)))
    return F.concat_ws("|", *parts)


def property_family(*parts: Column) -> Column:
    t = T.norm_nfd_space(F.concat_ws(" ", *[T.text(p) for p in parts]))
    return F.when(T.contains_any(t, ["maison", "villa"]), "maison").when(T.contains_any(t, ["appartement", "studio", "duplex", "t1", "t2", "t3", "t4", "t5", "chambre"]), "appartement").otherwise("unknown")


def title_tokens(title: Column) -> Column:
    words = F.regexp_extract_all(T.norm_nfd_space(title), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(_without(words, TITLE_STOPWORDS), lambda w: ~w.rlike("^[0-9]+$")))


def token_overlap(a: Column, b: Column) -> Column:
    """Common words over the words of the shorter title; 0 if either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


@F.pandas_udf(S.DoubleType())  # type: ignore[call-overload]
def title_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two normalised titles, in id order."""
    ratio = lru_cache(maxsize=100_000)(lambda x, y: 1.0 if x == y else SequenceMatcher(None, x, y).ratio())
    for a, b in batches:
        yield pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def title_bound(a: Column, b: Column) -> Column:
    """What ``title_ratio`` is at most: only equal titles have all of their characters in common."""
    la, lb = F.length(a), F.length(b)
    return F.when(a == b, F.lit(1.0)).otherwise(2 * F.when(la == lb, la - 1).otherwise(F.least(la, lb)) / (la + lb))


def groups_by_key(df: DataFrame, key: str, id_col: str = "id", *rank: Column) -> DataFrame:
    """Rows with the size of their key's group, their rank in it by id, and the canonical id: the largest by
    ``rank`` and then id."""
    w = Window.partitionBy(key)
    best = F.max_by(id_col, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(id_col))).over(w)
    return df.withColumns({"group_size": F.count("*").over(w), "group_rank": F.row_number().over(w.orderBy(id_col)), "canonical_id": best}).withColumn("is_canonical", F.col("canonical_id") == F.col(id_col))


def duplicate_audit(df: DataFrame, key: str, source: str, least: int = 2) -> DataFrame:
    """Groups of a key with ``least`` rows at least: size, sources, whether they cross sources; cross-source ones first."""
    g = df.groupBy(key).agg(F.count("*").alias("size"), F.array_sort(F.collect_set(source)).alias("sources")).where(F.col("size") >= least)
    return g.withColumn("cross_source", F.size("sources") > 1)


PAIR_FIELDS = ("id", "commune", "price", "surface", "rooms", "family", "source", "url_key", "title_norm", "tokens")


def prepared(df: DataFrame) -> DataFrame:
    """What pairs are compared by, from id, title, url, commune, property_type, rent_eur, surface_m2, rooms, source_site."""
    return df.select(
        F.col("id").cast("string").alias("id"), T.norm_nfd_space(F.col("commune")).alias("commune"), N.as_int(F.col("rent_eur")).alias("price"), F.col("surface_m2").cast("double").alias("surface"),
        N.truthy(F.col("rooms").cast("int")).alias("rooms"), property_family(F.col("property_type"), F.col("title")).alias("family"), F.col("source_site").alias("source"),
        X.canonical_url(F.col("url")).alias("url_key"), T.norm_nfd_space(F.col("title")).alias("title_norm"), title_tokens(F.col("title")).alias("tokens"),
    )


def _score(a, b, same_commune: Column, title: Column, same_rooms: Column) -> Column:
    closeness = lambda x, y: F.when((x != 0) & (y != 0), F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(x, y, F.lit(1)).cast("double"))).otherwise(0.0)
    return (
        F.when(same_commune, 0.26).otherwise(0.0) + F.coalesce(closeness(a("price"), b("price")) * 0.24, F.lit(0.0)) + F.coalesce(closeness(a("surface"), b("surface")) * 0.22, F.lit(0.0))
        + title * 0.20 + F.when(same_rooms, 0.08).otherwise(0.0)
    )


def _tight(a, b) -> Column:
    return N.rel_close(a("price"), b("price"), 0.03, 35) & N.rel_close(a("surface"), b("surface"), 0.04, 3)


def _close(a, b) -> Column:
    return N.rel_close(a("price"), b("price"), 0.07, 70) & N.rel_close(a("surface"), b("surface"), 0.10, 8)


def _decided(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b structs) with score, decision, confidence, reason; the title ratio is computed once."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    p = pairs.withColumn("title_ratio", title_ratio(a("title_norm"), b("title_norm")))
    same_commune = (a("commune") != "") & (a("commune") == b("commune"))
    same_rooms = F.coalesce(a("rooms") == b("rooms"), F.lit(False))
    score = _score(a, b, same_commune, F.col("title_ratio"), same_rooms)
    p = p.withColumns(
        {
            "score": N.half_even(F.least(score, F.lit(1.0)), 3), "same_commune": F.coalesce(same_commune, F.lit(False)), "same_rooms": same_rooms,
            "same_family": (a("family") == b("family")) | (a("family") == "unknown") | (b("family") == "unknown"),
            "same_source": F.coalesce(a("source") == b("source"), F.lit(False)), "exact_url": F.coalesce((a("url_key") != "") & (a("url_key") == b("url_key")), F.lit(False)),
            "overlap": token_overlap(a("tokens"), b("tokens")), "tight": _tight(a, b), "close": _close(a, b),
            "rooms_differ": F.coalesce(a("rooms") != b("rooms"), F.lit(False)),
        }
    )
    veto = ~F.col("same_commune") | ~F.col("same_family") | F.col("rooms_differ")
    tight = F.col("same_commune") & F.col("same_rooms") & F.col("tight") & ~veto
    reason = (
        F.when(F.col("exact_url"), "exact_url")
        .when(tight & F.col("same_family") & ((F.col("title_ratio") >= 0.82) | (F.col("overlap") >= 0.75)), "strong_fingerprint")
        .when(tight & F.col("same_source") & (F.col("title_ratio") >= 0.94), "same_source_near_exact")
        .when(F.col("same_commune") & F.col("same_family") & F.col("close") & ~F.col("rooms_differ") & (F.col("score") >= 0.76), "similar")
        .otherwise("insufficient_evidence")
    )
    floor = F.when(F.col("reason") == "exact_url", 0.95).when(F.col("reason") == "strong_fingerprint", 0.88).when(F.col("reason") == "same_source_near_exact", 0.86).otherwise(0.0)
    decision = F.when(F.col("reason").isin("exact_url", "strong_fingerprint", "same_source_near_exact"), "auto_duplicate").when(F.col("reason") == "similar", "needs_review").otherwise("distinct")
    out = p.withColumn("reason", reason).withColumns({"decision": decision, "confidence": N.half_even(F.least(F.lit(1.0), F.greatest(F.col("score"), floor)), 3)})
    return out.select(a("id").alias("a"), b("id").alias("b"), "decision", "confidence", "reason", "score", N.half_even(F.col("title_ratio"), 3).alias("title_ratio"), N.half_even(F.col("overlap"), 3).alias("token_overlap"))


BLOCK = ["commune", "family", "_p", "_s", "_r"]
#: What a pair of a block is decided by, beside the block: rows that agree in all of it are one vector.  The source is not among
#: it: tight pairs of so much as a ratio of 0.82 are duplicates in a block, whatever their sources.
FEATURES = ["price", "surface", "rooms", "title_norm"]
#: Vectors of a block that are paired in one task.
CELL = 256
#: Scores are compared with what they may be at most, with room for their rounding.
ROOM = 0.0005 + 1e-9


def _vectors(rows: DataFrame) -> DataFrame:
    """Distinct feature vectors of the blocks, with their smallest and largest id.  No two rows of blocks share an address."""
    out = rows.groupBy(*BLOCK, *FEATURES).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    return out.withColumns({"url_key": F.lit(""), "source": F.lit(None).cast("string")})


def _as_row(id_: str) -> Column:
    return F.struct(*[(F.col(id_) if f == "id" else F.col(f)).alias(f) for f in PAIR_FIELDS])


def _fields(name: str):
    return lambda f: F.col(f"{name}.{f}")


def _ordered(x: str, y: str) -> Column:
    return F.when(F.col(f"{x}.id") < F.col(f"{y}.id"), F.struct(F.col(x).alias("a"), F.col(y).alias("b"))).otherwise(F.struct(F.col(y).alias("a"), F.col(x).alias("b")))


def _spanning(vectors: DataFrame) -> DataFrame:
    """Pairs (a, b) that link most of a block and tell most about it, as many as there are vectors: each vector with the one in
    the middle of its block (mid), and with the next of the same title by price and surface."""
    row = _as_row("low")
    star = vectors.select("mid", row.alias("y")).where("mid.id != y.id").select(F.col("mid").alias("x"), "y")
    chain = vectors.select(F.lag(row).over(Window.partitionBy(*BLOCK, "title_norm").orderBy("price", "surface", "low")).alias("x"), row.alias("y")).where("x is not null")
    return star.unionByName(chain).where(_close(_fields("x"), _fields("y"))).select(_ordered("x", "y").alias("p")).select("p.a", "p.b")


def _with_middle(vectors: DataFrame) -> DataFrame:
    """Vectors of blocks of several, with the one in the middle of the block (mid) and their number (_m)."""
    off = F.greatest(F.abs(F.col("price") - F.col("_p")) / 70, F.abs(F.col("surface") - F.col("_s")) / 8)
    return vectors.join(vectors.groupBy(*BLOCK).agg(F.min_by(_as_row("low"), F.struct(off, "low")).alias("mid"), F.count("*").alias("_m")).where("_m > 1"), BLOCK)


def _open(vectors: DataFrame, linked: DataFrame, own: DataFrame) -> DataFrame:
    """The vectors of blocks that other pairs than ``linked`` may still tell something about, with a name (root) of those that are
    linked to the middle, whether all edges known among these are automatic (auto), and the highest confidence of them (top)."""
    low, mid = F.col("low"), F.col("mid.id")
    rows = vectors.withColumns({"a": F.least(low, mid), "b": F.greatest(low, mid)}).join(linked.select("a", "b", F.lit(True).alias("_l")).distinct(), ["a", "b"], "left").drop("a", "b")
    rows = cut(rows.withColumn("root", F.when(F.col("_l"), mid).otherwise(low)).drop("_l", "mid"))
    root = lambda x: rows.select(F.col("low").alias(x), F.col("root").alias(f"root_{x}"))
    inner = linked.join(root("a"), "a").join(root("b"), "b").where("root_a = root_b").select("root_a", "decision", "confidence")
    seen = inner.unionByName(own.join(root("a"), "a").select("root_a", "decision", "confidence"))
    seen = seen.groupBy(F.col("root_a").alias("root")).agg(F.bool_and(F.col("decision") == "auto_duplicate").alias("auto"), F.max("confidence").alias("top"))
    rows = cut(rows.join(seen, "root", "left").withColumns({"auto": F.coalesce("auto", F.lit(True)), "top": F.coalesce("top", F.lit(0.0))}))
    more = (F.min("root") < F.max("root")) | F.bool_or(F.col("auto") | (F.col("top") < 1))
    return rows.join(rows.groupBy(*BLOCK).agg(more.alias("_more")).where("_more").drop("_more"), BLOCK)


def _paired(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of different vectors of an open block that may change its groups, as rows with real ids, smaller id first.

    Vectors that are not linked yet may be; of those that are, a pair may be the first that is no automatic duplicate, or
    have a higher confidence than any before.  All of it is bounded by what titles of their lengths have in common at most.

    A block is itself about as wide as the tolerances, so all of it must meet; but a crowded one is dealt into parts
    of about ``cell`` vectors and every pair of parts is a task's work of its own.  The title comparison depends on which id is
    smaller, so two vectors whose ids interleave are compared in both orders, as the pairs of their rows would be."""
    dealt = rows.withColumn("_parts", F.ceil(F.col("_m") / cell).cast("int")).withColumn("_part", F.pmod(F.xxhash64("low"), F.col("_parts")).cast("int"))
    row = F.struct(_as_row("low").alias("first"), F.col("high").alias("last"), "root", "auto", "top")
    left = dealt.select(*BLOCK, row.alias("x"), F.col("_part").alias("_i"), F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1)).alias("_j"))
    right = dealt.select(*BLOCK, row.alias("y"), F.col("_part").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_i"))
    pairs = left.join(right, [*BLOCK, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("x.first.id") < F.col("y.first.id")))
    x, y = _fields("x.first"), _fields("y.first")
    # only "distinct" is left for pairs whose prices or surfaces are not close, so their titles are never compared
    tight, same = _tight(x, y), x("title_norm") == y("title_norm")
    most = F.least(F.lit(1.0), _score(x, y, F.lit(True), title_bound(x("title_norm"), y("title_norm")), x("rooms").isNotNull()))
    linked = tight | (most >= 0.76 - ROOM)
    auto = tight & x("rooms").isNotNull() & (same | (token_overlap(x("tokens"), y("tokens")) >= 0.75))
    higher = (most >= F.col("x.top") + 0.001 - ROOM) | (tight & (F.col("x.top") < 0.88))
    telling = F.when(F.col("x.root") != F.col("y.root"), linked).otherwise((F.col("x.auto") & linked & ~auto) | higher)
    last = lambda p: F.col(f"{p}.first").withField("id", F.col(f"{p}.last"))
    order = lambda p, q: F.when(F.col(f"{p}.first.id") < F.col(f"{q}.last"), F.struct(F.col(f"{p}.first").alias("a"), last(q).alias("b")))
    return pairs.where(_close(x, y) & telling).select(F.explode(F.array_compact(F.array(order("x", "y"), order("y", "x")))).alias("p")).select("p.a", "p.b")


def duplicate_edges(df: DataFrame, cell: int = CELL) -> DataFrame:
    """Decided pairs that are not distinct, by exact address and by block: enough of them for the same groups as all.

    Blocks are commune, family, rounded price and surface, and rooms; rows that share an exact address
    are kept out of them, and so are rows without a commune, which no block decides alike.  The copies of an address are linked
    to the smallest id of it, and the rows of one feature vector to its smallest id, as they are all decided alike.  Different
    vectors are first linked by one pair or two each; then all pairs of a block are paired, once for each order of ids they have,
    that may still link some, make a group no automatic one, or give it a higher confidence."""
    rows = cut(prepared(df))
    with_url = rows.where("url_key != ''")
    lowest = with_url.groupBy("url_key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    exact = with_url.join(lowest, "url_key")
    heads = exact.where("id = low").select("url_key", F.struct(*PAIR_FIELDS).alias("a"))
    spokes = exact.where("id != low").select("url_key", F.struct(*PAIR_FIELDS).alias("b")).join(heads, "url_key").select("a", "b")
    by_url = _decided(spokes).withColumns({"decision": F.lit("auto_duplicate"), "reason": F.lit("exact_url"), "confidence": F.greatest(F.lit(0.95), F.col("confidence"))})
    free = rows.join(exact.select("id"), "id", "left_anti").where("price != 0 and surface != 0 and commune != ''")
    free = cut(free.withColumns({"_p": N.rounded_to(F.col("price"), 100), "_s": N.rounded_to(F.col("surface"), 10), "_r": F.coalesce("rooms", F.lit(0))}))
    vectors = cut(_vectors(free))
    own = _decided(vectors.where("n > 1").select(_as_row("low").alias("a"), _as_row("low").alias("b"))).where("decision != 'distinct'")
    several = cut(_with_middle(vectors))
    linked = cut(_decided(_spanning(several)).where("decision != 'distinct'"))
    by_block = linked.unionByName(_decided(_paired(_open(several, linked, own), cell)).where("decision != 'distinct'"))
    cols = [c for c in by_block.columns if c not in ("a", "b")]
    repeated = vectors.where("n > 1").select(*BLOCK, *FEATURES, "low")
    same = F.lit(True)
    for c in (*BLOCK, *FEATURES):
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"v.{c}"))
    copies = free.alias("f").join(repeated.alias("v"), same).where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    by_copy = copies.join(own.select("a", *cols), "a").select("a", "b", *cols)
    rank = F.struct(F.when(F.col("decision") == "auto_duplicate", 1).otherwise(0), F.col("confidence"))
    both = by_url.unionByName(by_block).unionByName(by_copy)
    return both.groupBy("a", "b").agg(F.max_by(F.struct(*cols), rank).alias("e")).select("a", "b", "e.*")


def duplicate_groups(df: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a group: group_id (D0001.. by smallest id), decision, confidence, canonical_id, member_ids, sources.

    A group is automatic only if all its edges are.  The canonical member is the largest by
    (was canonical, has a local image, length of description, score, id)."""
    edges = cut(edges)
    nodes = cut(components(edges))
    members = nodes.join(df.withColumn("node", F.col("id").cast("string")), "node", "left")
    col = lambda n, t: N.column(df, n, t)
    image = F.when(F.coalesce(col("local_image_url", "string"), F.lit("")) != "", 1).otherwise(0)
    rank = F.struct(
        F.when(F.coalesce(col("db_is_canonical", "boolean"), F.lit(True)), 1).otherwise(0), image, F.length(F.coalesce(col("description", "string"), F.lit(""))),
        F.coalesce(col("score", "int"), F.lit(0)), F.col("node"),
    )
    who = members.groupBy("root").agg(F.max_by("node", rank).alias("canonical_id"), F.array_sort(F.collect_set("node")).alias("member_ids"), F.array_sort(F.collect_set(F.coalesce(col("source_site", "string"), F.lit("?")))).alias("sources"))
    how = edges.join(nodes.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.bool_and(F.col("decision") == "auto_duplicate").alias("auto"), F.max("confidence").alias("confidence"))
    out = who.join(how, "root").withColumn("decision", F.when(F.col("auto"), "auto_duplicate").otherwise("needs_review"))
    number = F.col("number").cast("string")
    wide = F.concat(F.lit("D"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))  # lpad would cut longer ones
    return numbered(out, "root").withColumn("group_id", wide).select("group_id", "decision", "confidence", "canonical_id", "member_ids", "sources")


def annotate(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Listings with their group, role, and whether they are shown: only the other members of an automatic
    group are hidden, and every row is kept."""
    member = groups.select(F.explode("member_ids").alias("_m"), "group_id", F.col("decision").alias("dedup_decision"), F.col("canonical_id").alias("canonical_display_id"))
    out = df.join(member, F.col("id").cast("string") == F.col("_m"), "left").drop("_m")
    own = F.col("id").cast("string") == F.col("canonical_display_id")
    return out.withColumns({"role": F.when(own, "canonical").when(F.col("group_id").isNotNull(), "duplicate_or_variant"), "display_canonical": ~F.coalesce((F.col("dedup_decision") == "auto_duplicate") & ~own, F.lit(False))})

"""Places in texts.  Gazetteers are constants of a few hundred aliases: they become one
alternation each, so a text is read once a gazetteer and not once an alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import gazetteer as G
from rentgrid.functions import numbers as N
from rentgrid.functions import plain
from rentgrid.functions import text as T

UNKNOWN_CITY, UNKNOWN_REGION, UNKNOWN_ZONE = "Non précisée", "Région non précisée", "Zone non précisée"


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The entry of a constant table, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def padded(blob: Column) -> Column:
    """A normalised text as words between single spaces, so that whole words can be looked up plainly."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(blob, "[^a-z0-9]+", " ")), F.lit(" "))


def first_alias(words: Column, aliases: list[tuple[str, str]], within: bool = False) -> Column:
    """(alias, name) of the first alias of the list that the text holds as whole words (anywhere, if
    ``within``), or null.  The list is one constant, so the plan doesn't grow with it; ``words`` comes
    from ``padded``."""
    edge = "" if within else " "
    pairs = F.array(*[F.struct(F.lit(f"{edge}{plain.fold(a)}{edge}").alias("alias"), F.lit(n).alias("name")) for a, n in aliases])
    return T.bind(words, lambda w: F.get(F.filter(pairs, lambda p: F.contains(w, p["alias"])), F.lit(0)))


def all_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[T.clean(p) for p in parts])


def detect_commune(city: Column, district: Column, title: Column, description: Column, url: Column) -> Column:
    """The commune of a row: by postal code, then alias, then name, else the cleaned city."""
    blob = padded(T.norm_translate(all_text(city, district, title, description, url)))
    codes, names = list(G.POSTAL.items()), [(n, n) for n in G.CITY_NAMES]
    found = T.bind(blob, lambda b: F.coalesce(first_alias(b, codes, within=True)["name"], first_alias(b, list(G.CITY_ALIASES.items()))["name"], first_alias(b, names, within=True)["name"]))
    own = T.clean(city)
    return F.coalesce(found, F.when(own != "", own), F.lit(UNKNOWN_CITY))


def region_for(commune: Column) -> Column:
    table = {c: r for r, cs in G.REGIONS.items() for c in cs}
    return F.coalesce(lookup(commune, table), F.lit(UNKNOWN_REGION))


def detect_zones(blob: Column, commune: Column) -> Column:
    """(primary, zones): the priority zones a normalised text names, else the commune."""
    has = lambda *ws: T.contains_any(blob, list(ws))
    named = F.array_compact(
        F.array(
            F.when(has("moufia"), "Moufia"),
            F.when(has("la bretagne") | blob.rlike(r"\bbretagne\b"), "La Bretagne"),
            F.when(has("sainte marie", "saint marie"), "Sainte-Marie"),
            F.when(has("saint denis", "sainte clotilde", "montgaillard", "la montagne"), "Saint-Denis"),
        )
    )
    known = commune.isNotNull() & (commune != "") & (commune != UNKNOWN_CITY)
    zones = F.when(F.size(named) > 0, named).when(known, F.array(commune)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.coalesce(F.get(zones, F.lit(0)), F.lit(UNKNOWN_ZONE)).alias("primary"), zones.alias("zones"))


def property_label(kind: Column, title: Column) -> Column:
    t = T.norm_translate(F.concat_ws(" ", T.text(kind), T.text(title)))
    return (
        F.when(T.contains_any(t, ["maison", "villa", "house"]), "Maison")
        .when(T.contains_any(t, ["appartement", "studio", "flat", "apartment", "duplex", "t1", "t2", "t3", "t4", "t5"]), "Appartement")
        .otherwise("Appartement / maison")
    )


def out_of_scope(*fields: Column) -> Column:
    """A name outside the covered area occurs; no signal is not out of scope."""
    blob = T.norm_slug(F.concat_ws(" ", *[T.text(f) for f in fields]))
    return T.contains_any(blob, sorted({plain.slug(a) for a in G.OUT_OF_SCOPE}))


def scope_class(declared: Column, *fields: Column) -> Column:
    """IN if a covered commune is declared, OUT if an outside name occurs, else AMBIGUOUS."""
    covered = T.norm_slug(declared).isin([plain.slug(c) for c in G.COVERED])
    return F.when(covered, "IN").when(out_of_scope(declared, *fields), "OUT").otherwise("AMBIGUOUS")


def strict_commune(*fields: Column) -> Column:
    """A covered commune by its own names, longest first, then by postal code; never by a district."""
    blob = padded(F.replace(T.norm_slug(F.concat_ws(" ", *[T.text(f) for f in fields])), F.lit("-"), F.lit(" ")))
    names = G.longest_first([(plain.slug(a), c) for c, aliases in G.COVERED.items() for a in (c, *aliases)])
    codes = [(code, c) for code, c in G.POSTAL.items() if c in G.COVERED]
    return first_alias(blob, names + codes, within=True)["name"]


def district_in(commune: Column, *fields: Column) -> Column:
    """A district of the known commune that the texts name, longest alias first; null if it's unknown."""
    blob = padded(F.replace(T.norm_slug(F.concat_ws(" ", *[T.text(f) for f in fields])), F.lit("-"), F.lit(" ")))
    pairs = G.longest_first([(plain.slug(a), name) for name, (*_, aliases) in G.DISTRICTS.items() for a in (name, *aliases)])
    table = F.array(*[F.struct(F.lit(plain.fold(a)).alias("alias"), F.lit(n).alias("name"), F.lit(G.DISTRICTS[n][0]).alias("commune")) for a, n in pairs])
    return T.bind(F.struct(blob.alias("b"), commune.alias("c")), lambda x: F.get(F.filter(table, lambda p: (p["commune"] == x["c"]) & F.contains(x["b"], p["alias"])), F.lit(0))["name"])


def plausible(lat: Column, lon: Column, south: float = -21.45, north: float = -20.80, west: float = 55.15, east: float = 55.95) -> Column:
    """Strictly inside the box; false for missing coordinates."""
    return F.coalesce((lat > south) & (lat < north) & (lon > west) & (lon < east), F.lit(False))


def infer_location(df: DataFrame, title: str = "title", description: str = "description", url: str = "url", commune: str = "commune", region: str = "region", out: str = "location") -> DataFrame:
    """``df`` with a struct of where a listing is, from its own text, with confidence and method.

    A named district decides; else the commune named in title or address, else in the whole text,
    else the declared one.  A view of the mountain is not its district (but names its commune).  Each step is a column of its
    own, so no expression is written out twice."""
    c = lambda n: N.column(df, n).cast("string")
    low = lambda *ns: T.norm_nfd_space(F.concat_ws(" ", *[T.text(c(n)) for n in ns]))
    mountain = "la montagne"
    d = df.withColumns({"_blob": low(title, description, url, commune, region), "_strong": padded(low(title, url)), "_declared": T.norm_nfd_space(c(commune))})
    view = F.col("_blob").rlike(r"\b(vue|vues|mer|ocean|panorama|panoramique|route|routes|chemin|sur)\b(?:\s+\w+){0,4}\s+la montagne\b")
    allowed = ~view & (F.contains("_strong", F.lit(f" {mountain} ")) | F.col("_declared").isin("saint denis", "st denis"))
    # a text that may not name the mountain is read without it
    words = padded(F.col("_blob"))
    d = d.withColumn("_words", F.when(allowed, words).otherwise(F.replace(words, F.lit(f" {mountain} "), F.lit(" # "))))
    d = d.withColumns({"_district": first_alias(F.col("_words"), G.district_aliases())["name"], "_text": F.coalesce(first_alias(F.col("_strong"), G.commune_aliases()), first_alias(words, G.commune_aliases()))["name"]})
    by_name = lookup(F.col("_declared"), {a: n for a, n in reversed(G.commune_aliases())})
    d = d.withColumn("_hit", F.coalesce(lookup(F.col("_district"), {n: v[0] for n, v in G.DISTRICTS.items()}), "_text", by_name))
    given = F.when((c(commune) != "") & (c(commune) != UNKNOWN_CITY), c(commune))
    d = d.withColumn("_place", F.coalesce("_hit", given))
    d = d.withColumn("_same", F.coalesce((F.col("_declared") != "") & (T.norm_nfd_space(F.col("_place")) == F.col("_declared")), F.lit(False)))
    has, hit, same, region_known = F.col("_district").isNotNull(), F.col("_hit").isNotNull(), F.col("_same"), T.text(c(region)) != ""
    confidence = F.when(has & same, 0.90).when(has, 0.82).when(hit & same, 0.94).when(same, 0.82).when(hit, 0.72).when(region_known, 0.45).otherwise(0.35)
    method = (
        F.when(has, "district_alias_match").when(hit & same, "declared_commune_confirmed_by_text").when(same, "declared_commune")
        .when(hit, "text_alias_match").when(region_known, "region_only").otherwise("region_only_or_unknown")
    )
    d = d.withColumns({"_confidence": confidence, "_method": method})
    place, district = F.col("_place"), F.col("_district")
    shown = F.when(district == "Bois de Nèfles Sainte-Clotilde", "Bois de Nèfles").otherwise(district)
    made = F.struct(
        F.coalesce(place, F.lit(UNKNOWN_CITY)).alias("commune_inferred"),
        F.coalesce(lookup(place, {n: v[0] for n, v in G.COMMUNES.items()}), F.when(region_known, c(region)), F.lit(UNKNOWN_REGION)).alias("region_inferred"),
        F.coalesce(lookup(place, {n: v[1] for n, v in G.COMMUNES.items()}), F.lit("Non précisé")).alias("interco"),
        district.alias("district_best"),
        F.coalesce(F.concat_ws(" · ", F.when(place.isNotNull(), shown), place), F.lit(UNKNOWN_CITY)).alias("precise_location_label"),
        lookup(district, {n: str(v[1]) for n, v in G.DISTRICTS.items()}).try_cast("double").alias("lat"),
        lookup(district, {n: str(v[2]) for n, v in G.DISTRICTS.items()}).try_cast("double").alias("lon"),
        F.coalesce(place.isin(*G.FOCUS), F.lit(False)).alias("focus"),
        F.col("_confidence").alias("confidence"),
        F.when(F.col("_confidence") >= 0.85, "haute").when(F.col("_confidence") >= 0.65, "moyenne").otherwise("faible").alias("quality"),
        F.col("_method").alias("method"),
    )
    return d.withColumn(out, made).drop(*[x for x in d.columns if x.startswith("_") and x not in df.columns])

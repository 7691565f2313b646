"""Housing details of a description: counted noun phrases by storey, and what is hidden where they contradict.

Every figure comes with the words around it.  A bedroom split that does not fit the listing's number of bedrooms is not shown,
and neither is chosen: the text and the field disagree, and nobody here knows which is right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentgrid.functions import text as T
from rentgrid.functions.geo import lookup

# fixed values: French numerals, nouns of bathrooms and toilets, words of storeys
NUMERALS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9}
BATHROOMS = (r"salle\s+d[eu]\s+bain", r"salle\s+d[eu]\s+douche", r"salle\s+d['’]?eau", "sdb", "douche")
TOILETS = ("wc", "toilettes?", "sanitaires?")
STOREYS = (r"(?:situe\w*\s+)?(?:au|en)\s+\d+(?:er|e|eme|ème)?\s+etage", r"dernier\s+etage", r"rez[-\s]de[-\s]chaussee|rdc", "duplex", r"plain[-\s]pied")
GROUND = r"(?:rez[-\s]de[-\s]chaussée|rez[-\s]de[-\s]chaussee|rdc)[^.;:]{0,220}"
BEFORE_UPSTAIRS = r"comprend\s*:?(.{0,220}?)(?:a l[’']?etage|à l[’']?étage)"
UPSTAIRS = r"(?:a l[’']?etage|à l[’']?étage|etage|étage)\s*:?[^.;]{0,240}"
_COUNT = r"\b(?:(\d+|" + "|".join(NUMERALS) + r")\s+)?"
# fixed values: the largest count that is believed, evidence before and after a mention, and how many of each kind
MOST, BEFORE, AFTER, SHOWN, STOREYS_SHOWN = 9, 45, 55, 4, 5
_OPEN, _CLOSE = "\u0001", "\u0002"


def _number(c: Column) -> Column:
    """A count as written; no number is one, and so is a number of several digits."""
    digit = F.when(c.rlike("^[0-9]$"), c.cast("int"))
    return F.coalesce(lookup(F.lower(c), {k: str(v) for k, v in NUMERALS.items()}).cast("int"), digit, F.lit(1))


def _sum(found: Column) -> Column:
    return F.aggregate(F.transform(found, _number), F.lit(0), lambda a, x: a + x)


def _spans(text: Column, pattern: str) -> Column:
    """(start, end) of every match, in code points."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    laid = F.aggregate(pieces, start, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end")))).alias("out")), lambda acc: acc["out"])
    return F.filter(laid, lambda x, i: i % 2 == 1)


def _around(text: Column, span: Column) -> Column:
    low = F.greatest(span["start"] - BEFORE, F.lit(0))
    return T.clean(F.substring(text, low + 1, span["end"] + AFTER - low))


def counted(text: Column, nouns: tuple[str, ...]) -> Column:
    """(count, confidence, evidence) of what the nouns name; null and ``absent`` without a mention."""
    patterns = [rf"(?iU){_COUNT}({n})s?\b" for n in nouns]

    def made(t: Column) -> Column:
        numbers = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns])
        shown = F.slice(F.concat(*[F.transform(_spans(t, p), lambda s: _around(t, s)) for p in patterns]), 1, SHOWN)
        some = F.size(numbers) > 0
        return F.struct(F.when(some, F.least(_sum(numbers), F.lit(MOST))).alias("count"), F.when(some, "source_text").otherwise("absent").alias("confidence"), shown.alias("evidence"))

    return T.bind(F.translate(text, _OPEN + _CLOSE, "  "), made)


def bedrooms_in(segment: Column) -> Column:
    """The bedrooms a part of a text counts; null if it names none."""
    found = F.regexp_extract_all(F.lower(segment), F.lit(r"(?U)" + _COUNT + r"chambres?\b"), F.lit(1))
    return F.when(F.size(found) > 0, _sum(found))


def _part(text: Column, pattern: str, i: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, "(?isU)" + pattern, i), F.lit(""))


def details(title: Column, description: Column, bedrooms: Column) -> Column:
    """Bathrooms, toilets, layout and the bedrooms by storey.

    ``bedroom_distribution.status``: ``ok``, ``unknown``, or ``conflict`` where the storeys name more bedrooms than the listing
    has (if that is known and not 0); then neither count is given."""
    text = F.concat_ws(" ", T.text(title), T.text(description))

    def made(t: Column) -> Column:
        plain = T.norm_alnum(t)
        duplex, ground, single = plain.rlike(r"\bduplex\b"), plain.rlike(r"\b(rdc|rez de chaussee|plain pied|plein pied)\b"), plain.rlike(r"\b(plain pied|plein pied|tout (?:en )?rdc|de plain pied)\b")
        up = t.rlike(r"(?iU)\b(a l etage|à l étage|etage|étage|niveau superieur|duplex)\b") | duplex
        label = F.when(single, "Tout RDC / plain-pied").when(duplex | (ground & up), "Duplex / étage(s)").when(ground, "RDC mentionné").when(up, "Étage mentionné").otherwise("Non précisé")
        mentions = F.slice(F.concat(*[F.transform(F.regexp_extract_all(t, F.lit("(?iU)" + p), F.lit(0)), T.clean) for p in STOREYS]), 1, STOREYS_SHOWN)
        below, before, above = _part(t, GROUND), _part(t, BEFORE_UPSTAIRS, 1), _part(t, UPSTAIRS)
        low = F.coalesce(bedrooms_in(below), bedrooms_in(before))
        high = bedrooms_in(above)
        used = F.array(T.clean(below), F.when(before.isNotNull() & bedrooms_in(below).isNull(), T.clean(_part(t, BEFORE_UPSTAIRS))), T.clean(above))
        evidence = F.filter(used, lambda x: x != "")
        said = F.coalesce(low, F.lit(0)) + F.coalesce(high, F.lit(0))
        apart = F.coalesce(said > F.nullif(bedrooms, F.lit(0)), F.lit(False))
        status = F.when(low.isNull() & high.isNull(), "unknown").when(apart, "conflict").otherwise("ok")
        return F.struct(
            F.lit("housing_details_v1").alias("version"), counted(t, BATHROOMS).alias("bathrooms"), counted(t, TOILETS).alias("wc"),
            F.struct(label.alias("label"), duplex.alias("duplex"), ground.alias("rdc_mentioned"), up.alias("upstairs_mentioned"), single.alias("single_storey"), mentions.alias("evidence")).alias("layout"),
            F.struct(F.when(~apart, low).alias("ground_floor_count"), F.when(~apart, high).alias("upstairs_count"), status.alias("status"), evidence.alias("evidence")).alias("bedroom_distribution"),
        )

    return T.bind(text, made)


def visible(c: Column) -> Column:
    """A description without the fragments crawlers leave in it."""
    out = T.clean(c)
    for pattern in (r"(?iU)Annonce\s+\w+\s+collectée\s+par\s+CDP\.?", r"(?iU)\b(commune|quartier|source)?\s*serp_view=[^\s]+", r"(?iU)\bsearch=[^\s]+"):
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return out

"""Descriptions recovered from what is stored of a listing's source: its page, its interface's answer, its card's text.

Each source has a rule of its own, composed of a few steps: prose after a pattern, a block of the page, what stands around a
label, a path of a document, structured data, or the page's own description.  Rules are column expressions: one
projection reads all sources, and a row costs its own source's rule only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import extract as X
from rentgrid.functions import numbers as N
from rentgrid.functions import text as T
from rentgrid.functions import variant
from rentgrid.operators.entity import title_ratio


@dataclass(frozen=True)
class Stored:
    """What is stored of a row: the page, the interface's answer (JSON), the card's plain text."""

    html: Column
    payload: Column
    text: Column


def _clean(c: Column) -> Column:
    return F.nullif(T.clean(X.visible_text(c)), F.lit(""))


# ---- steps: null where they find nothing


def after(c: Column, pattern: str) -> Column:
    """The prose in a pattern's group."""
    return _clean(X.group(c, "(?s)" + pattern))


def onwards(c: Column, marker: str, beyond: int) -> Column:
    """The text from a marker on, if that stands beyond a position."""
    at = F.instr(c, marker)
    return F.when(at - 1 > beyond, _clean(F.substring(c, at, F.length(c))))


def around(c: Column, label: str, before: int, behind: int) -> Column:
    """What stands around the first mention of a label, whatever its case."""
    at = F.instr(F.lower(c), label.lower())
    low = F.greatest(at - 1 - before, F.lit(0))
    return F.when(at > 0, _clean(F.substring(c, low + 1, at - 1 + behind - low)))


def at_path(document: Column, *paths: str) -> Column:
    return _clean(variant.text_at(variant.parsed(document), *paths))


def described(html: Column) -> Column:
    """The page's own description."""
    return F.coalesce(X.meta(html, "description"), X.meta(html, "og:description"))


def structured(html: Column, kind: str) -> Column:
    """The description of the last item of a kind in the page's structured data, whose blocks hold one item or a list."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(F.trim(b)))
    one = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    items = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), one))
    told = F.transform(F.filter(items, lambda v: F.contains(F.coalesce(F.try_variant_get(v, "$['@type']", "string"), F.lit("")), F.lit(kind))), lambda v: F.try_variant_get(v, "$.description", "string"))
    return _clean(F.try_element_at(F.filter(told, lambda d: d != ""), F.lit(-1)))


# ---- choices


def longest(*found: Column, least: int = 0) -> Column:
    """The longest, of equals the first; none shorter than ``least``, and no crawler's card if that is asked."""
    given = F.filter(F.array(*found), lambda x: F.length(x) >= least)
    sized = F.transform(given, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(sized)["x"]


def prose(c: Column) -> Column:
    """Null for a crawler's card."""
    return T.bind(c, lambda x: F.when(~X.is_boilerplate(x), x))


def enough(c: Column, least: int) -> Column:
    return T.bind(c, lambda x: F.when(F.length(x) >= least, x))


# fixed values: how the sources' texts begin, and where their footers do
BEGINNINGS = ("Beau ", "A louer ", "À louer ", "Dans ", "Situé ", "Studio ", "Appartement ")
CARD = (
    r"\([0-9]{5}\)\s+(.+)$", r"(?:Appartement|Maison|Villa|Studio)\s*[•-][^\n]{0,120}\)\s+(.+)$",
    r"\b[0-9 ]+\s*€\s*(?:CC|HC)?\s+(?:Appartement|Maison|Villa|Studio)[^A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ]{0,10}(.+)$",
)
OFFER_FOOTERS = ("Cette offre de location est proposée", "Cette annonce vous est proposée par", "Extrait de notre barème", "Les informations sur les risques auxquels ce bien est exposé", "Géorisques")
CONTENT_FOOTERS = ("Cette annonce vous est proposée par", "Nos tarifs")
PRICE_LABELS = ("détails du prix", "Dépôt de garantie", "Honoraires charge locataire", "Libre le")
BLOCK = r"<div[^>]+class=[\"'][^\"']*descriptif[^\"']*[\"'][^>]*>(.*?)</div>\s*</div>"
CONTENT_BLOCK = r"<div[^>]+class=[\"'][^\"']*property__description-content[^\"']*[\"'][^>]*>(.*?)</div>"


def _card(s: Stored) -> Column:
    found = lambda t: [after(t, p) for p in CARD] + [onwards(t, m, 80) for m in BEGINNINGS]
    return T.bind(T.clean(s.text), lambda t: longest(*[prose(c) for c in found(t)], least=80))


def _price_details(s: Stored) -> Column:
    return F.nullif(T.clean(F.concat_ws(" ", described(s.html), *[around(s.html, label, 200, 1200) for label in PRICE_LABELS])), F.lit(""))


#: The rule of each kind of source, by name.
RULES: dict[str, Callable[[Stored], Column]] = {
    "card": _card,
    "structured": lambda s: F.trim(F.regexp_replace(F.coalesce(structured(s.html, "RealEstate"), described(s.html)), r"\s*Voir moins\s*$", "")),
    "offer": lambda s: X.cut_footer(at_path(s.payload, "$.description"), list(OFFER_FOOTERS)),
    "block": lambda s: longest(F.coalesce(enough(after(s.html, BLOCK), 80), around(s.html, "descriptif", 0, 5000), after(s.html, BLOCK)), described(s.html)),
    "price_details": _price_details,
    "content": lambda s: F.coalesce(enough(X.cut_footer(at_path(s.payload, "$.content"), list(CONTENT_FOOTERS)), 80), enough(described(s.html), 81)),
    "content_block": lambda s: longest(after(s.html, CONTENT_BLOCK), described(s.html)),
}


def recovered(rows: DataFrame, rules: dict[str, str], source: str = "source") -> DataFrame:
    """``rows`` (with html, payload or text, whichever there are) with ``recovered`` and the ``method`` that was tried.

    rules: the rule of each source.  A structured text that says the same twice is given once."""
    s = Stored(*[T.text(N.column(rows, c)) for c in ("html", "payload", "text")])
    found, method = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, rule in rules.items():
        found = F.when(F.col(source) == name, RULES[rule](s)).otherwise(found)
        method = F.when(F.col(source) == name, F.lit(rule)).otherwise(method)
    out = rows.withColumns({"_found": found, "method": method})
    long = (F.col("method") == "structured") & (F.length("_found") > 200)
    half = F.floor(F.length("_found") / 2).cast("int")
    out = out.withColumns({"_a": F.when(long, F.left("_found", half)), "_b": F.when(long, F.substring("_found", half + 1, F.length("_found")))})
    twice = F.coalesce((title_ratio("_a", "_b") > 0.88) & F.col("_a").isNotNull(), F.lit(False))
    return out.withColumn("recovered", F.coalesce(F.when(twice, F.trim("_a")).otherwise(F.col("_found")), F.lit(""))).drop("_found", "_a", "_b")

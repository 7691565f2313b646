"""Stored pages to listings.  Fetching is not part of the engine: a page is a row (url, html).

A portal is a set of patterns: where its cards are and how each field is found in one.  Cards are cut
out with one expression and exploded, so a page of any number of listings needs no Python."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import extract as X
from rentgrid.functions import text as T
from rentgrid.functions.geo import first_alias, padded


@dataclass
class Portal:
    """Patterns of one portal: group 1 of ``card`` is a listing, group 1 of each field its value."""

    name: str
    card: str
    fields: dict[str, str] = field(default_factory=dict)
    must: str = ""
    kind: str | None = None


# fixed values: where portals of the default market keep their cards and fields
PORTALS = {
    "articles": Portal(
        "articles", r"(?s)<article>(.*?)</article>",
        {
            "url": r"href=[\"']([^\"']*/annonce/locations/[^\"']+)[\"']", "title": r"(?s)<h2 class=[\"']ville-type[\"']>\s*<a[^>]*title=[\"']([^\"']+)[\"']",
            "city": r"(?s)<h2 class=[\"']localisation[\"'][^>]*>.*?</i>\s*(.*?)\s*</h2>", "price": r"(?s)<div class=[\"']price-result[\"'][^>]*>\s*<b>\s*([^<]+)",
            "published": r"(?s)<div class=[\"']date_publication[\"'][^>]*>\s*([^<]+)", "description": r"(?s)<p class=[\"']description[\"'][^>]*>(.*?)</p>",
            "image": r"(?s)<img[^>]+src=[\"']([^\"']+)",
        }, must="/annonce/locations/",
    ),
    "items": Portal("items", r"(?s)<li[^>]+data-id=[\"'][^\"']+[\"'][^>]*>(.*?)</li>", {"url": r"href=[\"']([^\"']+)[\"']", "title": r"title=[\"']([^\"']+)[\"']", "price": r"([0-9][0-9\s]{1,6})\s*€", "image": r"src=[\"']([^\"']+)"}),
}


def cards(pages: DataFrame, portal: Portal, html: str = "html") -> DataFrame:
    """(url, source, source_id, title, city, price, surface, rooms, published, image, description) of each
    card, an address once."""
    cut = F.explode(F.regexp_extract_all(html, F.lit("(?i)" + portal.card), F.lit(1)))
    rows = pages.select(cut.alias("card"))
    rows = rows.where(F.contains("card", F.lit(portal.must))) if portal.must else rows
    get = lambda n: X.group(F.col("card"), portal.fields[n]) if n in portal.fields else F.lit(None).cast("string")
    text = lambda c: F.nullif(T.clean(X.visible_text(c)), F.lit(""))
    out = rows.select(*[get(n).alias(n) for n in ("url", "title", "city", "price", "published", "image", "description")])
    out = out.withColumns({n: text(F.col(n)) for n in ("title", "city", "published", "description")})
    both = F.concat_ws(" ", "title", "description")
    sid = F.coalesce(X.group(F.col("url"), r"-(\d+)\.html"), F.md5("url"))
    out = out.where("url is not null").select(
        "url", F.lit(portal.name).alias("source"), sid.alias("source_id"), "title", "city", X.amount(F.col("price")).alias("price"), X.surface(both).alias("surface"),
        X.rooms(both).alias("rooms"), "published", X.photo_url(F.col("image")).alias("image"), "description",
    )
    return out.dropDuplicates(["url"])


ITEM_LIST = "struct<mainEntity:struct<itemListElement:array<struct<position:int,item:struct<name:string,url:string,image:string,offers:struct<price:string,url:string,validFrom:string,itemOffered:struct<address:struct<addressLocality:string>,floorSize:struct<value:double>,numberOfBedrooms:struct<value:double>>>>>>>>"


def item_list(pages: DataFrame, source: str, html: str = "html") -> DataFrame:
    """Listings of a page's JSON-LD item list, an address once over all pages."""
    block = X.group(F.col(html), r"(?s)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>")
    items = pages.select(F.explode(F.from_json(block, ITEM_LIST)["mainEntity"]["itemListElement"]).alias("e")).select("e.position", "e.item.*")
    url = F.coalesce("url", "offers.url")
    out = items.select(
        url.alias("url"), F.lit(source).alias("source"), F.coalesce(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "-"), -1), F.col("position").cast("string")).alias("source_id"),
        T.clean(F.col("name")).alias("title"), F.col("offers.itemOffered.address.addressLocality").alias("city"), X.amount(F.col("offers.price")).alias("price"),
        F.col("offers.itemOffered.floorSize.value").alias("surface"), F.col("offers.itemOffered.numberOfBedrooms.value").cast("int").alias("rooms"), F.col("offers.validFrom").alias("published"), "image",
    )
    known = out.where("url is not null").dropDuplicates(["url"])
    return known.unionByName(out.where("url is null"))


def linked_details(lists: DataFrame, details: DataFrame, containing: str, source: str, commune: Column | None = None) -> DataFrame:
    """Detail pages that list pages link to, each once; ``commune`` is what the list was asked for and wins
    over what the page says.  lists: (url, html); details: (url, html)."""
    asked = commune if commune is not None else F.lit(None).cast("string")
    found = lists.select(F.explode(X.links(F.col("html"), containing)).alias("url"), asked.alias("asked")).groupBy("url").agg(F.min("asked").alias("asked"))
    return detail_pages(details.join(found, "url"), source, F.col("asked"))


def detail_pages(pages: DataFrame, source: str, commune: Column | None = None) -> DataFrame:
    """One listing a page: title and description from its tags, numbers from them before the whole text, so
    that other listings shown on the page don't count."""
    text = X.visible_text(F.col("html"))
    p = pages.withColumns({"_text": text, "_title": F.coalesce(X.meta(F.col("html"), "og:title"), X.title_tag(F.col("html")))})
    p = p.withColumn("_desc", F.coalesce(X.meta(F.col("html"), "description"), X.meta(F.col("html"), "og:description"), F.left("_text", F.lit(900))))
    head = F.concat_ws(" ", "_title", "_desc")
    whole = F.concat_ws(" ", "_title", "_desc", "_text")
    city = F.coalesce(*[c for c in (commune, guess_city(X.url_part(F.col("url"), "PATH")), guess_city(head), guess_city(F.col("_text"))) if c is not None])
    return p.select(
        "url", F.lit(source).alias("source"), F.left(F.md5("url"), F.lit(16)).alias("source_id"), F.col("_title").alias("title"), city.alias("city"),
        F.coalesce(X.rent(F.col("_title")), X.rent(F.col("_desc")), X.rent(whole)).alias("price"), F.coalesce(X.surface(head), X.surface(whole)).alias("surface"),
        F.coalesce(X.rooms(head), X.rooms(whole)).alias("rooms"), X.photo_url(X.meta(F.col("html"), "og:image")).alias("image"), F.col("_desc").alias("description"),
    )


# fixed values: names by which a city is guessed from text, in the order in which they are tried
CITY_GUESS = {
    "Saint-Denis": ("saint denis", "st denis"),
    "Sainte-Clotilde": ("sainte clotilde", "ste clotilde", "st clotilde"),
    "Sainte-Marie": ("sainte marie", "ste marie"),
    "Saint-Pierre": ("saint pierre", "st pierre"),
    "Saint-Paul": ("saint paul", "st paul"),
    "Saint-Louis": ("saint louis", "st louis"),
    "Le Tampon": ("le tampon", "tampon"),
    "Le Port": ("le port",),
    "La Possession": ("la possession",),
    "Saint-Leu": ("saint leu", "st leu"),
    "Saint-André": ("saint andre", "saint andré", "st andre", "st andré"),
    "Bras-Panon": ("bras panon",),
    "Etang-Salé": ("etang sale", "étang salé", "letang sale", "l etang sale"),
    "La Saline": ("la saline", "saline les bains"),
    "Moufia": ("moufia",),
    "Bellepierre": ("bellepierre",),
}


def guess_city(c: Column) -> Column:
    """A city named in a text, else a postal code of the market, else null."""
    low = F.translate(F.lower(T.text(c)), "-'", "  ")
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(city).alias("city")) for city, words in CITY_GUESS.items() for w in words])
    named = T.bind(low, lambda t: F.get(F.filter(table, lambda p: F.contains(t, p["w"])), F.lit(0))["city"])
    return F.coalesce(named, X.group(T.text(c), r"\b(974\d{2})\b"))


#: What is read of a feed; a broken one has its text in ``_corrupt_record``.
_ITEMS = "array<struct<link string, title string, description string>>"
FEED = f"channel struct<item {_ITEMS}>, item {_ITEMS}, _corrupt_record string"


def rss_items(feeds: DataFrame, source: str, xml: str = "html", must: str = "location") -> DataFrame:
    """Items of RSS feeds whose title holds ``must``: url, source_id, title, city, price, surface, rooms, description.

    Feeds are parsed as XML, so CDATA and entities are what they mean, and an element of another namespace is another element; a broken feed gives no items
    (``broken_feeds`` lists them), nor does one without a link."""
    parsed = F.from_xml(F.col(xml), FEED, {"mode": "PERMISSIVE"})
    nothing = F.array().cast(_ITEMS.replace(" string", ":string"))
    read = feeds.select(parsed.alias("f")).select(F.concat(F.coalesce("f.channel.item", nothing), F.coalesce("f.item", nothing)).alias("items"))  # in the channel, or beside it
    raw = read.select(F.explode("items").alias("i")).select("i.*")
    text = lambda n: F.nullif(T.clean(X.visible_text(F.col(n))), F.lit(""))
    r = raw.select(text("link").alias("url"), text("title").alias("title"), text("description").alias("description")).where(F.contains(F.lower("title"), F.lit(must)) & F.col("url").isNotNull())
    both = F.concat_ws(" ", "title", "description")
    sid = F.coalesce(X.group(F.col("url"), "/([0-9]+)/"), F.left(F.md5("url"), F.lit(16)))
    return r.select("url", F.lit(source).alias("source"), sid.alias("source_id"), "title", guess_city(both).alias("city"), X.rent(both).alias("price"), X.surface(both).alias("surface"), X.rooms(both).alias("rooms"), "description")


def broken_feeds(feeds: DataFrame, xml: str = "html") -> DataFrame:
    """The feeds that are no XML."""
    parsed = F.from_xml(F.col(xml), FEED, {"mode": "PERMISSIVE"})
    return feeds.withColumn("_feed", parsed).where("_feed._corrupt_record is not null").drop("_feed")


def escaped_links(pages: DataFrame, prefix: str, containing: str, html: str = "html") -> DataFrame:
    """(url): addresses that a page holds as escaped JSON, each once."""
    plain = F.replace(F.col(html), F.lit("\\/"), F.lit("/"))
    found = F.regexp_extract_all(plain, F.lit(rf"({T.quoted(prefix)}[^\"'\\\s]+)"), F.lit(1))
    return pages.select(F.explode(F.array_distinct(found)).alias("url")).where(F.contains(F.lower("url"), F.lit(containing))).distinct()


OFFER = "id string, reference string, title string, description string, price string, location string, city string, pieces double, chambres double, surface_habitable double, publicationDate string, imageSrc string"


def api_offers(payloads: DataFrame, source: str, region: str, low: int = 250, high: int = 6000, column: str = "value") -> DataFrame:
    """Offers of a JSON interface (a list, or an object with items or data): of one region, with a plausible
    rent and a word that says they are to let."""
    row = f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in OFFER.split(', '))}>>"
    both = F.from_json(F.col(column), f"struct<items:{row},data:{row}>")
    items = F.coalesce(F.from_json(F.when(F.ltrim(column).startswith("["), F.col(column)), row), both["items"], both["data"])
    r = payloads.select(F.inline(items))
    hay = F.lower(F.concat_ws(" ", "title", "description"))
    price = X.amount(F.col("price"))
    r = r.where((F.col("location") == region) & price.between(low, high) & T.contains_any(hay, ["location", "louer", "loyer"]))
    return r.select(
        F.coalesce("id", "reference").alias("source_id"), F.lit(source).alias("source"), T.clean(F.col("title")).alias("title"), T.clean(F.col("city")).alias("city"), price.alias("price"),
        F.coalesce("surface_habitable", X.surface(hay)).alias("surface"), F.coalesce(F.col("pieces").cast("int"), X.rooms(hay)).alias("rooms"), F.col("chambres").cast("int").alias("bedrooms"),
        F.col("publicationDate").alias("published"), F.col("imageSrc").alias("image"), "description",
    )


def page_details(pages: DataFrame, fallback: Column | None = None) -> DataFrame:
    """(url, ...) of a listing's own page: place from JSON-LD, then meta tags, then maps, then its
    description; equipment from the whole text; and where each came from.

    Addresses are only looked for in the description: the rest of a page names its agency's."""
    given = fallback if fallback is not None else F.lit("")
    p = pages.select("url", "html", given.alias("_fallback")).withColumn("ld", X.json_ld(F.col("html")))
    p = p.withColumns({"m": X.meta_coordinates(F.col("html")), "c": X.coordinates(F.col("html")), "desc": X.best_description(F.col("html"), F.col("_fallback"))})
    p = p.withColumns({"t": X.details(F.col("desc")), "all": F.concat_ws("\n", "desc", F.left(X.visible_text(F.col("html")), F.lit(20_000)))})
    p = p.withColumns({"f": X.details(F.col("all")), "k": X.comfort(F.col("all"))})
    ok = lambda s: X.plausible(F.col(f"{s}.lat"), F.col(f"{s}.lon"))
    pick = lambda f: F.when(ok("ld"), F.col(f"ld.{f}")).when(ok("m"), F.col(f"m.{f}")).otherwise(F.col(f"c.{f}"))
    text = lambda *cs: F.coalesce(*[F.nullif(T.clean(c), F.lit("")) for c in cs])
    address, street, home = text(F.col("ld.address_raw"), F.col("t.address")), text(F.col("ld.street"), X.meta(F.col("html"), "og:street-address"), F.col("t.street")), F.col("t.residence")
    origin = F.array_compact(F.array(F.when(ok("ld") | F.col("ld.street").isNotNull() | F.col("ld.address_raw").isNotNull(), "jsonld"), F.when(~ok("ld") & ok("m"), "meta"), F.when(~ok("ld") & ~ok("m") & F.col("c").isNotNull(), "carte"), F.when(F.coalesce("t.address", "t.street", "t.residence").isNotNull(), "texte")))
    return p.select(
        "url", address.alias("address"), street.alias("street"), home.alias("residence"), pick("lat").alias("lat"), pick("lon").alias("lon"), text(F.col("ld.postal_code"), X.meta(F.col("html"), "og:postal-code")).alias("postal_code"),
        text(F.col("ld.locality"), X.meta(F.col("html"), "og:locality")).alias("locality"), F.col("desc").alias("description_full"), F.coalesce("ld.bedrooms", "f.bedrooms").alias("bedrooms"), F.col("ld.images").alias("images"),
        *[F.col(f"f.{n}").alias(n) for n in ("floor", "has_elevator", "bathtub", "furnished", "charges_eur")], F.col("k.*"),
        X.precision(address, street, home, pick("lat"), pick("lon")).alias("precision"), F.coalesce(F.nullif(F.array_join(origin, "+"), F.lit("")), F.lit("aucun")).alias("geo_source"),
    )


def galleries(pages: DataFrame, limit: int = 24) -> DataFrame:
    """(url, images): photographs in a page's JSON-LD and image tags, each once, ``limit`` at most."""
    tags = X.groups(F.col("html"), r"<img[^>]+(?:data-src|src)=[\"']([^\"']+)")
    both = F.array_compact(F.transform(F.concat(X.json_ld(F.col("html"))["images"], tags), X.photo_url))
    return pages.select("url", F.slice(F.array_distinct(both), 1, limit).alias("images"))


def communes_named(pages: DataFrame, column: Column) -> DataFrame:
    from rentgrid.functions import gazetteer as G

    return pages.withColumn("commune_named", first_alias(padded(T.norm_nfd_space(column)), G.commune_aliases())["name"])

"""JSON documents of unknown shape: fields by several paths as VARIANT, and redaction at any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from rentgrid.functions import extract as X
from rentgrid.functions import numbers as N


def parsed(c: Column) -> Column:
    """The document as VARIANT; null for bad JSON and for what is no object."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def text_at(v: Column, *paths: str) -> Column:
    """The first of several paths that holds a non-empty text, number or flag, as text; neither a list nor an object."""

    def plain(p: str) -> Column:
        part = F.try_variant_get(v, p, "variant")
        found = F.when(~F.schema_of_variant(part).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, p, "string"))
        return F.when(~found.isin("", "0", "false"), found)

    return F.coalesce(*[plain(p) for p in paths])


def journal_item(raw: Column, listing_id: Column, title: Column, url: Column, thumbnail: Column | None = None) -> Column:
    """What a change journal shows of a listing: from its stored document, else from the listing's own row.

    ``raw`` is the document's text; bad JSON and what is no object count as an empty document.  ``thumbnail`` says
    whether a local thumbnail is there to be shown (a predicate on the struct field's path, given as a column of
    known paths); without it all are."""
    v = parsed(raw)
    get = lambda *p: text_at(v, *[f"$.{x}" for x in p])
    own = F.coalesce(get("id"), listing_id)
    given = F.coalesce(get("source_site"), get("source"))
    source = F.coalesce(given, F.when(F.contains(own, F.lit(":")), F.substring_index(own, ":", 1)))
    zones = F.try_variant_get(v, "$.zones", "array<string>")
    image = F.trim(get("local_image_url", "image_url"))
    local = image.rlike("^/?thumbs/")
    relative = F.regexp_replace(image, "^/+", "")
    shown = F.when(local, F.when(F.array_contains(thumbnail, relative), relative) if thumbnail is not None else relative).otherwise(image)
    zone = get("primary_zone")
    number = lambda p: F.try_variant_get(v, f"$.{p}", "double")
    return F.struct(
        own.alias("id"), F.coalesce(get("title"), F.nullif(title, F.lit("")), F.lit("Annonce")).alias("title"), F.coalesce(get("url"), F.nullif(url, F.lit(""))).alias("url"), source.alias("source_site"),
        get("region").alias("region"), get("commune").alias("commune"), zone.alias("primary_zone"),
        F.when(F.size(zones) > 0, zones).when(zone.isNotNull(), F.array(zone)).otherwise(F.array().cast("array<string>")).alias("zones"),
        get("property_type").alias("property_type"), get("furnished").alias("furnished"), get("location_label", "commune", "region").alias("location_label"),
        N.as_int(F.try_variant_get(v, "$.rent_eur", "string")).alias("rent_eur"), number("surface_m2").alias("surface_m2"), number("rooms").alias("rooms"), number("bedrooms").alias("bedrooms"),
        shown.alias("image_url"), X.public_text(get("description")).alias("description"), X.public_text(get("decision_summary")).alias("decision_summary"),
        get("seen_last_at", "last_seen_at").alias("seen_last_at"),
    )


# fixed values: keys that name places of the installation, what must not be shown, and the longest lists and texts
PRIVATE_KEYS = ("app", "db", "db_path", "path", "backup", "backup_path", "candidate", "target")
SECRETS = re.compile(r"(/opt/data|Traceback|sqlite3\.OperationalError|SECRET_KEY|api_key=|password=|token=|Authorization:|Bearer\s+)", re.I)
PATHS = re.compile(r"/[^\s'\"]+/(?:projects|artifacts|data|scripts)/[^\s'\"]+")
LONGEST_LIST, LONGEST_TEXT = 200, 500


def scrub(value):
    """A parsed document without private keys, and with secrets and paths replaced in its texts."""
    if isinstance(value, dict):
        return {k: scrub(v) for k, v in value.items() if k not in PRIVATE_KEYS}
    if isinstance(value, list):
        return [scrub(v) for v in value[:LONGEST_LIST]]
    if isinstance(value, str):
        return PATHS.sub("[path-redacted]", SECRETS.sub("[REDACTED]", value))[:LONGEST_TEXT]
    return value


@F.pandas_udf(S.StringType())  # type: ignore[call-overload]
def redacted(documents: pd.Series) -> pd.Series:
    """Each JSON document redacted, keys in their order; null for null, bad JSON and nesting beyond what can be parsed."""

    def one(raw: str | None) -> str | None:
        try:
            return None if raw is None else json.dumps(scrub(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return documents.map(one)


# fixed value: what looks like a secret in a text that is about to be published
SECRET_HINT = r"(?i)(api[_-]?key|secret[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|password)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=:-]{16,}"


def secret_hints(c: Column) -> Column:
    """How many secrets a text seems to hold."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(SECRET_HINT), F.lit(0))), F.lit(0))

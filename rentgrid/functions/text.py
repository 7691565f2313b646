"""Text normalisation.  The dialects differ on hyphens, apostrophes and punctuation; each consumer
names the one it needs, and they are never mixed."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's canonical decomposition."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((chr(c), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _folding()
# fixed values: the accents that norm_translate knows
TRANSLATE_FROM, TRANSLATE_TO = "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"
# fixed value: the letters norm_keep_accents keeps
KEPT_ACCENTS = "àâäéèêëîïôöùûüç"


def text(c: Column) -> Column:
    """The value as text; null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """White space folded and trimmed."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def fold_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")


def norm_translate(c: Column) -> Column:
    return F.translate(F.replace(F.lower(clean(c)), F.lit("-"), F.lit(" ")), TRANSLATE_FROM, TRANSLATE_TO)


def norm_nfd(c: Column) -> Column:
    return fold_accents(F.lower(text(c)))


def norm_nfd_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold_accents(F.translate(F.lower(text(c)), "-_'", "   ")), r"\s+", " "))


def norm_alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(norm_nfd(c), "[^a-z0-9]+", " "))


def _saints(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\bst\b", "saint"), r"\bste\b", "sainte")


def _ascii(c: Column) -> Column:
    return F.regexp_replace(fold_accents(text(c)), r"[^\x00-\x7F]", "")


def norm_slug(c: Column) -> Column:
    out = F.regexp_replace(_saints(F.translate(F.lower(_ascii(c)), "'", " ")), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def norm_keep_accents(c: Column) -> Column:
    out = F.regexp_replace(F.lower(text(c)), "https?://", "")
    return F.trim(F.regexp_replace(out, f"[^a-z0-9{KEPT_ACCENTS}]+", " "))


def norm_lower(c: Column) -> Column:
    """Lower case and hyphens to spaces only; accents stay."""
    return F.replace(F.lower(clean(c)), F.lit("-"), F.lit(" "))


def norm_search(c: Column) -> Column:
    """The free-text search's form: saint spelled out, everything else one space."""
    return F.trim(F.regexp_replace(_saints(F.lower(fold_accents(text(c)))), "[^a-z0-9]+", " "))


def contains_all(blob: Column, query: Column) -> Column:
    """Every word of the query occurs somewhere in the text; an empty query matches."""
    return F.forall(F.split(query, " "), lambda t: F.contains(blob, t))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(blob: Column, words: list[str]) -> Column:
    """Any of the words occurs somewhere; the text is computed once and the words are one constant."""
    if not words:
        return F.lit(False)
    return F.coalesce(bind(blob, lambda b: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(b, w))), F.lit(False))


def quoted(literal: str) -> str:
    """A literal for Java's regular expressions."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~" else c for c in literal)


def has_alias(blob: Column, alias: str) -> Column:
    """The alias occurs between word boundaries; both sides are normalised by the caller."""
    return blob.rlike(rf"(^|\b){quoted(alias)}(\b|$)")


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last replaced by an ellipsis when cut (3 are given up)."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("…"))).otherwise(c)


def variants(label: str) -> list[str]:
    """The spellings under which users type a place name."""
    from rentgrid.functions.plain import fold

    raw = (label or "").strip()
    if not raw:
        return []
    plain = fold(raw)
    out: list[str] = []
    for v in (raw.lower(), plain, plain.replace(" saint ", " st "), plain.replace(" sainte ", " ste ")):
        forms = [v, v.replace("-", " "), v.replace(" ", "-")]
        for word, short in (("saint ", "st"), ("sainte ", "ste")):
            if v.startswith(word):
                rest = v[len(word) :]
                forms += [f"{short} {rest}", f"{short}-{rest.replace(' ', '-')}"]
        forms += [v.replace("riviere des pluies", "rivieres des pluies")] if "riviere des pluies" in v else []
        forms += [v.replace("rivières des pluies", "rivière des pluies")] if "rivières des pluies" in v else []
        out += [f for f in (" ".join(x.split()).strip(" -") for x in forms) if f]
    return list(dict.fromkeys(out))


def money(c: Column) -> Column:
    """1 234 €, or null."""
    return F.concat(F.regexp_replace(F.format_number(c, 0), ",", " "), F.lit(" €"))


def surface_label(c: Column) -> Column:
    return F.concat(F.bround(c, 0).cast("long").cast("string"), F.lit(" m²"))

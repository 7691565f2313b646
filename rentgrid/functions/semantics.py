"""What a listing's text says, with the words that say it.

One table of rules (field, value, rule, priority, pattern) is compiled into a few passes over the text.  The rules
of a pass can't overlap, so they are one alternation: the text is marked once, and the marks' pieces
give every match with its span.  Then everything is array expressions: each match gets its rule, whether it stands
under a negation of the same clause, and each field its value by priority and place.  Nothing is claimed
without evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentgrid.functions import text as T

# Unicode classes and case, as in the texts
_FLAGS = "(?iU)"
_OPEN, _CLOSE = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    """A pattern that shows that ``field`` has ``value``; of a field's rules the lowest priority number decides."""

    field: str
    value: str
    name: str
    priority: int
    pattern: str


# fixed values: patterns of the facts of a French listing
WORDS = (
    Rule("furnished", "non_meuble", "furnished_negative", 1, r"non[-\s]?meubl[eé]e?s?|lou[eé]\s+vide|location\s+nue?"),
    Rule("furnished", "meuble", "furnished_positive", 2, r"\bmeubl[eé]e?s?\b|location\s+meubl[eé]e?"),
    Rule("availability", "mentioned", "availability", 1, r"(?:disponible|libre)\s+(?:imm[eé]diatement|le\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4})|disponible\s+(?:à partir du|a partir du)\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"),
    Rule("parking", "present", "parking", 1, r"(?:\d+\s*)?(?:places? de )?(?:parking|stationnement)|garage\s*(?:ferm[eé]|clos|privatif)?|\bbox\b"),
    Rule("terrace", "present", "terrace", 1, r"\bterrasse\b"),
    Rule("balcony", "present", "balcony", 1, r"\bbalcon\b"),
    Rule("varangue", "present", "varangue", 1, r"\bvarangue\b|\bv[eé]randa\b"),
    Rule("garden", "present", "garden", 1, r"\bjardin\b"),
    Rule("pool", "present", "pool", 1, r"\bpiscine\b"),
)
SUMS = (
    Rule("deposit", "amount", "deposit_amount", 1, r"(?:d[eé]p[oô]t de garantie|caution)\s*[:=]?\s*[0-9]{1,5}(?:[,.][0-9]{1,2})?\s*€"),
    Rule("fees", "amount", "agency_fees", 1, r"(?:honoraires?|frais d['’]agence)\s*(?:locataire|charge locataire|d['’]agence|agence)?\s*[:=]?\s*[0-9]{1,5}(?:[,.][0-9]{1,2})?\s*€"),
)
_GROUPED = r"[0-9]{1,3}(?:[ .\u00a0][0-9]{3})+|[0-9]{3,5}"
RENT = (Rule("rent", "amount", "rent_mentioned", 1, rf"(?:(?:loyer|montant du loyer)\s*:?\s*)?(?:{_GROUPED})\s*€\s*(?:CC|C\.C\.|charges? comprises?|HC|hors charges?)?"),)
CHARGES = (
    Rule("charges", "mentioned", "charges", 1, r"charges?\s*[:=]?\s*[0-9]{1,4}(?:[,.][0-9]{1,2})?\s*€|\+\s*[0-9]{1,4}(?:[,.][0-9]{1,2})?\s*€\s*(?:de\s*)?(?:ch|charges?)|\bcharges? comprises?\b|\bCC\b|hors charges?|\bHC\b"),
)
PROXIMITY = (Rule("proximity", "phrase", "proximity_phrase", 1, r"(?:proche|à proximité|a proximite|à deux pas|a deux pas)\s+(?:de|des|du|d['’])?\s*[^.;,\n]{3,80}"),)
#: Passes over the text, and what a text must hold for the pass to be worth its scan.
PASSES = ((WORDS, None), (SUMS, "€"), (RENT, "€"), (CHARGES, None), (PROXIMITY, None))
OUTDOOR = ("terrace", "balcony", "varangue", "garden", "pool")
#: Fields of which a negation says something; for the others it belongs to the phrase.
DENIABLE = ("parking", *OUTDOOR)
# fixed values: longest evidence, and longest proximity phrase
EVIDENCE, PHRASE = 180, 160

# A negation reaches over two words of its clause at most, and not over a word that turns it.
_NEGATION = _FLAGS + r"\b(?:sans|ni|aucune?|non|pas\s+(?:de\s+|d['’]\s*)?)\s*(?:(?!avec\b|mais\b|et\b)[\w'’-]+\s+){0,2}$"


def matches(text: Column, rules: tuple[Rule, ...], needs: str | None = None) -> Column:
    """Every match of one pass in order: structs of field, value, rule, priority, start, end (code points), text, negated."""
    either = "|".join(f"(?:{r.pattern})" for r in rules)

    def made(t: Column) -> Column:
        pieces = F.split(F.regexp_replace(F.translate(t, _OPEN + _CLOSE, "  "), _FLAGS + either, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,piece:string,before:string>>").alias("out"), F.lit("").alias("before"))
        # pieces alternate: what lies between matches, a match, what lies between, ...
        laid = F.aggregate(
            pieces, start,
            lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p.alias("piece"), acc["before"].alias("before")))).alias("out"), p.alias("before")),
            lambda acc: acc["out"],
        )
        found = F.filter(laid, lambda x, i: i % 2 == 1)

        def named(m: Column) -> Column:
            """The match with the first rule that it fits as a whole: patterns begin and end where the alternation's did."""
            which = lambda what: _first_fit(m["piece"], rules, what)
            return F.struct(
                which("field").alias("field"), which("value").alias("value"), which("name").alias("rule"), which("priority").cast("int").alias("priority"),
                m["at"].alias("start"), (m["at"] + F.length(m["piece"])).alias("end"), m["piece"].alias("text"), m["before"].rlike(_NEGATION).alias("negated"),
            )

        return F.transform(found, named)

    out = T.bind(text, made)
    nothing = F.array().cast("array<struct<field:string,value:string,rule:string,priority:int,start:int,end:int,text:string,negated:boolean>>")
    return F.when(F.contains(text, F.lit(needs)), out).otherwise(nothing) if needs else out


def _first_fit(piece: Column, rules: tuple[Rule, ...], what: str) -> Column:
    if len(rules) == 1:
        return F.lit(str(getattr(rules[0], what)))
    # word boundaries hold at both ends of a piece, as they did in the text
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(piece.rlike(f"{_FLAGS}^(?:{r.pattern})$"), F.lit(str(getattr(r, what)))).otherwise(out)
    return out


def _of(found: Column, *fields: str) -> Column:
    return F.filter(found, lambda m: m["field"].isin(*fields))


def decided(found: Column, field: str) -> Column:
    """The match that decides a field: by priority, then by place; null if there is none."""
    key = lambda m: F.struct(m["priority"], m["start"], m["end"], m["value"], m["rule"], m["text"], m["negated"])
    return F.array_min(F.transform(_of(found, field), key))


def stance(found: Column, field: str) -> Column:
    """Whether a text affirms a feature (any mention outside a negation), denies it (all within one), or says nothing."""
    own = _of(found, field)
    return F.when(F.size(own) == 0, "unknown").when(F.exists(own, lambda m: ~m["negated"]), "affirmed").otherwise("denied")


def _evidence(m: Column) -> Column:
    return F.struct(F.left(m["text"], F.lit(EVIDENCE)).alias("text"), m["rule"].alias("rule"), m["start"].alias("start"), m["end"].alias("end"), m["negated"].alias("negated"))


def _list(m: Column) -> Column:
    """The evidence as a list of one, or an empty one."""
    return F.array_compact(F.array(F.when(m.isNotNull(), _evidence(m))))


def _first(found: Column, field: str) -> Column:
    return F.get(_of(found, field), F.lit(0))


def all_digits(c: Column) -> Column:
    """All the digits of a text as one number."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def found_in(title: Column, description: Column) -> Column:
    """All matches of all passes over a listing's title and description, a line each."""
    text = F.concat_ws("\n", T.text(title), T.text(description))
    return F.concat(*[matches(text, rules, needs) for rules, needs in PASSES])


def analysis(title: Column, description: Column, status: Column, price: Column, found: Column) -> Column:
    """The analysis of a listing's texts, from ``found_in`` (a column of its own, so that it is computed once).

    The first mention of a sum counts; the rent's basis is what is written beside it."""
    own = F.regexp_replace(T.text(description), r"(?U)^\s+|\s+$", "")
    rent, deposit, fees = _first(found, "rent"), _first(found, "deposit"), _first(found, "fees")
    rent_value = all_digits(F.regexp_extract(F.left(rent["text"], F.lit(EVIDENCE)), f"({_GROUPED})", 1))
    basis = F.when(rent["text"].rlike(_FLAGS + "CC|charges? comprises?"), "cc").when(rent["text"].rlike(_FLAGS + "HC|hors charges?"), "hc").otherwise("unknown")
    apart = F.coalesce((rent_value != 0) & (F.abs(rent_value - price) >= 500), F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(F.contains(T.text(status), F.lit("Synthèse")), "description_fallback_synthetic"), F.when(F.length(own) < 120, "description_short_or_sparse"),
            F.when(F.contains(F.lower(F.concat_ws("\n", T.text(title), T.text(description))), F.lit("l'annonce a bien été ajoutée à vos favoris")), "boilerplate_detected"),
            F.when(apart, F.concat(F.lit("rent_field_mismatch: field price="), price.cast("string"), F.lit(", text rent="), rent_value.cast("string"))),
        )
    )
    furnished, parking, open_from, charges = decided(found, "furnished"), _first(found, "parking"), _first(found, "availability"), _first(found, "charges")
    said = lambda m: F.when(m.isNotNull(), "mentioned").otherwise("unknown")
    amount = lambda m: all_digits(F.left(m["text"], F.lit(EVIDENCE)))
    outdoor = F.array_compact(F.array(*[F.when((m := _first(found, f)).isNotNull(), _evidence(m)) for f in OUTDOOR]))
    phrases = F.transform(_of(found, "proximity"), lambda m: F.struct(F.left(m["text"], F.lit(PHRASE)).alias("text"), m["rule"].alias("rule"), m["start"].alias("start"), m["end"].alias("end")))
    return F.struct(
        F.lit("semantics_v1").alias("version"),
        F.struct((own != "").alias("description_present"), F.length(own).alias("description_length"), T.text(status).alias("status"), warnings.alias("warnings")).alias("quality"),
        F.struct(
            F.struct(rent_value.alias("value"), F.when(rent.isNotNull(), basis).otherwise("unknown").alias("charge_basis"), _list(rent).alias("evidence")).alias("rent_mentioned_eur"),
            F.struct(said(charges).alias("status"), _list(charges).alias("evidence")).alias("charges"),
            F.struct(amount(deposit).alias("amount_eur"), _list(deposit).alias("evidence")).alias("deposit"),
            F.struct(amount(fees).alias("amount_eur"), _list(fees).alias("evidence")).alias("agency_fees"),
        ).alias("financials"),
        F.struct(said(open_from).alias("status"), _list(open_from).alias("evidence")).alias("availability"),
        F.struct(F.struct(F.coalesce(furnished["value"], F.lit("unknown")).alias("status"), _list(furnished).alias("evidence")).alias("furnished")).alias("property_state"),
        F.struct(
            F.struct(F.when(parking.isNotNull(), True).alias("present"), stance(found, "parking").alias("stance"), _list(parking).alias("evidence")).alias("parking"),
            F.struct(outdoor.alias("evidence"), F.array_compact(F.array(*[F.when(stance(found, f) == "denied", f) for f in OUTDOOR])).alias("denied")).alias("outdoor"),
        ).alias("features"),
        F.struct(phrases.alias("raw_mentions")).alias("proximity"),
    )


def feature_tags(a: Column) -> Column:
    """Labels of what an analysis gives evidence of."""
    state, outdoor = a["property_state"]["furnished"]["status"], F.transform(a["features"]["outdoor"]["evidence"], lambda e: e["rule"])
    has = lambda *rules: F.arrays_overlap(outdoor, F.array(*[F.lit(r) for r in rules]))
    tags = F.array(
        F.when(state == "meuble", "Meublé").when(state == "non_meuble", "Non meublé"), F.when(a["features"]["parking"]["present"], "Parking"),
        F.when(has("terrace", "balcony", "varangue"), "Varangue / terrasse"), F.when(has("garden"), "Jardin"), F.when(has("pool"), "Piscine"),
    )
    return F.array_compact(tags)

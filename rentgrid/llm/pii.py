"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Patterns give the base spans: emails, IP addresses, card and phone numbers.  Their values are the
protected entities.  The corpus then says how strongly a term reveals an entity: with document
frequencies over all N documents, a term t near an entity c (within ``reach`` words of a mention)
has the point-wise mutual information log(N * df(t, c) / (df(t) * df(c))), and its disclosure is
that over the entity's information content log(N / df(c)): 1 if every document with the term has
the entity near it, 0 if they are independent.  Terms at or over ``generalise_at`` that are seen in
``support`` different contexts of the entity (so that copies of one passage are one witness) become
spans too, wherever they stand in the documents that hold the entity: generalised to their kind, or
removed from ``remove_at`` on.  Documents that do not hold the entity keep the term, as they have no
mention of it to protect.  Base spans are never changed by this.

Every document counts in every statistic.  Terms and entities are counted by partial sums before
any shuffle, pairs only arise between a mention and the few words around it.  Texts with terms to mark
are read once more; they meet their terms by MD5.

Defined results: null is the empty text; base spans of different kinds may overlap; overlapping
spans are replaced as one, under the first one's name; repeated rows each get their row and each
count as a document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm._common import cut, ship, small, stored

KINDS = ("email", "ip", "card", "phone", "term")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping within a kind."""
    out: list[tuple[str, int, int]] = []
    at = end = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = max(at + 1, end)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """The protected value, without the writing differences that don't matter."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def nearby(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[tuple[str, str, int, int, int]]:
    """(entity, term, start, end, context) of the words within ``reach`` words of each base span, on either side."""
    found = [(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]
    starts, ends = [x for _, x, _ in found], [y for _, _, y in found]
    out, free = [], uncovered(spans)
    for kind, a, b in spans:
        last, first = bisect_right(ends, a), bisect_left(starts, b)
        words = [w for w in found[max(0, last - reach) : last] + found[first : first + reach] if free(w[1], w[2])]
        context = xxhash.xxh64_intdigest(" ".join(w for w, _, _ in words)) - (1 << 63)
        out += [(entity(kind, text[a:b]), w, x, y, context) for w, x, y in words]
    return out


def uncovered(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Tells of a place whether it overlaps none of the spans."""
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(x: int, y: int) -> bool:
        i = bisect_left(starts, y)
        return i == 0 or merged[i - 1][1] <= x

    return free


def occurrences(text: str, actions: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, action) of every place of the terms outside base spans."""
    hits = [(*m.span(), actions[w]) for m in _WORD.finditer(text) if (w := m.group().lower()) in actions]
    free = uncovered(base_spans(text)) if hits else None
    return [h for h in hits if free(h[0], h[1])]


_SPAN = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
_TERM = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("action", pa.string())])
_NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("context", pa.int64())])


def _find(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            spans = [base_spans(t) for t in texts]
            near = [nearby(t, s, reach) if s else [] for t, s in zip(texts, spans)]
            base = pa.array([[dict(zip(("kind", "a", "b"), x)) for x in s] for s in spans], pa.list_(_SPAN))
            around = pa.array([[dict(zip(("entity", "term", "a", "b", "context"), x)) for x in n] for n in near], pa.list_(_NEAR))
            entities = pa.array([sorted({entity(k, t[x:y]) for k, x, y in s}) for t, s in zip(texts, spans)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), base, entities, around], ["uid", "doc_id", "key", "base", "entities", "near"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, terms) of texts and their (term, action)s."""
    for b in batches:
        both = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
        terms = [[dict(zip(("a", "b", "action"), x)) for x in occurrences(t, {w["term"]: w["action"] for w in ws})] for t, ws in both]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(_TERM))], ["key", "terms"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of this task's documents each term occurs."""
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["term", "n"])
        total.clear()
        return batch

    for b in batches:
        for x in b.column(0):
            total.update(set(_WORD.findall((x.as_py() or "").lower())))
            if len(total) > 200_000:
                yield out()
    yield out()


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 5, support: int = 2, generalise_at: float = 0.8, remove_at: float = 0.95
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (kind, a, b) by kind and start, and terms (a, b, action) by start."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("key"))
    schema = f"uid long, doc_id {kind}, key binary, base array<struct<kind:string,a:int,b:int>>, entities array<string>, near array<struct<entity:string,term:string,a:int,b:int,context:long>>"
    found = stored(rows.mapInArrow(_find(reach), schema))
    n_docs = found.count()
    pairs = found.select("uid", F.explode("near").alias("w")).select("uid", "w.*")
    met = pairs.groupBy("entity", "term").agg(F.count_distinct("uid").alias("both"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= support)
    met = cut(met)
    of_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = small(cut(met.select("term").distinct()))
    of_term = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies, "term string, n long").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = met.join(of_entity, "entity").join(of_term, "term").where(F.col("n_entity") < n_docs)
    pmi = F.log(F.lit(float(n_docs)) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    scored = scored.withColumn("disclosure", pmi / F.log(F.lit(float(n_docs)) / F.col("n_entity"))).where(F.col("disclosure") >= generalise_at)
    risky = small(cut(scored.select("entity", "term", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action"))))
    held = found.select("key", F.explode("entities").alias("entity")).distinct()
    actions = held.join(risky, "entity").groupBy("key", "term").agg(F.max("action").alias("action"))
    wanted = small(stored(actions.groupBy("key").agg(F.collect_list(F.struct("term", "action")).alias("actions"))))
    texts = docs.select(F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text")).join(wanted, "key").select("key", "text", "actions")
    listed = "array<struct<a:int,b:int,action:string>>"
    marked = texts.mapInArrow(_mark, f"key binary, terms {listed}").where(F.size("terms") > 0).groupBy("key").agg(F.first("terms").alias("terms"))
    none = F.array().cast(listed)
    return found.select("doc_id", "key", "base").join(small(stored(marked)), "key", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def redact(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """The text with its spans replaced; overlapping ones as one."""
    spans = sorted([(a, b, f"[{k.upper()}]") for k, a, b in base] + [(a, b, "" if x == "remove" else "[TERM]") for a, b, x in terms])
    out, at = [], 0
    for a, b, mark in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(doc_id, text): every text with its base spans and revealing terms replaced; null stays null."""
    kind = docs.schema[id_col].dataType.simpleString()
    # numbered once in a table, as spans and texts have to meet by row
    rows = stored(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    spans = find_spans(rows, "uid", "text", **more).select(F.col("doc_id").alias("uid"), "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, terms = (b.column(i) for i in range(3))
            both = zip(texts.to_pylist(), terms.to_pylist())
            new = [None if t is None else redact(t, base_spans(t), [(x["a"], x["b"], x["action"]) for x in s or []]) for t, s in both]
            yield pa.RecordBatch.from_arrays([ids, pa.array(new, pa.string())], ["doc_id", "text"])

    joined = rows.join(spans.where(F.size("terms") > 0), "uid", "left")
    return joined.select("doc_id", "text", "terms").mapInArrow(run, f"doc_id {kind}, text string")

"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text recognises exactly
the substrings of that sample.  A text is parsed from left to right into longest matches: when no
substring continues with the next character, a phrase ends and the next one starts there.  With c
phrases over n characters and a sample of L characters, c * log2(L) / n estimates the bits a
character costs, and the language with the fewest wins (ties: the smaller name).

The sample to learn from is bounded: of a language ``max_docs`` texts, chosen by a hash of the id, and of
these ``max_chars`` characters.  Longer texts give only their beginnings, all cut at the same length,
the one at which the bound is met.  Texts to predict are read whole: they are cut into pieces of
``PIECE`` characters only to be parsed side by side, and a phrase ends at a cut, for every language
alike.

Every character of any sample is a symbol of its own; one that no sample has continues no substring.

Normalisation: letters are lower-cased one by one, any run of other characters is one space.
Defined results: null texts and texts without a letter are ``und`` with score 0, as is any text
if no labelled row exists; the score is the runner-up's cost over the sum of both (1 if one
language is known); other columns are not read; repeated rows each get their row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm._common import ship

PIECE, BATCH = 1024, 2_000_000
#: So many of the commonest characters have a column in the transition tables.
DENSE = 254
_LETTERS: list[np.ndarray] = []
_MODELS: dict[str, Model] = {}


def letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter; 32 for what is no letter."""
    if not _LETTERS:
        lut = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                lut[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(lut)
    return _LETTERS[0]


def normalise(text: str | None) -> np.ndarray:
    """Code points of the normalised text, without spaces at either end."""
    x = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = x == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    x = x[keep]
    return x[int(len(x) > 0 and x[0] == 32) : len(x) - int(len(x) > 1 and x[-1] == 32)]


def automaton(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton: a flat table with a row a state and a column for each code below
    ``width``, and, sorted by state << 32 | code, keys and targets of all others.  States are stored times
    ``width``; row 0 is the dead state and row 1 the root."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.zeros(len(nxt) * width, np.int32)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            if c < width:
                table[s * width + c] = t * width
    rare = sorted(((s * width) << 32 | c, t * width) for s, edges in enumerate(nxt) for c, t in edges.items() if c >= width)
    return table, np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)


class Model:
    """Automata of all languages over one alphabet, the commonest characters first; code 0 stands for those no sample has."""

    def __init__(self, samples: dict[str, str]):
        points = {k: normalise(v) for k, v in sorted(samples.items())}
        points = {k: v for k, v in points.items() if len(v)}
        counts = Counter(x for v in points.values() for x in v.tolist())
        alphabet = sorted(counts, key=lambda c: (-counts[c], c))
        self.names = list(points)
        self.width = min(len(alphabet), DENSE) + 1
        self.code = np.zeros(0x110000, np.uint8 if len(alphabet) <= DENSE else np.int32)
        for i, c in enumerate(alphabet):
            self.code[c] = i + 1
        self.bits = [math.log2(len(v) + 1) for v in points.values()]
        self.tables = [automaton(self.code[v].tolist(), self.width) for v in points.values()]

    def phrases(self, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each piece by language; pieces: codes by position and piece, longest piece first."""
        out = np.empty((len(self.tables), len(lengths)), np.int32)
        alive = np.searchsorted(-lengths, -np.arange(pieces.shape[0]), side="left")
        for k, (table, keys, targets) in enumerate(self.tables):

            def step(state, c):
                if c.dtype == np.uint8:  # no character is rare
                    return table[state + c]
                t = table[state + np.where(c < self.width, c, 0)]
                rare = np.flatnonzero(c >= self.width)
                if len(rare) and len(keys):
                    key = state[rare].astype(np.int64) << 32 | c[rare]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    t[rare] = np.where(keys[at] == key, targets[at], 0)
                return t

            state = np.full(len(lengths), self.width, np.int32)
            count = np.ones(len(lengths), np.int32)
            for i, n in enumerate(alive.tolist()):
                c = pieces[i, :n]
                t = step(state[:n], c)
                dead = np.flatnonzero(t == 0)
                if len(dead):
                    count[dead] += 1
                    again = step(np.full(len(dead), self.width, np.int32), c[dead])
                    again[again == 0] = self.width
                    t[dead] = again
                state[:n] = t
            out[k] = count
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [self.code[x] if len(x) and x.max() != 32 else None for x in map(normalise, texts)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return lang, score
        parts = [(i, x[a : a + PIECE]) for i, x in enumerate(coded) if x is not None for a in range(0, len(x), PIECE)]
        if not parts:
            return lang, score
        parts.sort(key=lambda p: -len(p[1]))
        lengths = np.array([len(x) for _, x in parts])
        pieces = np.zeros((lengths[0], len(parts)), self.code.dtype)
        for j, (_, x) in enumerate(parts):
            pieces[: len(x), j] = x
        owner = np.array([i for i, _ in parts])
        costs = np.array([np.bincount(owner, weights=row, minlength=len(texts)) * b for row, b in zip(self.phrases(pieces, lengths), self.bits)])
        for i in np.unique(owner).tolist():
            order = np.argsort(costs[:, i], kind="stable")
            best, second = costs[order[0], i], costs[order[1], i] if len(order) > 1 else 0
            lang[i], score[i] = self.names[order[0]], float(second / (best + second)) if len(order) > 1 else 1.0
        return lang, score


def cut_length(lengths: list[int], most: int) -> int:
    """The greatest length at which to cut texts so that they have ``most`` characters together, or fewer."""
    left, at = most, 0
    for i, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - i) > left:
            return left // (len(lengths) - i)
        left, at = left - n, n
    return at


def sample(labelled: DataFrame, max_docs: int, max_chars: int, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Bounded training text by language: the texts with the smallest hashes of the id, cut at one length."""
    by = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.xxhash64("text"))
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    picked = rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= max_docs)
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.select("lang", "rn", F.substring("text", 1, max_chars).alias("text")).collect(), key=lambda r: (r.lang, r.rn)):
        texts.setdefault(r.lang, []).append(r.text)  # at most max_docs rows of max_chars a language
    out: dict[str, str] = {}
    for lang, own in texts.items():
        length = cut_length(list(map(len, own)), max_chars)
        out[lang] = "\n".join(t[:length] for t in own)
    return out


def identify(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 64, max_chars: int = 30_000
) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, learned from ``labelled`` alone."""
    spark = docs.sparkSession
    ship(spark)
    texts = sample(labelled, max_docs, max_chars, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = repr(sorted(shared.value.items()))
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(shared.value)
        model = _MODELS[key]
        for b in batches:
            ids, col = b.column(0), b.column(1)
            sizes = np.cumsum([len(x.as_py() or "") for x in col]) if len(col) else []
            at = 0
            while at < len(col):
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + BATCH, side="right")))
                lang, score = model.predict(col.slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
                at = to

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(fold: Column) -> Column:
    return fold == 0

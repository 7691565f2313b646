"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

A text becomes a vector of statistics (shares of character classes, word and line shapes,
repetition).  Standardised, they are projected by a fixed random matrix through a cosine, which
approximates a Gaussian kernel.  Every partition sums its own part of the normal equations, apart for
two halves of the labelled rows; the sums are added in a tree of bounded fan-in, and the driver solves
systems of ``features`` unknowns.  Each half is scored by the equations of the other one; these raw
scores are counted by label in fixed bins, and pool-adjacent-violators on the bins gives the
calibration of the scores by all rows' equations.

Defined results: null and empty texts have all-zero statistics and are scored like any other; a
doc_id labelled more than once counts as often; rows without a label, or with a null one, teach
nothing; if no labelled row exists, or all have one label, the score is the share of label 1 (0.5
without any row).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.llm._common import cut, ship, stored

BINS, FAN_IN = 2000, 32
_SYMBOLS = b"#$%&*|~^<>=_\\/{}[]@+`"
_CLASS = np.zeros(256, np.uint8)  # by byte: 1 lower, 2 upper, 3 digit, 4 symbol, 5 other punctuation, 6 space, 7 not ASCII
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b] = 7 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in [bytes([x]) for x in _SYMBOLS] else 6 if _c.isspace() or _b < 32 else 5
STATISTICS = (
    "log_bytes", "lower", "upper", "digit", "symbol", "punctuation", "space", "non_ascii", "exclamation", "pipe", "word_length", "word_spread",
    "capital_words", "shout_words", "marked_words", "bare_words", "distinct_words", "top_word", "repeats", "line_words", "line_repeats", "sentence_words",
)


def statistics(raw: bytes | None) -> list[float]:
    """The values of STATISTICS for one text."""
    if not raw or not (words := raw.split()):
        return [0.0] * len(STATISTICS)
    n, m = len(raw), len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    sizes = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    alpha = marked = bare = capital = shout = 0
    for w, c in counts.items():
        bare += c * (not w[:1].isalpha() and w[0] < 128 and not any(x > 127 for x in w))
        if w.isupper():
            shout += c * (len(w) > 1)
        elif w[:1].isupper():
            capital += c
        marked += c * (w[-1] < 128 and chr(w[-1]) in "#$%&*|~^<>=!?")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return [
        math.log1p(n), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], raw.count(b"!") / m, raw.count(b"|") / m,
        math.log1p(sizes.mean()), math.log1p(sizes.std()), capital / m, shout / m, marked / m, bare / m, len(counts) / m,
        max(counts.values()) / m, repeats / m, math.log1p(m / len(lines)), 1 - len(set(lines)) / len(lines), math.log1p(m / (1 + ends)),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(x.as_py()) for x in b.column(1).cast(pa.binary())]
        names = ["doc_id", "x", *b.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64())), *b.columns[2:]], names)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    ship(docs.sparkSession)
    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind(id_col)}", "x array<double>", *[f"{c} {kind(c)}" for c in also]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *also).mapInArrow(_measure, schema)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), len(STATISTICS))


class Kernel:
    """The random features: cos(W z + b) of the standardised statistics z, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / (width * math.sqrt(len(mean))), (len(mean), features))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        out = np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.hstack([out, np.ones((len(x), 1))])


def _sums(kernel: Kernel):
    """One row per task: for both halves of its rows (x, y, half) the sums of f f' and f y, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(kernel.b) + 1
        total = np.zeros((2, size, size + 1))
        for b in batches:
            if b.num_rows:
                f, half = kernel(_matrix(b.column(0))), b.column(2).to_numpy(zero_copy_only=False)
                both = np.hstack([f, b.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]])
                for k in range(2):
                    total[k] += f[half == k].T @ both[half == k]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    return run


def _add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in group["s"])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "s"])


def added(sums: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(slot, s): at most ``fan_in`` sums, of (slot, s) with a slot for each row; no task adds more than ``fan_in``."""
    ship(sums.sparkSession)
    while (sums := cut(sums)).count() > fan_in:
        sums = sums.groupBy(F.expr(f"slot div {fan_in}").cast("int").alias("to")).applyInArrow(_add, "slot int, s binary")
    return sums


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence closest to ``values``."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, x, m), (b, y, n) = pools.pop(-2), pools.pop()
            pools.append([(a * x + b * y) / (x + y), x + y, m + n])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def train(x: DataFrame, labels: DataFrame, features: int = 256, width: float = 0.7, ridge: float = 1e-3, seed: int = 17):
    """A function from a matrix of statistics to scores, learned from (doc_id, x) and (doc_id, y)."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    known = cut(x.join(labels.where("y is not null"), "doc_id").select("x", F.col("y").cast("int").alias("y"), half))
    share = known.agg(F.avg("y").alias("p")).head().p
    if share is None or share in (0.0, 1.0):
        constant = 0.5 if share is None else float(share)
        return lambda m: np.full(len(m), constant)
    d = len(STATISTICS)
    moments = known.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(d)]).head()
    kernel = Kernel(np.array(moments[:d], float), np.array(moments[d:], float), features, width, seed)
    sums = added(known.mapInArrow(_sums(kernel), "s binary").select(F.spark_partition_id().alias("slot"), "s"))
    size = features + 1
    halves = sum(np.frombuffer(r.s) for r in sums.collect()).reshape(2, size, size + 1)  # FAN_IN sums at most

    def solved(total: np.ndarray) -> np.ndarray:
        n = max(total[-1, -2], 1)
        return np.linalg.solve(total[:, :size] + ridge * n / size * np.eye(size), total[:, size])

    weights, other = solved(halves.sum(0)), np.array([solved(halves[1]), solved(halves[0])])

    def raw(m: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        return np.clip(kernel(m) @ weights if by is None else (kernel(m) * by).sum(1), -0.5, 1.5)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = raw(_matrix(b.column(0)), other[b.column(2).to_numpy(zero_copy_only=False)])
                bins = np.minimum(((s + 0.5) / 2 * BINS).astype(int), BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), b.column(1)], ["bin", "y"])

    counts = known.mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # BINS rows at most
    at = np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in counts])
    level = isotonic(np.array([r.y for r in counts]), np.array([float(r.n) for r in counts]))
    # ties within a pool keep the order of the raw score: a thousandth of it is mixed in
    return lambda m: np.clip(0.999 * np.interp(s := raw(m), at, level) + 0.001 * (s + 0.5) / 2, 0, 1)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), **more) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, and its columns ``also``; labels: (doc_id, y) to learn from."""
    x = stored(measured(docs, id_col, text_col, also))
    model = train(x, labels, **more)  # a few hundred kB, sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model(_matrix(b.column(1))) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), *b.columns[2:]], ["doc_id", "score", "predicted", *also])

    kind = lambda c: x.schema[c].dataType.simpleString()
    return x.mapInArrow(run, ", ".join([f"doc_id {kind('doc_id')}", "score double", "predicted int", *[f"{c} {kind(c)}" for c in also]]))


def teaching(fold: Column) -> Column:
    return fold != 1

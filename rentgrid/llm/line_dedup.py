"""Fuzzy line de-duplication by MinHash, in DataFrame functions only.

Lines are compared after lower-casing and folding white space (space, tab, carriage return, form
feed, vertical tab, no-break space).  A line's shingles are the ``shingle`` characters from each
character on; a line of one shingle or none is only compared as a whole.  A line's MinHash signature
are the ``sketch`` first of its shingles in one fixed order of all shingles: those that begin with
one of the ``FIRST`` characters (about one in seven) come before the others, each kind by hash.  So
most lines are sketched without hashing every shingle, and those with too few of the first kind go on
with the rest.  Every three neighbours in a signature are a band.  At a similarity of 0.8 two lines
of sixteen places agree on some band with a probability of 0.997 (and for certain if they have no
more shingles than places).

Every pair of a band of at most ``max_band`` lines is tried.  In a larger one the member that meets most
others elsewhere is the star, and each line is verified against the stars it shares most bands with.
The lines of the larger bands in which several components are left are then searched exactly, among
each other: in an order of all their shingles by the number of lines that have them, two similar lines share one
of the first (``rare``), have enough behind it for the rest, and differ in few shingles (``near``).  The last is told from
256 parities a line: a shingle that only one of two lines has flips one of them, so two similar lines never differ in more
parities than they may in shingles.  After one round of stars for the rare shingles, every such pair of different components
is verified.  So no link of a larger band is lost, and only lines that share a rare shingle and few of whose parities differ
are paired off.

A pair from a band is verified if a sketch of 64 places does not speak against it, any other without that, by the exact
Jaccard similarity of all shingles, for which 64-bit hashes stand (as for the lines themselves).  Verified
pairs are joined by distributed union-find, and of every component the line that occurs first, by
document id and line number, stays.  Equal lines are one line in all of this.

Texts are read again for the lines of shared bands, of which one occurrence each is cut out, and for
the result.

Defined results: a null text has no lines and stays null; blank lines always stay and are not
counted; a kept line keeps its original form; rows that share an id and a text keep or lose lines
together, as one document; documents with a null id come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm._common import small, stored
from rentgrid.llm._graph import components

SHINGLE, SKETCH, RUN, SIMILARITY, MAX_BAND = 9, 16, 3, 0.8, 32
#: Places of the sketch that is compared before a pair is verified, stars a line is verified against at a time.
PLACES, STARS = 64, 3
#: 64-bit words of the parities by which sets of shingles are told apart before they are compared.
WORDS = 4
#: Up to so many 64-bit keys are broadcast to pick lines or documents out of a scan.
KEYS = 1_000_000
#: Up to so many rows of a few dozen bytes, or lists of as many entries in all, are broadcast.
LISTS = 300_000
_SPACES = "\t\r\f\x0b "
#: The characters that begin the first shingles: ASCII ones whose code leaves 3 when divided by 4, and all others.
FIRST = "".join(f"\\x{c:02x}" for c in range(128) if c % 4 == 3) + "\\x{80}-\\x{10ffff}"


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """The shingles in order, repeats included."""
    # one pass of a pattern for all of a line's shingles: it looks ahead, then takes one character
    return F.regexp_extract_all(line, F.lit("(?s)(?=(.{%d}))." % size), F.lit(1))


def _beginning(line: Column, size: int, first: bool) -> Column:
    """Hashes in order, repeats included, of the shingles that begin with a first character (negative ones) or with another."""
    # the character is tried before anything is captured: from behind it, the pattern looks back at the shingle
    found = F.regexp_extract_all(line, F.lit("(?s)[%s%s](?<=(?=(.{%d})).)" % ("" if first else "^", FIRST, size)), F.lit(1))
    mark = (lambda h: h.bitwiseOR(F.lit(-(1 << 31)))) if first else (lambda h: h.bitwiseAND(F.lit((1 << 31) - 1)))
    return F.sort_array(F.transform(found, lambda x: mark(F.hash(x))))


def with_sketch(lines: DataFrame, size: int, sketch: int, name: str = "m") -> DataFrame:
    """Adds the signature: hashes of the first ``sketch`` different shingles in the fixed order."""
    rows = lines.withColumn("_first", _beginning(F.col("line"), size, True))
    # the lowest ones are mostly different; where they are not, all are taken
    rows = rows.withColumn("_few", F.array_distinct(F.slice("_first", 1, sketch + sketch // 2)))
    rows = rows.withColumn("_few", F.when(F.size("_few") >= sketch, F.col("_few")).otherwise(F.array_distinct("_first")))
    rest = F.array_distinct(_beginning(F.col("line"), size, False))
    whole = F.concat("_few", F.slice(rest, F.lit(1), sketch - F.size("_few")))
    return rows.withColumn(name, F.when(F.size("_few") >= sketch, F.slice("_few", 1, sketch)).otherwise(whole)).drop("_first", "_few")


def folded(text: Column) -> Column:
    """The text with its lines folded, but for spaces at their ends."""
    low = F.lower(text)
    odd = low.contains(_SPACES[0])
    for c in _SPACES[1:]:
        odd = odd | low.contains(c)
    even = F.when(odd, F.translate(low, _SPACES, " " * len(_SPACES))).otherwise(low)
    return F.when(even.contains("  "), F.regexp_replace(even, " {2,}", " ")).otherwise(even)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n, line, k) of every line that is not blank; k stands for its folded form."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), folded(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    rows = rows.select("doc_id", "th", "n", F.trim("raw").alias("line")).where("line != ''")
    return rows.withColumn("k", F.xxhash64("line"))


def bands(m: Column, sketch: int) -> Column:
    """Hashes of every ``RUN`` neighbours in a signature; of every two in those of at most five shingles,
    as two sets of four and five may share no three neighbours."""
    runs = lambda r: F.transform(F.sequence(F.lit(1), F.size(m) - r + 1), lambda i: F.xxhash64(*[F.element_at(m, i + j) for j in range(r)]))
    return F.when(F.size(m) < 5, runs(2)).when((F.size(m) == 5) & (sketch > 5), F.concat(runs(2), runs(RUN))).otherwise(runs(RUN))


def shared_bands(seen: DataFrame, sketch: int) -> tuple[DataFrame, DataFrame]:
    """Bands that several different lines have: (a, b) of those of two lines, (band, k, size) of the larger ones."""
    once = seen.where(F.size("m") > 1).select("k", "m").dropDuplicates(["k"])
    signed = once.select("k", F.explode(bands(F.col("m"), sketch)).alias("band"))
    met = signed.repartition("band").groupBy("band").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("size"))
    met = stored(met.where("a < b"))
    more = met.where("size > 2").select("band", "size")
    return met.where("size = 2").select("a", "b"), stored(signed.join(small(more, KEYS), "band"))


def lines_to_verify(docs: DataFrame, text_col: str, seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, line) of the wanted lines: one occurrence of each is cut out of its text."""
    at = seen.join(small(wanted, KEYS), "k", "left_semi").groupBy("k").agg(F.min(F.struct("th", "n")).alias("at"))
    at = stored(at.groupBy(F.col("at.th").alias("th")).agg(F.collect_list(F.struct(F.col("at.n").alias("n"), "k")).alias("ns")))
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).join(small(at.select("th"), KEYS), "th", "left_semi")
    picked = texts.join(_listed(at, "ns"), "th").select("ns", F.split("text", "\n").alias("parts")).select(F.explode("ns").alias("x"), "parts")
    return picked.select(F.col("x.k").alias("k"), F.trim(folded(F.get("parts", F.col("x.n")))).alias("line")).dropDuplicates(["k"])


def _listed(lists: DataFrame, *columns: str) -> DataFrame:
    """Broadcast a stored table of lists if it has few rows and few entries in all."""
    entries = lists.agg(F.coalesce(F.sum(sum((F.size(c) for c in columns), F.lit(0))), F.lit(0))).head()[0]
    return small(lists, LISTS) if entries <= 2 * LISTS else lists


def _once(value: Column, name: str) -> Column:
    """A value that no filter above works out again."""
    return F.explode(F.array(value)).alias(name)


class Search:
    """The components of lines found so far; ``lines``: (k, line, m), m a sketch of ``PLACES``."""

    def __init__(self, lines: DataFrame, size: int, similarity: float):
        self.lines, self.size, self.similarity = lines, size, similarity
        self.sets = None
        self.roots = stored(lines.select(F.col("k").alias("node"), F.col("k").alias("root")).where("false"))

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows (band, k, ...) with their component, comp, of the bands in which several components are left."""
        of = stored(rows.join(small(self.roots.withColumnRenamed("node", "k"), KEYS), "k", "left").withColumn("comp", F.coalesce("root", "k")).drop("root"))
        several = of.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
        return stored(of.join(small(stored(several), KEYS), "band", "left_semi"))

    def add(self, pairs: DataFrame, sketched: bool = True) -> bool:
        """Verify (a, b) pairs of lines and join the components of those that are similar; whether there were any.

        ``sketched``: pairs whose sketches speak against it are left out."""
        new = stored(self.verified(self.likely(pairs) if sketched else pairs))
        if not new.head(1):
            return False
        known = small(self.roots, KEYS)
        for x in "ab":
            new = new.join(known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
        new = stored(new)
        moved = stored(components(new, "ra", "rb"))
        now = self.roots.unionByName(new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").withColumn("root", F.col("node")))
        to = small(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), KEYS)
        self.roots = stored(now.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        return True

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ma, mb) whose sketches do not speak against the similarity, as (a, b).

        Of the first places of both lines together, those that both have are counted: a pair of similarity 0.8
        falls short of 0.62 of 64 by chance with a probability under 0.001."""
        least = (self.similarity - 0.18) * F.least(F.lit(PLACES), F.greatest(F.size("ma"), F.size("mb")))
        met = pairs.select("a", "b", "ma", "mb", _once(F.array_intersect("ma", "mb"), "both")).where(F.size("both") >= least)
        met = met.select("a", "b", "both", _once(F.slice(F.sort_array(F.array_union("ma", "mb")), 1, PLACES), "union"))
        return met.where(F.size(F.array_intersect("both", "union")) >= (self.similarity - 0.18) * F.size("union")).select("a", "b")

    def likely(self, pairs: DataFrame) -> DataFrame:
        a = self.lines.select(F.col("k").alias("a"), F.col("m").alias("ma"))
        b = self.lines.select(F.col("k").alias("b"), F.col("m").alias("mb"))
        return self.alike(pairs.join(a, "a").join(b, "b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose shingle sets are similar; the sets of ``a``, which many pairs share, are worked out once."""
        hashes = lambda line: F.transform(shingles(line, self.size), lambda x: F.xxhash64(x))
        pairs = stored(pairs)
        of = self.lines.join(small(stored(pairs.select(F.col("a").alias("k")).distinct()), KEYS), "k", "left_semi")
        a = of.select(F.col("k").alias("a"), F.array_distinct(hashes(F.col("line"))).alias("ha"))
        b = self.lines.select(F.col("k").alias("b"), F.col("line").alias("lb"))
        met = pairs.join(b, "b").join(a, "a").select("a", "b", "ha", _once(hashes(F.col("lb")), "hb"))
        met = met.select("a", "b", "hb", F.size("ha").alias("na"), _once(F.size(F.array_intersect("ha", "hb")), "both"))
        enough = lambda nb: F.col("both") >= self.similarity * (F.col("na") + nb - F.col("both"))
        # repeated shingles only matter where the pair falls short with them
        return met.where(enough(F.size("hb")) | ((F.col("both") >= self.similarity * F.col("na")) & enough(F.size(F.array_distinct("hb"))))).select("a", "b")

    def stars(self, rows: DataFrame, again: bool = False) -> DataFrame:
        """(a, b) of members of open bands (band, k, comp, size) and their bands' stars.

        A star is the member that meets most others; of those outside the band's smallest component, if ``again``."""
        known = rows.withColumn("fame", F.sum("size").over(Window.partitionBy("k")))
        if again:
            known = known.join(rows.groupBy("band").agg(F.min("comp").alias("low")), "band").where("comp > low")
        star = known.groupBy("band").agg(F.max(F.struct("fame", "k", "comp")).alias("s")).select("band", F.col("s.k").alias("a"), F.col("s.comp").alias("of"))
        votes = rows.join(star, "band").where("comp != of").groupBy("a", F.col("k").alias("b")).agg(F.count("*").alias("votes"))
        best = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
        return votes.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= STARS).select("a", "b")

    def rare(self, wanted: DataFrame) -> DataFrame:
        """(band, k, size, n, behind): the shingles by which lines (k) may be similar to others of them.

        In an order of all shingles by the number of lines that have them, similar sets of n and of at most n share one
        of the first n - ceil(similarity * n) + 1 of the larger.  A band is a shingle, size the number of its lines; behind
        are the line's shingles from this one on.  Shingles of one line alone are only counted.  Keeps every line's parities
        as ``sets``: (k, of, w0, ...), of the number of its shingles."""
        hashes = F.array_distinct(F.transform(shingles(F.col("line"), self.size), lambda x: F.xxhash64(x)))
        each = stored(self.lines.join(small(wanted, KEYS), "k", "left_semi").select("k", F.explode(hashes).alias("band")))
        sizes = stored(each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("band", 8).bitwiseAND(F.lit(63)).cast("int"))
        words = [F.bit_xor(F.when(F.pmod("band", F.lit(WORDS)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
        self.sets = stored(each.groupBy("k").agg(F.count("*").alias("of"), *words))
        lists = each.join(small(sizes, KEYS), "band", "left").groupBy("k").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "band")))).alias("x"))
        own = F.col("n") - F.size("x")
        first = F.greatest(F.lit(0), (F.col("n") - F.ceil(self.similarity * F.col("n") - 1e-6) + 1 - own).cast("int"))
        found = lists.select("k", "n", F.size("x").alias("shared"), F.posexplode(F.slice("x", F.lit(1), first)).alias("i", "x"))
        return stored(found.select("x.band", "k", "x.size", "n", (F.col("shared") - F.col("i")).alias("behind")))

    def few(self, x: str, y: str) -> Column:
        """Whether the parities of two lines differ in no more places than similar lines may differ in shingles."""
        differ = sum((F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(WORDS)), F.lit(0))
        return (1 + self.similarity) * differ <= (1 - self.similarity) * (F.col(f"{x}.of") + F.col(f"{y}.of")) + 1e-6

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs of lines of ``sets`` that ``few`` does not rule out."""
        sets = small(self.sets, LISTS)
        met = pairs.join(sets.alias("x"), F.col("a") == F.col("x.k")).join(sets.alias("y"), F.col("b") == F.col("y.k"))
        return met.where(self.few("x", "y")).select("a", "b")

    def near(self, rows: DataFrame) -> DataFrame:
        """(a, b): every pair of lines of different components in ``rare`` bands that may be similar: from the first shingle
        that both have, similar lines have enough left for what they must share, and few of their parities differ."""
        rows = rows.join(small(self.sets, LISTS), "k")
        x, y = rows.alias("x"), rows.alias("y")
        most, both = F.least("x.behind", "y.behind"), F.col("x.n") + F.col("y.n")
        near = (F.col("x.k") < F.col("y.k")) & (F.col("x.comp") != F.col("y.comp")) & (most >= self.similarity * (both - most) - 1e-6)
        return x.join(y, (F.col("x.band") == F.col("y.band")) & near & self.few("x", "y")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of the lines of each band (band, k)."""
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))


def line_links(docs: DataFrame, text_col: str, seen: DataFrame, size: int, sketch: int, similarity: float, max_band: int) -> DataFrame:
    """(node, root): the components of similar lines, from the sketched occurrences ``seen``."""
    twos, rows = shared_bands(seen, sketch)
    members = rows.select("k").unionByName(twos.select(F.explode(F.array("a", "b")).alias("k")))
    lines = lines_to_verify(docs, text_col, seen, stored(members.distinct()))
    search = Search(stored(with_sketch(lines, size, PLACES)), size, similarity)
    crowd = rows.where(F.col("size") > max_band)
    pairs = twos.unionByName(_pairs(rows.where(F.col("size") <= max_band)))
    search.add(stored(pairs.unionByName(search.stars(crowd.withColumn("comp", F.col("k")))).distinct()))
    left = search.open(crowd)
    if left.head(1):
        rare = search.rare(stored(left.select("k").distinct()))
        left = search.open(rare)
        if left.head(1) and search.add(search.possible(search.stars(left, again=True)), sketched=False):
            left = search.open(rare)
        search.add(search.near(left), sketched=False)
    return search.roots


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, sketch: int = SKETCH, similarity: float = SIMILARITY, max_band: int = MAX_BAND) -> DataFrame:
    """(doc_id, th, n, component, drop) of the lines whose class has several occurrences; th hashes the text.

    Lines that are not listed are alone in their class and stay."""
    seen = stored(with_sketch(lines_of(docs, id_col, text_col), size, sketch).select("doc_id", "th", "n", "k", "m"))
    roots = line_links(docs, text_col, seen, size, sketch, similarity, max_band).withColumnRenamed("node", "k")
    place = F.struct("doc_id", "n", "th")
    classed = seen.select("doc_id", "th", "n", "k").join(small(roots, KEYS), "k", "left").select("doc_id", "th", "n", F.coalesce("root", "k").alias("component"))
    winners = classed.groupBy("component").agg(F.min(place).alias("winner"), F.count("*").alias("times")).where("times > 1").select("component", "winner")
    marked = classed.join(small(stored(winners), LISTS), "component")
    return marked.select("doc_id", "th", "n", "component", (~F.col("winner").eqNullSafe(place)).alias("drop"))


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the lines that stay), n_lines (not blank), n_dropped,
    dropped (line numbers from 0) and classes (the components of the dropped lines)."""
    dropped = line_classes(docs, id_col, text_col, **more).where("drop")
    lists = dropped.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("n", "component"))).alias("d"))
    lists = stored(lists.select("doc_id", "th", F.transform("d", lambda x: x["n"]).alias("dropped"), F.transform("d", lambda x: x["component"]).alias("classes")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    touched = small(lists.select("th").distinct(), KEYS)
    same = F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.th") == F.col("l.th"))
    changed = rows.join(touched, "th", "left_semi").alias("r").join(_listed(lists, "dropped").alias("l"), same, "left").select("r.doc_id", "r.text", "l.dropped", "l.classes")
    none, no_class = F.array().cast("array<int>"), F.array().cast("array<long>")
    whole = rows.join(touched, "th", "left_anti").select("doc_id", "text", none.alias("dropped"), no_class.alias("classes"))
    both = whole.unionByName(changed.select("doc_id", "text", F.coalesce("dropped", none).alias("dropped"), F.coalesce("classes", no_class).alias("classes")))
    parts = F.split("text", "\n")
    stay = F.filter(parts, lambda x, i: ~F.array_contains("dropped", i))
    written = F.filter(parts, lambda x: F.ltrim(x, F.lit(" " + _SPACES)) != "")
    return both.select(
        "doc_id", F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        F.coalesce(F.size(written), F.lit(0)).alias("n_lines"), F.size("dropped").alias("n_dropped"), "dropped", "classes",
    )

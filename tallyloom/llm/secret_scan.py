"""Secret scan: fixed patterns, and a battery of randomness tests for the rest.

Everything is built from column functions.  Candidates are long runs of
encoding characters that hold a digit and a letter ('=' only ends a run), what
is left of a run without the words before it, and its long parts between '/',
'-' and '_', since a secret may stand behind a name or in a path.
The smallest alphabet that has all characters of a candidate is taken as the
encoding, under which a random string has independent, uniform symbols.
Three tests ask for that:

* chi-squared of the symbol counts (Wilson-Hilferty), both tails,
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

The three p are combined by Fisher's method.  Random strings have p spread over
0..1, ordinary ones near 0, but short ones give the tests little to see.  So
the threshold is set for each encoding and length band, from two references of
strings that are no secrets: names made of common words, and the runs of the
documents themselves that hold no digit.  Their tails tell how many of the
ordinary candidates, counted by the lowest p over all documents, would pass a
threshold; the lowest one that keeps those within ``FALSE_SHARE`` of all that
pass is used.  Where none does, the battery adds nothing.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the capture group that has a least length, and that length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
)
#: Whole runs; runs from the first part on that doesn't look like a word of a name or path; parts.  '=' may only end them.
CANDIDATES = (
    r"[A-Za-z0-9+/_-]{20,}=*",
    r"(?<![A-Za-z0-9+])(?!(?:[A-Z]?[a-z]{0,15}|[A-Z]{0,15})[0-9]{0,2}(?![A-Za-z0-9+]))[A-Za-z0-9+/_-]{20,}=*",
    r"[A-Za-z0-9+]{20,}=*",
)
#: Name, pattern of the whole string, alphabet in the order of its symbols.
ENCODINGS = (
    ("hex", r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"[a-z0-9]+|[A-Z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", r"[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"[A-Za-z0-9+/_=-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
BANDS = (20, 28, 40, 64, 128)
P_BINS = 20
FALSE_SHARE = 0.05
#: Reference names for each encoding and length band, and how many runs without a digit a band needs to be a reference.
REFERENCE_NAMES, LEAST_RUNS = 2000, 50
#: Common words of names and paths, and pieces of hexadecimal numbers that are no secrets.
NAME_WORDS = ("user data file name list item page view test main core base code type value index table column row key map set get put post log info error "
              "debug config server client cache queue event source target input output build release version module package service handler factory "
              "manager session request response message content image video audio report summary detail record field label group member account profile "
              "section chapter history archive backup order product customer invoice payment river house stone market garden winter summer").split()
HEX_PIECES = "00 01 02 10 20 ff 0000 ffff 1234 2024 2023 0101 1231 dead beef cafe face babe feed abcd 00ff a0 b1 c2 0a 0b 0c 80 7f 55 aa".split()
#: Symbols of a candidate that the tests read at a time; longer ones are judged by all their pieces.
GROUP = 512

SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.transform(F.array(value), of)[0]


def running(sizes: Column) -> Column:
    """Running sums of an array, in groups so that long arrays stay cheap."""
    def total(part):
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def grouped(groups):
        def of_group(group, i):
            return let(total(F.transform(F.slice(groups, F.lit(1), i), total)), lambda base: F.transform(
                group, lambda _, j: base + total(F.slice(group, F.lit(1), j + 1))))

        return F.flatten(F.transform(groups, of_group))

    def cut_up(sizes):
        starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int"))
        return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(
            let(F.transform(starts, lambda k: F.slice(sizes, k * GROUP + 1, F.lit(GROUP))), grouped))

    return let(sizes, cut_up)


def found_spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost, non-overlapping matches as spans in code points; those whose ``group`` is shorter than ``least`` are dropped."""
    def place(found):
        def with_gaps(gaps):
            sizes = F.transform(found, lambda m, i: F.length(gaps[i]) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
            return let(running(sizes), lambda starts: F.transform(found, lambda m, i: F.struct(
                starts[i].alias("start"), (starts[i] + F.length(m)).alias("end"), F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"), F.length(F.regexp_extract(m, pattern, group) if group else m).alias("own"))))

        spans = let(F.split(text, pattern, -1), with_gaps)
        kept = F.filter(spans, lambda s: s["own"] >= least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) == 0, F.array().cast(SPAN)).otherwise(place(found)))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns by start, then kind as listed."""
    return F.array_sort(F.concat(*(found_spans(text, kind, rank, *rest) for rank, (kind, *rest) in enumerate(BASE))))


def normal_tails(z: Column) -> Column:
    """Chance of a standard normal beyond +-z (a polynomial good to 1e-7)."""
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def uniformity(symbols: Column, size: int) -> Column:
    """z of the chi-squared of symbol counts (Wilson-Hilferty)."""
    df = size - 1
    squares = F.aggregate(F.transform(F.array_distinct(symbols), lambda d: F.size(F.filter(symbols, lambda s: s == d)).cast("double")),
                          F.lit(0.0), lambda a, c: a + c * c)
    chi = squares * size / F.size(symbols) - F.size(symbols)
    return (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5


def runs(symbols: Column, size: int) -> Column:
    """z of the number of runs above and below the middle; no runs to count if all lie on one side: far out."""
    def of(high):
        n = F.size(high).cast("double")
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        seen = F.size(F.filter(F.transform(high, lambda h, i: (i == 0) | (h != F.get(high, i - 1))), lambda c: c)).cast("double")
        return let(2 * n1 * (n - n1), lambda two: F.when(two == 0, F.lit(9.0)).otherwise(
            (seen - two / n - 1) / F.sqrt(F.greatest(two * (two - n) / (n * n * (n - 1)), F.lit(1e-9)))))

    return let(F.transform(symbols, lambda s: s >= size / 2), of)


def correlation(symbols: Column, size: int) -> Column:
    """z of the correlation of each symbol with the next."""
    mean = (size - 1) / 2
    variance = (size * size - 1) / 12
    n = F.size(symbols).cast("double")
    products = F.zip_with(F.slice(symbols, F.lit(1), F.size(symbols) - 1), F.slice(symbols, F.lit(2), F.size(symbols) - 1),
                          lambda a, b: (a - mean) * (b - mean))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / (variance * F.sqrt(n - 1))


def p_of(symbols: Column, size: int) -> Column:
    """Fisher's combination of the three tests' p; over groups of a long candidate, the least times their number."""
    def of(group):
        logs = [F.ln(F.greatest(normal_tails(test(group, size)), F.lit(1e-300))) for test in (uniformity, runs, correlation)]
        # the chance that three uniform numbers have a product as small as theirs
        return let(-(logs[0] + logs[1] + logs[2]), lambda x: F.least(F.lit(1.0), F.exp(-x) * (1 + x + x * x / 2)))

    last = F.floor((F.size(symbols) - 1) / GROUP).cast("int")
    parts = F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(symbols, k * GROUP + 1, F.lit(GROUP))),
                     lambda g: F.size(g) >= BANDS[0])
    return F.least(F.lit(1.0), F.aggregate(parts, F.lit(1.0), lambda a, g: F.least(a, of(g))) * F.size(parts))


def battery(value: Column) -> Column:
    """Struct (encoding, band, p) of one candidate string; ``encoding`` is its place in ENCODINGS."""
    band = sum((F.length(value) >= b).cast("int") for b in BANDS[1:])
    core = F.regexp_replace(value, "=+$", "")
    out = None
    for k, (name, pattern, alphabet) in reversed(list(enumerate(ENCODINGS))):
        folded = F.translate(core, "-_", "+/") if name == "base64" else F.lower(core) if name in ("hex", "alnum") else core
        p = let(F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1),
                lambda s: p_of(s, len(alphabet)))
        one = F.struct(F.lit(k).alias("encoding"), band.alias("band"), p.alias("p"))
        out = one if out is None else F.when(core.rlike(f"^(?:{pattern})$"), one).otherwise(out)
    return out


def found_values(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches of ``pattern``."""
    def place(found):
        def with_gaps(gaps):
            sizes = F.transform(found, lambda m, i: F.length(gaps[i]) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
            return let(running(sizes), lambda starts: F.transform(found, lambda m, i: F.struct(
                starts[i].alias("start"), (starts[i] + F.length(m)).alias("end"), m.alias("value"))))

        return let(F.split(text, pattern, -1), with_gaps)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(place(found)))


def candidates(text: Column, plain: bool = False) -> Column:
    """Array of (start, end, encoding, band, p, plain) of the candidates that hold a digit and a letter; some hold others.

    ``plain`` adds the runs that hold no digit, marked as such: no secrets.
    """
    spans = F.array_distinct(F.concat(*(found_values(text, pattern) for pattern in CANDIDATES)))
    wanted = (lambda s: s["value"].rlike("[A-Za-z]")) if plain else (lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    mixed = F.filter(spans, lambda s: wanted(s) & (F.length(F.regexp_replace(s["value"], "=+$", "")) >= BANDS[0]))
    return F.transform(mixed, lambda s: let(battery(s["value"]), lambda b: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), b["encoding"].alias("encoding"), b["band"].alias("band"), b["p"].alias("p"),
        (~s["value"].rlike("[0-9]") if plain else F.lit(False)).alias("plain"))))


def reference_names() -> list[tuple[str]]:
    """Names made of common words, ``REFERENCE_NAMES`` for each encoding and length band, the same in every run."""
    rng = random.Random(5)
    pick = rng.choice

    def name(kind: str, length: int) -> str:
        if kind == "hex":
            join, piece = "", lambda: pick(HEX_PIECES)
        elif kind == "base64":
            join, piece = pick("-_/"), lambda: pick((pick(NAME_WORDS), pick(NAME_WORDS), pick(NAME_WORDS).title(), str(rng.randrange(100))))
        elif kind == "base62":
            join, piece = "", lambda: pick((pick(NAME_WORDS).title(), pick(NAME_WORDS).title(), pick(NAME_WORDS), str(rng.randrange(100))))
        elif kind == "base32":
            join, piece = "", lambda: pick((pick(NAME_WORDS).upper(), pick(NAME_WORDS).upper(), pick("234567")))
        else:
            join, piece = "", lambda: pick((pick(NAME_WORDS), pick(NAME_WORDS), str(rng.randrange(100))))
        out = piece()
        while len(out) < length:
            out += join + piece()
        return out[:length]

    ends = (*BANDS[1:], 2 * BANDS[-1])
    return [(name(kind, rng.randrange(low, high)),) for kind, *_ in ENCODINGS for low, high in zip(BANDS, ends) for _ in range(REFERENCE_NAMES)]


def binned(found: DataFrame) -> DataFrame:
    """``(encoding, band, plain, bin, n)`` of candidates ``c``."""
    p_bin = F.least(F.floor(F.col("c.p") * P_BINS), F.lit(P_BINS - 1)).cast("int").alias("bin")
    return found.groupBy("c.encoding", "c.band", "c.plain", p_bin).agg(F.count("*").alias("n"))


def thresholds(docs: DataFrame, text_col: str = "text") -> list[list[float]]:
    """Least p of a discovery for each encoding and length band, above 1 where there is none.

    Counts over all documents; at most one row for each encoding, band, bin
    and kind (5 x 5 x 20 x 2) comes to the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = spark.createDataFrame(reference_names(), "name string").repartition(spark.sparkContext.defaultParallelism)
    # a name is judged as a whole, whatever runs it would fall into
    known = names.select(battery(F.col("name")).alias("b")).select(F.struct("b.encoding", "b.band", "b.p", F.lit(True).alias("plain")).alias("c"))
    count = lambda rows: [[[[0] * P_BINS for _ in BANDS] for _ in ENCODINGS] for _ in range(rows)]
    reference, (own, plain) = count(1)[0], count(2)
    for r in binned(known).collect():
        reference[r.encoding][r.band][r.bin] += r.n
    for r in binned(docs.select(F.explode(candidates(text, plain=True)).alias("c"))).collect():
        (plain if r.plain else own)[r.encoding][r.band][r.bin] += r.n
    return [[lowest_threshold(own[e][b], [reference[e][b]] + [plain[e][b]] * (sum(plain[e][b]) >= LEAST_RUNS)) for b in range(len(BANDS))]
            for e in range(len(ENCODINGS))]


def tail(counts: Sequence[int], k: int) -> float:
    """Share of a reference from bin ``k`` on, never less than one string beyond it would make it."""
    return (1 + sum(counts[k:])) / (1 + sum(counts))


def lowest_threshold(counts: Sequence[int], references: Sequence[Sequence[int]]) -> float:
    """Lowest bin edge at which the ordinary strings expected to pass are within ``FALSE_SHARE`` of all that do; 2 if there is none.

    The ordinary ones among the candidates follow from the lowest bin, where
    hardly anything else is, and the references' share of it.
    """
    least = max(1 - max(tail(r, 1) for r in references), 1 / P_BINS)
    ordinary = min(sum(counts), counts[0] / least)
    for k in range(1, len(counts)):
        found = sum(counts[k:])
        if found and ordinary * max(tail(r, k) for r in references) <= FALSE_SHARE * found:
            return k / len(counts)
    return 2.0


def all_spans(text: Column, limits: list[list[float]]) -> Column:
    """Base spans and discoveries that overlap none of them, by start, then kind; of discoveries within each other the outermost."""
    limit = F.array(*(F.array(*(F.lit(x) for x in bands)) for bands in limits))

    def joined(s):
        return let(F.filter(s["found"], lambda c: (c["p"] >= limit[c["encoding"]][c["band"]]) & ~F.exists(
            s["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))), lambda found: with_base(s["base"], found))

    def with_base(base, found):
        outermost = F.filter(found, lambda c: ~F.exists(found, lambda o: (o["start"] <= c["start"]) & (c["end"] <= o["end"])
                                                        & (o["end"] - o["start"] > c["end"] - c["start"])))
        added = F.transform(outermost, lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind")))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))

    return let(F.struct(base_spans(text).alias("base"), candidates(text).alias("found")), joined)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: list[list[float]] | None = None) -> DataFrame:
    """``(doc_id, base, spans)`` for every row: arrays of (start, end, rank, kind), code points, end exclusive.

    A null text counts as empty and has no span.  Repeated rows are judged
    alike, since a span depends on its own text and the common thresholds.
    """
    limits = limits or thresholds(docs, text_col)
    out = docs.select(F.col(id_col).alias("id"), all_spans(F.coalesce(F.col(text_col), F.lit("")), limits).alias("s"))
    return out.select(F.col("id").alias(id_col), "s.base", "s.spans")


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one: array of (start, end)."""
    def add(out, s):
        last = F.try_element_at(out, F.lit(-1))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (s["start"] <= last["end"]),
                      F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(one)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), add)


def redacted(text: Column, limits: list[list[float]], mark: str = "<secret>") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``; null stays null.

    A substring is sought from the start of its text, so the text is first cut
    into stretches of a few dozen spans.
    """
    few = 64

    def cut_out(spans):
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / few).cast("int")), lambda k: F.slice(spans, k * few + 1, F.lit(few)))
        return F.when(F.size(spans) == 0, text).otherwise(F.concat(
            F.substring(text, F.lit(1), F.get(spans, F.lit(0))["start"]), let(groups, lambda g: F.array_join(F.transform(g, lambda own, i: stretch(g, own, i)), ""))))

    def stretch(groups, own, i):
        ends = F.coalesce(F.get(F.get(groups, i + 1), F.lit(0))["start"], F.length(text))
        return let(F.struct(own[0]["start"].alias("start"), ends.alias("end")), lambda b: let(
            F.substring(text, b["start"] + 1, b["end"] - b["start"]), lambda piece: F.array_join(F.transform(own, lambda s, j: F.concat(
                F.lit(mark), F.substring(piece, s["end"] - b["start"] + 1, F.coalesce(F.get(own, j + 1)["start"], b["end"]) - s["end"]))), "")))

    return F.when(text.isNotNull(), let(merged(all_spans(text, limits)["spans"]), cut_out))

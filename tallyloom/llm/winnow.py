"""Document fingerprints by winnowing, all in column functions.

A text is read as units that don't depend on what stands before them: a word
of up to ``UNIT`` characters is one, and in a longer run without white space
(scripts without blanks, encoded data) every character begins one, of up to
``RUN_UNIT`` characters.  Grams of ``GRAM`` units are hashed, each anew; of
every ``WINDOW`` neighbouring grams the least hash is kept with its place, the
rightmost of equal ones.  Two texts that share ``GRAM + WINDOW - 1`` units in a
row share a kept hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT, RUN_UNIT = 12, 8
WORD = rf"(?<!\S)\S{{1,{UNIT}}}(?!\S)"
#: The group is the unit, the whole match only what it moves on by.
UNITS = rf"(?=({WORD}|\S{{1,{RUN_UNIT}}}))(?:{WORD}|\S)"
GRAM = 3
WINDOW = 10
#: A kept gram is one long: 35 bits of hash, then how far its place is from the
#: highest place, so that the least long is the least hash, rightmost first.
PLACE_BITS = 28


def let(value: Column, of) -> Column:
    return F.transform(F.array(value), of)[0]


def prints(text: Column) -> Column:
    """Array of the kept grams of a text in order of place; empty if it has no unit."""
    top = (1 << PLACE_BITS) - 1

    def of_units(units):
        def gram(k):
            digest = F.xxhash64(*(F.get(units, k + i) for i in range(GRAM)))
            return F.shiftleft(F.shiftrightunsigned(digest, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.lit(top).cast("long") - k)

        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(units) - GRAM, F.lit(0))), gram)
        return F.when(F.size(units) == 0, F.array().cast("array<bigint>")).otherwise(let(grams, of_grams))

    def of_grams(grams):
        ends = F.sequence(F.lit(1), F.greatest(F.size(grams) - WINDOW + 1, F.lit(1)))
        return F.array_distinct(F.transform(ends, lambda k: F.array_min(F.slice(grams, k, F.lit(WINDOW)))))

    return let(F.regexp_extract_all(text, F.lit(UNITS), F.lit(1)), of_units)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda k: F.shiftright(k, PLACE_BITS)))


def places(kept: Column) -> Column:
    """Unit numbers of the kept grams."""
    top = (1 << PLACE_BITS) - 1
    return F.transform(kept, lambda k: F.lit(top).cast("long") - k.bitwiseAND(F.lit(top).cast("long")))


def written(kept: Column) -> Column:
    """``hash@place`` of the kept grams, hash and place in hexadecimal."""
    top = (1 << PLACE_BITS) - 1
    return F.array_join(F.transform(kept, lambda k: F.concat_ws(
        "@", F.hex(F.shiftright(k, PLACE_BITS)), F.hex(F.lit(top).cast("long") - k.bitwiseAND(F.lit(top).cast("long"))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two prints; 1 if neither has any."""
    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda s: let(
        F.size(F.array_intersect(s["a"], s["b"])), lambda both: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(
            both / (F.size(s["a"]) + F.size(s["b"]) - both).cast("double"))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, prints array<long>)`` for every row; a null text counts as empty.  No shuffle."""
    return docs.select(F.col(id_col), prints(F.coalesce(F.col(text_col), F.lit(""))).alias("prints"))


def below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    all_bounds = F.array(*map(F.lit, bounds))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = F.get(all_bounds, mid) < value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less, s["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows ``(bucket, copy, doc_id, tie, text)`` and the window in which the row behind each is the next document.

    Documents lie in descending order of id, null last, equal ids by text
    hash.  They are cut into buckets of ids of about equal size; the first
    rows of a bucket are also copied behind the bucket before, those of the
    first behind the last.  One bound and one id for each bucket come to the driver.
    """
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(found or ()))
    bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(len(bounds) - below(bounds, F.col("doc_id")))
    first = {r.bucket: r.first for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    at = lambda known: F.get(F.array(*(F.lit(known.get(b)).cast("long") for b in range(len(bounds) + 1))), F.col("bucket"))
    place = lambda b, copy: F.struct(b.cast("int").alias("bucket"), F.lit(copy).alias("copy"))
    own = place(F.col("bucket"), False)
    leads = F.col("doc_id").eqNullSafe(at(first))
    placed = rows.withColumn("bucket", bucket).withColumn("place", F.explode(F.when(
        leads, F.array(own, place(at(before), True))).otherwise(F.array(own)))).select("place.*", "doc_id", "tie", "text")
    return placed, Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its prints, those of its edited text and of the next document.

    ``(doc_id, n_chars long, edited string, prints, edited_prints, next_prints)``.
    The edited text has its last half replaced by as much of the start of the
    next document; a lone document is its own next one.
    """
    rows, ordered = with_next(docs, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = (
        rows.withColumn("next", F.lead("text").over(ordered))
        .withColumn("n_chars", F.length("text"))
        .select("bucket", "copy", "doc_id", "tie", "n_chars", prints(F.col("text")).alias("prints"), F.concat(
            F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"))
        .withColumn("next_prints", F.lead("prints").over(ordered))
    )
    return pairs.where(~F.col("copy")).select(
        F.col("doc_id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited", "prints",
        prints(F.col("edited")).alias("edited_prints"), "next_prints")

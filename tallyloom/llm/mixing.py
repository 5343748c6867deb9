"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are token shares raised to an exponent.  The exponent is
bisected to reach a target entropy, but stays where no source is repeated
beyond a limit.  Weights times the token budget say how many whole passes a
source gets, and how many tokens of one more.  In every pass its blocks, sets
of documents by hash, come in another order, as do the documents of a block;
a pass that is cut short ends where the order meets the budget.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.columns import named
from tallyloom.session import cut

#: Bits of the block number, and of the cells in which a cut is looked for.
BLOCK_BITS = 10
ORDER_BITS = 53
#: Sources come to the driver, one row each.  More than this is an error, not a cut.
MOST_SOURCES = 10_000

# Fixed value: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shares(tokens: Mapping, exponent: float) -> dict:
    """Normalised ``tokens ** exponent``; sources without tokens get nothing."""
    logs = {s: exponent * math.log(n) for s, n in tokens.items() if n > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    total = sum(raw.values())
    return {s: raw.get(s, 0.0) / total if total else 0.0 for s in tokens}


def entropy(weights: Mapping) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def fit_exponent(tokens: Mapping, budget: float, target_entropy: float | None = None, most_passes: float | None = None) -> float:
    """Largest exponent in 0..1 whose entropy reaches the target, raised until no source exceeds ``most_passes``.

    Entropy falls and the passes of no source rise as the exponent grows to 1
    (for budgets up to the corpus), so both are bisected.  An entropy that even
    equal weights miss gives 0, a limit that even the plain shares exceed gives 1.
    """
    def bisect(good_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good_low(mid) else (low, mid)
        return low

    def passes(exponent):
        return max((w * budget / tokens[s] for s, w in shares(tokens, exponent).items() if w > 0), default=0.0)

    out = 1.0
    if target_entropy is not None and entropy(shares(tokens, 1.0)) < target_entropy:
        out = bisect(lambda x: entropy(shares(tokens, x)) >= target_entropy)
    if most_passes is not None and passes(out) > most_passes:
        over = bisect(lambda x: passes(x) > most_passes)
        out = max(out, math.nextafter(over, 2.0)) if over < 1 - 1e-12 else 1.0
    return out


def source_key(source: Column) -> Column:
    """A null source is a source of its own, apart from the empty name."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))


def place_in_pass(digest: Column, key: Column, epoch: Column) -> Column:
    """Place of a document in a pass, a long below 2 ** ORDER_BITS: its block's place, then its own.

    Blocks are permuted by an odd factor and a shift drawn for source and pass.
    """
    n = 1 << BLOCK_BITS
    drawn = F.xxhash64(key, epoch, F.lit("blocks"))
    block = F.pmod(digest, F.lit(n))
    moved = F.pmod(block * (F.pmod(F.shiftright(drawn, 20), F.lit(n >> 1)) * 2 + 1) + F.pmod(drawn, F.lit(n)), F.lit(n))
    within = F.pmod(F.xxhash64(digest, epoch), F.lit(1 << (ORDER_BITS - BLOCK_BITS)))
    return moved * (1 << (ORDER_BITS - BLOCK_BITS)) + within


def plan_sources(rows: DataFrame, budget_share: float, target_entropy_share: float | None, most_passes: float | None) -> DataFrame:
    """``rows (key, digest, tokens)``, a written table -> ``(key, weight, passes long, cut long)``, at most ``MOST_SOURCES`` rows.

    A document is in pass e < passes, and in pass ``passes`` if its place
    there is at most ``cut``.  The cut is found by counts: tokens by cell of
    the upper bits of the place, the cell where the budget ends, the cells
    within it, and last the documents of one of 2 ** 20 cells.
    """
    spark = rows.sparkSession
    totals = {r.key: r.n for r in rows.groupBy("key").agg(F.sum("tokens").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    budget = budget_share * sum(totals.values())
    most = math.log(max(1, sum(n > 0 for n in totals.values())))
    target = None if target_entropy_share is None else target_entropy_share * most
    weights = shares(totals, fit_exponent(totals, budget, target, most_passes))
    plan = []
    for key, n in totals.items():
        own = int(weights[key] * budget + 1e-6)
        # without tokens a source costs nothing and is passed once
        plan.append((key, weights[key], own // n if n else 1, own % n if n else 0))
    sources = spark.createDataFrame(plan, "key string, weight double, passes long, rest long")
    placed = rows.where("tokens > 0").join(F.broadcast(sources.where("rest > 0")), "key") \
        .select("key", "tokens", "rest", place_in_pass(F.col("digest"), F.col("key"), F.col("passes")).alias("place"))
    at, shift = placed, ORDER_BITS
    for _ in range(2):
        shift -= BLOCK_BITS
        cells = at.groupBy("key", F.shiftright("place", shift).alias("cell")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
        ends = F.sum("tokens").over(Window.partitionBy("key").orderBy("cell"))
        # the first cell that does not fit as a whole
        last = cells.withColumn("ends", ends).where("ends > rest").groupBy("key").agg(
            F.min_by(F.struct("cell", (F.col("rest") - F.col("ends") + F.col("tokens")).alias("left")), "cell").alias("c")) \
            .select("key", "c.cell", F.col("c.left").alias("left"))
        last = cut(last)
        at = at.withColumn("cell", F.shiftright("place", shift)).join(F.broadcast(last), ["key", "cell"]).select("key", "tokens", "place", F.col("left").alias("rest"))
    same_place = at.groupBy("key", "place").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    ends = F.sum("tokens").over(Window.partitionBy("key").orderBy("place"))
    fits = same_place.withColumn("ends", ends).groupBy("key").agg(F.max(F.when(F.col("ends") <= F.col("rest"), F.col("place"))).alias("fit"))
    cuts = last.join(fits, "key", "left").select("key", F.coalesce("fit", F.shiftleft("cell", shift) - 1).alias("cut"))
    return sources.join(cuts, "key", "left").select("key", "weight", "passes", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"))


def mix(docs: DataFrame, budget_share: float = 1.0, target_entropy_share: float | None = 0.98, most_passes: float | None = 4.0,
        source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (struct ``row``) as often as the mixture says, with ``source_key, weight, tokens, epoch long, block int, place double``.

    ``place`` in 0..1 is the row's place among those of its source; sorted by
    it all sources run side by side at their weights.  Tokens are words.
    Repeated rows share their place, so they are in or out together; a null
    text has no tokens.  An empty table gives no row.
    """
    key = source_key(F.col(source_col))
    digest = F.xxhash64(F.col(id_col), F.col(text_col))
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    counted = cut(docs.select(key.alias("key"), digest.alias("digest"), tokens.alias("tokens")))
    plan = plan_sources(counted, budget_share, target_entropy_share, most_passes)
    # collected so that the broadcast is of known size: one row for each source
    known = docs.sparkSession.createDataFrame([tuple(r) for r in plan.collect()], "key string, weight double, passes long, `cut` long")
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), key.alias("source_key"), digest.alias("digest"), tokens.alias("tokens"))
    last = place_in_pass(F.col("digest"), F.col("source_key"), F.col("passes")) <= F.col("cut")
    epochs = rows.join(F.broadcast(known.withColumnRenamed("key", "source_key")), "source_key").withColumn(
        "n", F.col("passes") + F.when((F.col("tokens") > 0) & last, 1).otherwise(0)).where("n > 0") \
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = place_in_pass(F.col("digest"), F.col("source_key"), F.col("epoch"))
    span = F.col("passes") + (F.col("cut") + 1) / float(1 << ORDER_BITS)
    return epochs.select("row", "source_key", "weight", "tokens", "epoch", F.pmod("digest", F.lit(1 << BLOCK_BITS)).cast("int").alias("block"),
                         ((F.col("epoch") + place / float(1 << ORDER_BITS)) / span).alias("place"))

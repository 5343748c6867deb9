import math
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import mixing


def test_exponent():
    tokens = {"a": 900, "b": 90, "c": 10}
    x = mixing.fit_exponent(tokens, 1000, target_entropy=0.8)
    assert 0 < x < 1 and math.isclose(mixing.entropy(mixing.shares(tokens, x)), 0.8, abs_tol=1e-6)
    y = mixing.fit_exponent(tokens, 1000, target_entropy=1.09, most_passes=4)
    w = mixing.shares(tokens, y)
    assert max(w[s] * 1000 / tokens[s] for s in tokens) <= 4 + 1e-6 and y > x * 0.5
    assert mixing.fit_exponent(tokens, 1000) == 1 and mixing.fit_exponent({}, 0, 1.0, 2.0) in (0.0, 1.0)
    assert math.isclose(sum(mixing.shares(tokens | {"none": 0}, 0.3).values()), 1)


def brute(spark, docs, **how):
    """The same order walked row by row."""
    counted = docs.select("doc_id", "text", mixing.source_key(F.col("source")).alias("key"), F.xxhash64("doc_id", "text").alias("digest")).collect()
    tokens = [len((r.text or "").encode().split()) for r in counted]
    totals = Counter()
    for r, n in zip(counted, tokens):
        totals[r.key] += n
    budget = how["budget_share"] * sum(totals.values())
    most = math.log(sum(n > 0 for n in totals.values()))
    weights = mixing.shares(totals, mixing.fit_exponent(totals, budget, how["target_entropy_share"] * most, how["most_passes"]))
    out = Counter()
    for key, n in totals.items():
        own = [(i, r) for i, r in enumerate(counted) if r.key == key]
        part = int(weights[key] * budget + 1e-6)
        passes, rest = divmod(part, n) if n else (1, 0)
        for i, r in own:
            out[key, r.doc_id] += passes
        places = spark.createDataFrame([(i, r.digest) for i, r in own], "i int, digest long").select(
            "i", mixing.place_in_pass(F.col("digest"), F.lit(key), F.lit(passes).cast("long")).alias("p")).collect()
        by_place = {}
        for i, p in places:
            if tokens[i]:
                by_place.setdefault(p, []).append(i)
        for p in sorted(by_place):
            rest -= sum(tokens[i] for i in by_place[p])
            if rest < 0:
                break
            for i in by_place[p]:
                out[key, counted[i].doc_id] += 1
    return +out


def test_mixture_matches_a_walk(spark, odd_docs, no_docs):
    for how in ({"budget_share": 1.0, "target_entropy_share": 0.98, "most_passes": 4.0}, {"budget_share": 0.4, "target_entropy_share": 1.0, "most_passes": 2.0}):
        rows = mixing.mix(odd_docs, **how).collect()
        assert Counter((r.source_key, r.row.doc_id) for r in rows) == brute(spark, odd_docs, **how)
        assert all(0 <= r.place <= 1 for r in rows)
    assert rows[0].row.asDict().keys() == set(odd_docs.columns)
    assert mixing.mix(no_docs).count() == 0

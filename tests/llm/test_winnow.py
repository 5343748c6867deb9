import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import winnow


def units_of(text):
    out = []
    for run in re.finditer(r"\S+", text or "", re.ASCII):
        out += [run[0]] if len(run[0]) <= 12 else [run[0][k:k + 8] for k in range(len(run[0]))]
    return out


def brute_prints(text):
    """(hash, place) of the least hash of each window, the rightmost of equal ones; hashes chained as Spark does for several columns."""
    units = units_of(text)
    grams = []
    for k in range(max(1, len(units) - 2) if units else 0):
        h = 42
        for u in units[k:k + 3]:
            h = xxhash.xxh64_intdigest(u.encode(), h)
        grams.append(h >> 29)
    out = []
    for k in range(max(1, len(grams) - 9) if grams else 0):
        window = [(h, -p) for p, h in enumerate(grams)][k:k + 10]
        h, p = min(window)
        if (h, -p) not in out:
            out.append((h, -p))
    return out


def test_pairs_match_brute_force(spark, odd_docs, odd_rows, no_docs):
    docs = odd_docs.where("length(text) < 20000 OR text IS NULL")
    rows = [(r[0], r[1] or "") for r in odd_rows if len(r[1] or "") < 20_000]
    tie = {t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] for _, t in rows}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        own, changed, after = (brute_prints(x) for x in (t, edited, nxt))
        want.append((i, len(t), edited, own, changed, after))
    top = (1 << winnow.PLACE_BITS) - 1
    plain = lambda ps: [(p >> winnow.PLACE_BITS, top - (p & top)) for p in ps]
    got = [(r.doc_id, r.n_chars, r.edited, plain(r.prints), plain(r.edited_prints), plain(r.next_prints)) for r in winnow.edited_pairs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert winnow.edited_pairs(no_docs).count() == 0


def test_shared_runs_share_a_print(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(200)]
    shared = " ".join(words[:winnow.GRAM + winnow.WINDOW - 1])
    texts = [" ".join(words[50:50 + n]) + " " + shared + " " + " ".join(words[100 + n:130 + n]) for n in range(0, 40, 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = [set(r[0]) for r in winnow.fingerprints(df).select(winnow.hashes(F.col("prints"))).collect()]
    assert set.intersection(*kept)


def test_moved_text_without_blanks(spark):
    """A run without white space shares its prints with itself wherever it begins."""
    rng = random.Random(4)
    run = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(2000))
    moved = [run, *(run[:k] + run for k in (1, 5, 11)), "x" + run, run[:900] + "y" + run[900:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(moved)], "doc_id long, text string")
    kept = {r.doc_id: set(r.h) for r in winnow.fingerprints(df).select("doc_id", winnow.hashes(F.col("prints")).alias("h")).collect()}
    for i in range(1, len(moved)):
        assert len(kept[0] & kept[i]) >= 0.9 * len(kept[0]), i


def test_likeness(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("", ""), ("", "a"), ("one two three", "four five six")], "x string, y string")
    got = [r[0] for r in df.select(winnow.likeness(winnow.prints(F.col("x")), winnow.prints(F.col("y")))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.0]

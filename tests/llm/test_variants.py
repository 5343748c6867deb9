import random
import re
import zlib
from collections import Counter

import numpy as np

from tallyloom.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(rows, least_length=7, least_n=2, ratio=10, one_in=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % one_in == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_n}
    partners = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(p, key=lambda v: (-n[v], v)) for w, p in partners.items() if p}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(partners[w]), n[form[w]] if w in form else None) for w in n)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_odd_documents(odd_docs, odd_rows, no_docs):
    assert found(variants.spelling_variants(odd_docs)) == brute([(r[0], r[1]) for r in odd_rows])
    assert variants.spelling_variants(no_docs).count() == 0


def noisy_rows(n, letters, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(6, 12))) for _ in range(40)]
    rows = []
    for i in range(n):
        line = []
        for _ in range(60):
            w = words[min(int(rng.expovariate(0.2)), len(words) - 1)]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w) + 1)
                w = rng.choice((w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:]))
            line.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, " ".join(line) + rng.choice((".", "9", "-", ""))))
    return rows


def test_every_kind_of_edit(spark):
    for letters in ("ab", "abcdeÀéÿ×"):
        rows = noisy_rows(40, letters, len(letters))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(variants.spelling_variants(df)) == brute(rows)
        assert found(variants.spelling_variants(df, least_length=1, least_n=1, ratio=2, drop_one_in=3)) == brute(rows, 1, 1, 2, 3)


def test_a_half_that_fills_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 16)
    monkeypatch.setattr(variants, "STEP", 5)
    rows = noisy_rows(60, "abc", 9)
    rows.append((1000, " ".join("common" + "".join(random.Random(k).choices("ab", k=4)) for k in range(300)) * 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # workers read the module anew, so blocks are also cut small by the rows dealt
    assert found(variants.spelling_variants(df)) == brute(rows)


def test_bit_sets_against_plain_edits():
    rng = random.Random(3)
    for m in (1, 2, 5, 7):
        words = sorted({"".join(rng.choices("abc", k=m + rng.randint(0, 1))) for _ in range(150)})
        halves = np.array([w[:m // 2] for w in words])
        i, j = variants.one_edit_apart(words, m, np.unique(halves, return_inverse=True)[1], np.zeros(len(words), bool))
        want = {tuple(sorted((a, b))) for a in words for b in words if near(a, b) and min(len(a), len(b)) == m and a[:m // 2] == b[:m // 2]}
        got = [tuple(sorted((words[a], words[b]))) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}" if k < 11 else None) for k in range(12)] + [("alone", None)]
    got = {r.word: r.root for r in variants.with_roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k}": "w11" for k in range(12)} | {"alone": "alone"}

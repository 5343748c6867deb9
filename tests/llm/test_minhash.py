import random
import re

import numpy as np
import pytest

from tallyloom.llm import minhash, skew

WORDS = "the river carries small boats past quiet stone houses where people trade grain wool salt and old stories".split()


def brute_sets(rows, size):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[k:k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    return out


def brute(rows, size, percent):
    sets = brute_sets(rows, size)
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    known = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[k][0], len(sets[k]), known[root[k]], rows[k][0] == known[root[k]]) for k in range(len(rows))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def varied(text, n, rng):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def chosen(seed, n=150):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(n))


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    for size, percent in ((3, 85), (5, 80)):
        assert found(minhash.near_duplicates(odd_docs, size, percent)) == brute(rows, size, percent)
    assert minhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("share", [1 / 1024, 0.01])
def test_groups_at_the_threshold(spark, monkeypatch, share):
    """Groups whose members are just alike enough to their base, that base anywhere among the ids, and chains."""
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    rng = random.Random(2)
    texts = []
    for seed in range(6):
        base = chosen(seed)
        texts += [base, *(varied(base, n, rng) for n in (1, 2, 2, 3, 4, 5)), base.upper()]
    for seed in range(20, 23):
        chain = [chosen(seed)]
        for _ in range(8):
            chain.append(varied(chain[-1], 3, rng))
        texts += chain
    shared = chosen(90, 200)
    texts += [chosen(100 + k, 30) + " " + shared for k in range(40)] + [f"{chosen(200 + k, 5)} {shared}" for k in range(20)]
    rng.shuffle(texts)
    rows = [(7 * k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)


def test_one_large_group_in_small_blocks(spark, monkeypatch):
    """Members of a list that its first document isn't alike to are found in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = chosen(1, 200)
    twigs = [varied(base, 6, rng) for _ in range(60)]  # about 0.82 like the base, less like each other
    rows = [(k, t) for k, t in enumerate([*twigs[:30], base, *twigs[30:], *(varied(twigs[0], 1, rng) for _ in range(10))])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert found(minhash.near_duplicates(df, 3, percent)) == brute(rows, 3, percent)


def test_collisions_skip_nothing():
    rng = np.random.default_rng(4)
    for matches in (1, 3, 6, 9):
        lists = [np.unique(rng.integers(0, 60, int(n))) for n in (0, 3, 50, 10, 40, 40, 7, 60, 25)]
        want = [v for v in range(60) if sum(v in x for x in lists) >= matches]
        got, counts = minhash.collisions(lists, matches)
        assert got.tolist() == want and counts.tolist() == [sum(v in x for x in lists) for v in want]


def test_signature_agreement_follows_similarity():
    numbered = [f"w{k}" for k in range(3000)]
    a, b = (minhash.coordinate_values(minhash.shingle_set(" ".join(x), 1)) for x in (numbered, numbered[:2700] + ["x"] * 1))
    assert abs((a == b).mean() - 0.9) < 0.15

import numpy as np
import xxhash

from tallyloom.llm import simhash


def brute_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget):
    left, root = list(range(len(rows))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= budget]
            left = [j for j in left if j not in near]
            todo += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        root |= {i: min(ids, default=None) for i in group}
    return [root[i] for i in range(len(rows))]


def test_pairs_within_finds_every_pair():
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    a = np.unique(np.concatenate([centers, *(centers ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(20)), rng.integers(0, 64, 20, dtype=np.uint64)]))
    b = np.unique(a[::3] ^ np.uint64(4))
    for budget in (0, 2, 3):
        for x, y in ((a, a), (a, b)):
            got = set(zip(*(v.tolist() for v in simhash.pairs_within(x, y, budget))))
            want = {(i, j) for i in range(len(x)) for j in range(len(y)) if (x is not y or i < j) and int(x[i] ^ y[j]).bit_count() <= budget}
            assert got == want
    assert len(simhash.pairs_within(a[:0], a[:0], 2)[0]) == 0


def test_components_over_small_subtrees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", 4)
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)] + [0, 1, 2, 3, (1 << 64) - 1, (1 << 64) - 4]
    for p in prints[:20]:
        prints += [p ^ (1 << int(rng.integers(0, 64))), p ^ 3 << int(rng.integers(0, 62))]
    rows = [(i, p) for i, p in enumerate(prints + prints[:7])]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "id long, fingerprint long")
    got = {r.id: r.component_id for r in simhash.with_components(df, 2).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows, 2)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs, 3, 2).collect()), key=repr)
    prints = [(r[0], brute_fingerprint(r[1], 3)) for r in odd_rows]
    want = [(i, p - (1 << 64) if p >> 63 else p, c) for (i, p), c in zip(prints, brute_components(prints, 2))]
    assert got == sorted(want, key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('the old river')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest("the old river", 42)


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} or ({b" ".join(words)} if words else set())


def test_keep_one(spark, odd_docs, odd_rows, no_docs):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [list(rng.choice(vocabulary, 150)) for _ in range(30)]
    rows = []
    for k, base in enumerate(bases):
        for copy in range(k % 4 + 1):
            words = list(base)
            for at in rng.choice(150, copy, replace=False):
                words[at] = "changed"
            rows.append((1000 + len(rows), " ".join(words), k))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [min(i for i, _, k in rows if k == base) for base in range(len(bases))]
    odd = simhash.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns and odd.schema["kept"].dataType == odd_docs.schema["kept"].dataType
    got, texts = sorted((r.doc_id for r in odd.collect()), key=repr), {r[0]: r[1] for r in odd_rows}
    groups = []
    for i, t in sorted(texts.items(), key=lambda x: (x[0] is None, x[0])):
        s = shingles(t)
        if not any((not s and not g) or (s | g and len(s & g) >= 0.8 * len(s | g)) for _, g in groups):
            groups.append((i, s))
    assert got == sorted((i for i, _ in groups), key=repr)
    assert simhash.keep_one(no_docs).count() == 0


def brute_kept(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    left, kept = list(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
            left = [j for j in left if j not in near]
            todo += near
        kept.append(min(rows[i][0] for i in group))
    return sorted(kept)


def edited_copies(rng, base, n):
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(len(base), 4, replace=False):
            words[at] = f"new{rng.integers(1 << 40)}"
        out.append(" ".join(words))
    return out


def test_keep_one_joins_a_group_whose_centre_has_any_id(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows, expected = [], []
    for place in (0, 15, 30):  # of the text itself, among 30 copies that are like it but not like each other
        base = [f"w{i}" for i in rng.integers(0, 1 << 40, 200)]
        texts = edited_copies(rng, base, 30)
        texts.insert(place, " ".join(base))
        expected.append(len(rows))
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    assert brute_kept(rows) == expected
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == expected
    for block, most in ((4, 1 << 20), (1024, 1000)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", most)
        assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == expected


def test_blocks_of_a_band_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = np.random.default_rng(13)
    sets = []
    for k in range(12):  # groups of sets, one of them in one large component, the others apart until they meet
        core = rng.integers(-1 << 31, 1 << 31, 40)
        sets += [np.unique(np.concatenate([core, rng.integers(-1 << 31, 1 << 31, m)])).astype(np.int32) for m in (0, 3, 8)]
    roots = [(i, min(i, 10)) for i in range(10, 20)]
    met = spark.createDataFrame([(b, i, len(s), i) for i, s in enumerate(sets) for b in (1, 2)], "band long, row long, size int, fingerprint long")
    found = simhash.block_links(met, spark.createDataFrame([(f, 10) for f, _ in roots], "fingerprint long, root long"),
                                spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "row long, shingles array<int>"), 0.8).collect()
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    classes = lambda links: simhash.forest(len(sets), *np.array(links + [(f, 10) for f, _ in roots]).T).tolist()
    assert near and classes([(r.a, r.b) for r in found]) == classes(near)
    assert all((max(r), min(r)) in near for r in found)

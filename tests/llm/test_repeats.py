import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import repeats


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i:i + span]] > 1:
                gone[i:i + span] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_sorts():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 3, 200):
        for n in (1, 2, 50, 700):
            text = np.concatenate([rng.integers(1, letters + 1, n), [0]])
            got = repeats.suffix_array(text, len(text)).tolist()
            assert got == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_repeated_starts():
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(0, 4, 900, dtype=np.uint8))
    slices = [base[:500], base[100:700] + b"x", b"\0" * 450, base[650:900], b"ab" * 300, base[:199], b""]
    flags = repeats.repeated_starts(slices, 200)
    seen = Counter(s[i:i + 200] for s in slices for i in range(len(s) - 199))
    for s, f in zip(slices, flags):
        assert f.tolist() == [seen[s[i:i + 200]] > 1 for i in range(len(s) - 199)]


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_documents_match_brute_force(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    small = [r for r in odd_rows if len(r[1] or "") < 20_000]
    docs = odd_docs.where("length(text) < 20000 OR text IS NULL")
    want = sorted(((r[0], *b) for r, b in zip(small, brute([r[1] for r in small], 200))), key=repr)
    assert rows_of(repeats.repeat_digests(docs)) == want
    assert repeats.repeat_digests(no_docs).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_passages_between_documents(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_KINDS", most)
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    texts = []
    for i in range(60):
        body = text(int(rng.integers(20, 120)))
        at = int(rng.integers(0, len(body)))
        mid = passage if i % 3 == 0 else (other[i % 7:] if i % 3 == 1 else "")
        texts.append(body[:at] + mid + body[at:])
    texts += [passage[:200], passage[-199:], passage[10:205], texts[5] + "!", "é" * 150 + passage]
    texts += [text(at) + word()[:period].ljust(period, "-") * (230 // period) + text(at) for at in (5, 20, 37, 60) for period in (3, 8, 9, 11)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(repeats.repeat_digests(docs)) == sorted(((i, *b) for i, b in enumerate(brute(texts, 200))), key=repr)
    kept = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert all(len(r.kept) + sum(x["to"] - x["from"] for x in r.removed) == r.n_bytes for r in kept.values())


def test_spans_longer_than_a_byte_counts(spark):
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = letters(2000)
    texts = [letters(300) + shared + letters(100), shared + letters(700), letters(50) + shared, letters(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for span in (500, 288):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_digests(df, span=span).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, span)

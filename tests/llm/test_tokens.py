"""Token files and packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import codec, packing
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.tokens import word_ids


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_give_the_tokenizers_ids(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + [
        "it's I'LL don't'S a'tb x''re", "<|endoftext|> a<|startoftext|>b <|", "tab\tand\x0bvertical\x1cother space\u0085next", "é É ª µ × ÷ ß ẞ İ ſ ﬁ",
        "3d 12,345.67 a1b2", "__init__ [x](y) C++/C# a...b", "́start", "ΑΣ ΟΔΟΣ", "a" * 300, "!" * 300 + "a"]
    words = word_ids(tokenizer_path())
    assert words.plain
    assert [np.frombuffer(words.encode(t), "<u2").tolist() for t in texts] == whole_ids(texts)


def test_code_lengths_are_optimal_and_limited():
    counts = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    free = codec.code_lengths(counts, 20)
    assert sorted(free.tolist()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9] and sum(2.0 ** -b for b in free) == 1
    short = codec.code_lengths(counts, 4)
    assert short.max() == 4 and sum(2.0 ** -b for b in short) <= 1
    assert codec.code_lengths([7]).tolist() == [1] and len(codec.code_lengths([])) == 0
    with pytest.raises(ValueError):
        codec.code_lengths([1] * 20, 4)


def test_blocks_round_trip(monkeypatch):
    monkeypatch.setattr(codec, "STEP", 7)
    rng = np.random.default_rng(3)
    for ids in (np.zeros(1, np.int64), np.zeros(50, np.int64), rng.zipf(1.4, 3000) % 500, np.arange(300)):
        tokens, counts = np.unique(ids, return_counts=True)
        book = codec.Codebook(tokens, codec.code_lengths(counts))
        blocks = [book.block(ids[i:i + 100]) for i in range(0, len(ids), 100)]
        assert np.array_equal(codec.decode_blocks(blocks, book.table()), ids)
        assert np.array_equal(codec.decode_blocks(blocks[-1:], book.table()), ids[(len(blocks) - 1) * 100:])


def test_token_file_round_trip(spark, odd_docs, odd_rows, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(codec, "BLOCK", 500)
    codec.write_tokens(odd_docs, f"{tmp_path}/t", tokenizer_path(), end_id=2)
    got = codec.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    ids = [i + [2] for i in whole_ids([r[1] for r in odd_rows])]
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i))
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((r[0], i) for r, i in zip(odd_rows, ids)), key=repr)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    digests = {(r.start, r.ids_crc32) for r in codec.token_digests(spark, f"{tmp_path}/t").collect()}
    assert digests == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    codec.write_tokens(no_docs, f"{tmp_path}/e", tokenizer_path(), end_id=2)
    assert codec.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_plan_fills_bins():
    assert packing.plan_bins({6: 2, 4: 2}, 10) == [(2, {6: 1, 4: 1})]
    rng = np.random.default_rng(8)
    for n, high in ((40, 10), (500, 100), (3000, 100)):
        counts = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, high + 1, n), return_counts=True))))
        plan = packing.plan_bins(counts, 100)
        used = defaultdict(int)
        for times, one in plan:
            assert sum(s * k for s, k in one.items()) <= 100
            for s, k in one.items():
                used[s] += times * k
        assert dict(used) == counts
        bound = -(-sum(s * k for s, k in counts.items()) // 100)
        assert sum(t for t, _ in plan) <= 1.03 * bound + 1
    assert packing.plan_bins({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, 10)


def test_packed_documents(spark, odd_docs, odd_rows, no_docs):
    rows = packing.pack(packing.document_pieces(odd_docs, tokenizer_path(), 0, 256), 256).collect()
    want = []
    for r, ids in zip(odd_rows, whole_ids([r[1] for r in odd_rows])):
        ids = ids + [0]
        want += [(r[0], k, a, ids[a:a + 256]) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in rows), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(places) == list(range(len(places))) and len(places) <= -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack(packing.document_pieces(no_docs, tokenizer_path(), 0)).count() == 0

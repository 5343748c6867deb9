import hashlib
import random
import zlib
from collections import Counter, defaultdict

from tallyloom.llm import skew, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - (c - int(c / 100) * 100), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
                   for k, m in members.items()), key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def talks(n, seed, vocabulary=3, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c * rng.choice((1, 1, 7)), None if rng.random() < 0.02 else 1000 * c + t, rng.choice(("user", "assistant", None)) if rng.random() < 0.1 else "user",
                         rng.choice((None, "")) if rng.random() < 0.05 else f"text {rng.randrange(vocabulary)} é😀", "clash", 1))
    # a turn number belongs to one row of a conversation, so that the order of its turns is given
    seen, out = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    rng.shuffle(out)
    return out


def test_odd_conversations(spark):
    rows = talks(250, 1)
    rows += [(-5, 0, "user", "negative", None, None), (-205, 1, None, None, None, None), (None, 0, "user", "no conversation", None, None)]
    rows += [(c, t, "user", "hot first turn" if t == 0 else "x" * 3000, None, None) for c in range(5000, 5040) for t in range(4)]
    rows += [(9107, t, "user", "own turns are fewer than those shared", None, None) for t in range(1)]
    assert found(spark, rows) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_few_shards_and_many(spark, monkeypatch):
    rows = talks(400, 2, vocabulary=2)
    want = brute(rows)
    for share in (0.5, 0.02, 1 / 1024):
        monkeypatch.setattr(trie, "UPPER_SHARE", share)
        monkeypatch.setattr(skew, "HOT_SHARE", share / 8)
        assert found(spark, rows) == want


def test_a_long_conversation_over_slices(spread):
    rows = [(c, t, "user", f"turn {t}" if c < 3 or t < 200 else f"other {c}", "", 0) for c in (0, 1, 2, 5) for t in range(300)]
    assert found(spread, rows) == brute(rows)


def test_the_queue_spills_and_keeps_its_order():
    rng = random.Random(8)
    queue, plain = trie.SpillingQueue(limit=50), []
    for _ in range(5000):
        if plain and rng.random() < 0.4:
            plain.sort()
            assert queue.first() == plain[0] and queue.pop() == plain.pop(0)
        else:
            item = (rng.randrange(100), rng.randrange(-5, 5), rng.randrange(3), 1, 2)
            queue.push(item)
            plain.append(item)
    assert queue.runs
    assert [queue.pop() for _ in range(len(plain))] == sorted(plain) and queue.first() is None

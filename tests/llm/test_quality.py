import random

from tallyloom.llm import quality


def brute(text):
    data = (text or "").encode()
    words = data.split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_counts_match_brute_force(odd_docs, odd_rows, no_docs):
    got = sorted((tuple(r) for r in quality.quality(odd_docs).collect()), key=repr)
    want = {repr(r[0]): brute(r[1]) for r in odd_rows if len(r[1] or "") < 100_000}
    seen = 0
    for doc_id, *rest in got:
        if repr(doc_id) in want:
            assert tuple(rest[:6]) == want[repr(doc_id)]
            seen += 1
    assert seen >= len(want)
    assert quality.quality(no_docs).count() == 0


def test_bands_reject_repetition_and_noise():
    rng = random.Random(2)
    syllables = "an er on th re he in ed nd ha at en es or ti st ea ou is it".split()
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(4000))
    noise = "".join(map(chr, rng.choices([*range(0x21, 0x7F), *range(0xA1, 0x1000)], k=6000)))
    assert all(quality.report(prose[:n])[-1] for n in (100, 300, 700, 2000, 5000, 20_000))
    repeated = " ".join(f"Item number {i} is on sale today only." for i in range(400))
    assert not quality.report(repeated)[-1] and not quality.report(" ".join(noise[i:i + 9] for i in range(0, 6000, 9)))[-1]
    assert not quality.report(prose[:6000] + repeated)[-1]


def random_words(rng, alphabet, size):
    out = ""
    while len(out.encode()) < size:
        out += "".join(rng.choices(alphabet, k=rng.randint(3, 9))) + " "
    return out


def test_noise_of_every_alphabet_by_length():
    """From the length on from which an alphabet compresses less than prose, its words are rejected."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base64 = letters + letters.upper() + "0123456789+/"
    printable = "".join(map(chr, range(33, 127)))
    for alphabet, sizes in ((printable, (150, 300, 700, 1000, 2000)), (base64, (200, 300, 700, 1000, 2000)), (letters, (1100, 1400, 1700, 2000, 2500)), ("0123456789abcdef", ())):
        for size in (*sizes, 4500, 9000, 20_000, 70_000, 300_000):
            assert not quality.report(random_words(rng, alphabet, size))[-1], (alphabet[:4], size)
    assert not quality.report(random_words(rng, "0123456789", 70_000))[-1]


def test_scripts_of_several_bytes_are_kept():
    rng = random.Random(9)
    words = ["".join(chr(0x4E00 + min(int(rng.expovariate(0.01)), 3000)) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    for n in (100, 400, 2000):
        text = " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(n))
        assert quality.report(text)[-1], n

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1.  An n-gram binds its letters: their
vectors, rolled by their distance from its end, are multiplied.  A document is
the sum of its n-grams, a language the sum of its documents' unit vectors, and
a document has the language whose profile has the largest cosine with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
GRAM = 3
SEED = 20
#: Letters share 256 vectors: Latin-1 ones have their own, others one by code point.
LETTERS = 256
#: Letters that are bundled at a time; a longer text is read in parts.
PART = 1 << 17
#: Languages come to the driver, one profile each.  More than this is an error, not a cut.
MOST_LANGUAGES = 1000


@functools.cache
def letter_classes() -> np.ndarray:
    """Code point -> class of its letter, 0 if it is none."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(len(out)):
        if chr(cp).isalpha():
            out[cp] = cp if cp < LETTERS else 1 + cp * 2654435761 % (1 << 32) % (LETTERS - 1)
    return out


@functools.cache
def letter_vectors() -> tuple[np.ndarray, ...]:
    """Vectors of the classes, rolled by 0, 1, 2, ...; class 0 is the gap between words."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIM))
    return tuple(np.roll(base, k, axis=1) for k in range(GRAM))


def grams(text: str) -> np.ndarray:
    """Numbers of the n-grams of a text: letters in lower case, one gap for everything between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letters = letter_classes()[points].astype(np.int64)
    letters = np.concatenate([[0], letters, [0]])
    letters = letters[(letters > 0) | np.concatenate([[True], letters[:-1] > 0])]
    if len(letters) < GRAM:
        return np.zeros(0, np.int64)
    n = len(letters) - GRAM + 1
    out = np.zeros(n, np.int64)
    for k in range(GRAM):
        out = out * LETTERS + letters[k:k + n]
    return out


def bundles(texts: list[str | None]) -> np.ndarray:
    """Sum of the bound n-grams of each text; the zero vector if it has no letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    held, owners, size = [], [], 0

    def add():
        of, all_grams = np.repeat(owners, [len(g) for g in held]), np.concatenate(held)
        found, number = np.unique(all_grams, return_inverse=True)
        rows = np.unique(owners)
        counts = np.bincount(np.searchsorted(rows, of) * len(found) + number, minlength=len(rows) * len(found)).reshape(len(rows), len(found))
        vectors, rest = np.ones((len(found), DIM), np.int8), found
        for k in range(GRAM):
            vectors *= letter_vectors()[k][rest % LETTERS]
            rest = rest // LETTERS
        out[rows] += counts.astype(np.float32) @ vectors.astype(np.float32)

    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PART):
            own = grams(text[at:at + PART + GRAM - 1])
            if len(own):
                held.append(own)
                owners.append(i)
                size += len(own)
            if size > PART:
                add()
                held, owners, size = [], [], 0
    if held:
        add()
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, np.ndarray]]:
    """(language, unit vector) from all rows of ``docs`` with a language, sorted by language.

    Each task adds up its own documents and sends one vector for each
    language; they are summed by (language, dimension).
    """

    def learn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs = part.column(0).to_pylist()
                vectors = units(bundles(part.column(1).to_pylist()))
                for lang in set(langs):
                    own = vectors[[x == lang for x in langs]].sum(0, dtype=np.float64)
                    sums[lang] = sums[lang] + own if lang in sums else own
        yield pa.RecordBatch.from_pydict({"lang": pa.array(sums, pa.string()), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(learn, "lang string, sums array<double>")
    # whole multiples of 2 ** -20 add up alike in any order
    whole = F.round(F.col("value") * (1 << 20)).cast("decimal(38,0)")
    sums = rows.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum(whole).cast("double").alias("value"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return sorted((r.lang, units(np.array([[x.value for x in r.v]]))[0]) for r in found)


def identify(docs: DataFrame, known: list[tuple[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row: nearest profile and its cosine, 0 at least.

    Ties go to the first language by name.  A null text, one without a letter
    and any text while no profile is known is ``und`` with score 0.
    """
    names = [name for name, _ in known]
    matrix = np.array([v for _, v in known], np.float32).reshape(len(known), DIM)

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = units(bundles(part.column(1).to_pylist()))
                some = np.any(vectors != 0, axis=1)
                cosine = vectors @ matrix.T if len(known) else np.zeros((len(vectors), 1), np.float32)
                best = cosine.argmax(1)
                langs = [names[b] if s and names else "und" for b, s in zip(best, some)]
                scores = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64) * some
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)) \
        .mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n

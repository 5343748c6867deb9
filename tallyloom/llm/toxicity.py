"""Toxicity: subword bags averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its hashed character n-grams and of
itself, a bag the average of a few words in a row.  A document is as toxic as
its worst bag, so that a few words count in a long text.  Misspelled words
share most n-grams with those that were seen.

The model is fitted on a bounded sample of labelled rows on the driver; it
comes down to one number for each hash bucket, with which every task scores
whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of each label in the sample at most, those of least id hash, and
#: the longest text in it.  They bound the driver's memory; scoring has no bound.
SAMPLE_EACH = 4000
SAMPLE_CHARS = 20_000
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Features of the sample in fewer documents than this say nothing of others and are left out.
LEAST_DOCS = 4
GRAMS = (3, 4, 5)
BAG = 8
WORD_MEMORY = 300_000
WORD = re.compile(r"[^\W\d_]+")


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash buckets of all words one after the other, how many each word has).

    Features are the word itself and the n-grams of its UTF-8 bytes, with a
    mark at both ends.  A gram is a number of up to five bytes; it and its
    length are mixed by one multiplication.
    """
    marked = [b"<%b>" % w.encode() for w in words]
    sizes = np.array([len(m) for m in marked])
    data = np.concatenate([np.frombuffer(b"".join(marked), np.uint8), np.zeros(GRAMS[-1], np.uint8)]).astype(np.uint64)
    n = len(data) - GRAMS[-1]
    first = np.cumsum(sizes) - sizes
    rest = np.repeat(first + sizes, sizes) - np.arange(n)  # bytes from here to the end of the word
    out, used = np.zeros((n, len(GRAMS) + 1), np.uint64), np.zeros((n, len(GRAMS) + 1), bool)
    value = np.zeros(n, np.uint64)
    for k in range(GRAMS[-1]):
        value = value << np.uint64(8) | data[k:k + n]
        if k + 1 in GRAMS:
            column = GRAMS.index(k + 1)
            out[:, column], used[:, column] = value | np.uint64((k + 1) << 56), rest > k
    # the word as a whole: its bytes weighed by their place
    place = (np.arange(n) - np.repeat(first, sizes)).astype(np.uint64)
    weight = (place * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
    out[first, -1], used[first, -1] = np.add.reduceat(data[:n] * weight, first), True
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[used], np.add.reduceat(used.sum(1), first)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def means(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean of each run of ``lengths`` values; all lengths above zero."""
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) / lengths if len(lengths) else np.zeros(0)


@dataclass
class Model:
    """Score of each hash bucket, not a number where it is unknown, and of no bag at all."""

    scores: np.ndarray
    bias: float
    empty: float

    def words(self, words: list[str]) -> np.ndarray:
        """Mean score of the known features of each word, 0 if there is none."""
        feats, counts = word_features(words)
        scores = self.scores[feats]
        known = ~np.isnan(scores)
        first = np.cumsum(counts) - counts
        return np.add.reduceat(np.where(known, scores, 0).astype(np.float64), first) / np.maximum(np.add.reduceat(known, first, dtype=np.int64), 1)


class Words(dict):
    """Word -> its score, for one model in one Python worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, words: set[str]) -> None:
        if len(self) > WORD_MEMORY:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            self.update(zip(new, self.model.words(new).tolist()))


_words: dict[int, Words] = {}


def words_of(model: Model) -> Words:
    """The worker's memory of the model's words, kept between tasks; another model takes its place."""
    key = hash((model.scores.tobytes(), model.bias))
    if key not in _words:
        _words.clear()
        _words[key] = Words(model)
    return _words[key]


def train(texts: list[str], labels: list[int], dim: int = 16, epochs: int = 40, rate: float = 0.3, seed: int = 7) -> Model:
    """Fit vectors and softmax together by Adagrad.

    Each epoch takes one bag of every document: at first any, later the one
    with the highest score so far, so positive documents learn from the bag
    that made them so and negative ones from their most misleading bag.  One
    class alone, or no words, gives a constant model.
    """
    number: dict[str, int] = {}
    words, doc_words = [], []
    for t in texts:
        own = WORD.findall((t or "").lower())
        words.append(np.array([number.setdefault(w, len(number)) for w in own], np.int32))
        doc_words.append(len(own))
    labels = np.array([y for y, n in zip(labels, doc_words) if n], np.int64)
    words = [w for w in words if len(w)]
    base = float(labels.mean()) if len(labels) else 0.0
    if base in (0.0, 1.0):
        return Model(np.full(BUCKETS, np.nan, np.float32), 30.0 if base else -30.0, base)
    feats, n_feats = word_features(list(number))
    in_docs = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=len(n_feats))
    frequent = np.bincount(feats, np.repeat(in_docs, n_feats), BUCKETS) >= LEAST_DOCS
    names = np.flatnonzero(frequent)
    keep = frequent[feats]
    n_feats = np.add.reduceat(keep, np.cumsum(n_feats) - n_feats).astype(np.int64)
    # a word without a known feature has one that stays zero
    compact = np.full(BUCKETS, -1, np.int32)
    compact[names] = np.arange(len(names))
    blank = len(names)
    feats = compact[feats[keep]]
    bare = n_feats == 0
    feats = np.insert(feats, (np.cumsum(n_feats) - n_feats)[bare], blank)
    n_feats[bare] = 1
    n_known = blank + 1
    first_feat = np.cumsum(n_feats) - n_feats
    # bags of all documents as runs of one word list
    bag_sizes = [np.minimum(BAG, len(w) - np.arange(0, len(w), BAG)) for w in words]
    n_bags = np.array([len(b) for b in bag_sizes])
    first_bag = np.cumsum(n_bags) - n_bags
    sizes, words = np.concatenate(bag_sizes), np.concatenate(words)
    first_word = np.cumsum(sizes) - sizes

    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (n_known, dim)).astype(np.float64) / dim
    vectors[blank] = 0
    soft, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    seen = [np.full(n_known, 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)]
    share = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base))
    for epoch in range(epochs):
        if epoch < 4:
            pick = first_bag + rng.integers(0, n_bags)
        else:
            bucket = vectors @ (soft[:, 1] - soft[:, 0])
            score = means(means(bucket[feats], n_feats)[words], sizes)
            # place of the largest score of each document
            top = np.maximum.reduceat(score, first_bag)
            pick = np.full(len(labels), len(score))
            np.minimum.at(pick, np.repeat(np.arange(len(labels)), n_bags), np.where(score == np.repeat(top, n_bags), np.arange(len(score)), len(score)))
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 400)):
            bags = pick[part]
            own = words[ranges(first_word[bags], sizes[bags])]
            f = feats[ranges(first_feat[own], n_feats[own])]
            per_bag = np.add.reduceat(n_feats[own], np.cumsum(sizes[bags]) - sizes[bags])
            weight = np.repeat(1.0 / (n_feats[own] * np.repeat(sizes[bags], sizes[bags])), n_feats[own])
            mean = np.add.reduceat(vectors[f] * weight[:, None], np.cumsum(per_bag) - per_bag)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (share[part] / len(part))[:, None]
            up = p @ soft.T
            of_bag = np.repeat(np.arange(len(part)), per_bag)
            grads = np.stack([np.bincount(f, up[of_bag, d] * weight, n_known) for d in range(dim)], 1)
            for value, grad, past in ((soft, mean.T @ p, seen[1]), (bias, p.sum(0), seen[2])):
                past += grad * grad
                value -= 0.3 * rate * grad / np.sqrt(past)
            used = np.flatnonzero(np.bincount(f[f < blank], minlength=n_known))
            seen[0][used] += (grads[used] ** 2).mean(1)
            vectors[used] -= rate * grads[used] / np.sqrt(seen[0][used])[:, None]
    scores = np.full(BUCKETS, np.nan, np.float32)
    scores[names] = (vectors @ (soft[:, 1] - soft[:, 0]))[:blank]
    return Model(scores, float(bias[1] - bias[0]), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, learn, each: int = SAMPLE_EACH) -> list[tuple[str, int]]:
    """(text, label) of at most ``each`` labelled documents of either label for which ``learn(doc_id)`` holds.

    Several labels of a document count as their greatest, null ones not at
    all; of several texts of one id the least is taken.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).collect()]
    if not ids:
        return []
    wanted = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    rows = docs.join(F.broadcast(wanted), "doc_id").where(F.length("text") <= SAMPLE_CHARS).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r.text, r.toxic) for r in rows.orderBy("doc_id").collect()]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score double)``: chance of the worst bag of each whole text; texts without a letter get ``model.empty``."""

    def scored(batches):
        words = words_of(model)
        for batch in batches:
            out = []
            for own in found(batch.column(1), words):
                if not own:
                    out.append(model.empty)
                    continue
                z = np.fromiter(map(words.__getitem__, own), np.float64, len(own))
                starts = np.arange(0, len(z), BAG)
                worst = (np.add.reduceat(z, starts) / np.minimum(BAG, len(z) - starts)).max() + model.bias
                out.append(1 / (1 + np.exp(-np.clip(worst, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    def found(texts, words):
        """Words of each text; those of some texts at a time are learned together."""
        for at in range(0, len(texts), 128):
            own = [WORD.findall((t or "").lower()) for t in texts.slice(at, 128).to_pylist()]
            words.learn(set().union(*own))
            yield from own

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)

import random

import numpy as np
import pandas as pd

from tallyloom.llm import toxicity
from tallyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_unseen_misspellings_share_grams():
    rng = random.Random(3)
    calm = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(600)]
    bad = ["disgusting", "worthless", "pathetic", "stupid"]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(calm, k=rng.randint(5, 150))
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels, epochs=25)
    assert model.words(["disgustin", "worthles", "patheticc", "stupidd", *bad]).min() > np.quantile(model.words(calm), 0.98)


def test_word_features():
    feats, counts = toxicity.word_features(["ab", "réeux", "a"])
    alone = [toxicity.word_features([w])[0].tolist() for w in ("ab", "réeux", "a")]
    assert counts.tolist() == [len(a) for a in alone] == [4, 1 + 6 + 5 + 4, 2]
    assert feats.tolist() == sum(alone, [])


def test_held_out_documents(spark):
    got = QUERIES["op5_toxicity"](spark, FOLDER).toPandas()
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert got.score.between(0, 1).all() and set(got.predicted) == {0, 1}
    assert (held.predicted == held.toxic).mean() > 0.92 and held[held.toxic == 1].predicted.mean() > 0.65


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(odd_docs, labels, lambda doc_id: doc_id < 10)
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], epochs=3)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.training_rows(no_docs, labels, lambda doc_id: doc_id < 10) == []
    for constant in (toxicity.train([], []), toxicity.train(["a word"], [0]), toxicity.train(["a word", ""], [1, 1])):
        assert toxicity.score(odd_docs.limit(3), constant).count() == 3
    assert toxicity.score(no_docs, model).count() == 0

import pandas as pd
import numpy as np

from tallyloom.llm import language
from tallyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_bundle(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = " " + " ".join(letters.split()) + " "
    out = np.zeros(language.DIM)
    classes, vectors = language.letter_classes(), language.letter_vectors()
    code = [0 if c == " " else int(classes[ord(c)]) for c in letters]
    for a, b, c in zip(code, code[1:], code[2:]):
        out += vectors[2][a].astype(int) * vectors[1][b] * vectors[0][c]
    return out


def test_bundles_are_sums_of_bound_letters(odd_rows, monkeypatch):
    monkeypatch.setattr(language, "PART", 700)
    texts = [r[1] for r in odd_rows if len(r[1] or "") < 600] + ["A b, 3c! ñandú Ünder 北京", "ab", "a"]
    assert np.array_equal(language.bundles(texts), np.array([brute_bundle(t) for t in texts]))


def test_held_out_documents(spark):
    got = QUERIES["op8_language_profiles"](spark, FOLDER).toPandas()
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(docs) and 0.25 < both.held_out.mean() < 0.42
    assert (held.lang_pred == held.lang).mean() > 0.97 and both.score.between(0, 1).all()


def test_odd_documents(spark, odd_docs, no_docs):
    known = language.profiles(odd_docs)
    assert [k for k, _ in known] == ["en"]
    got = language.identify(odd_docs, known).toPandas()
    assert len(got) == odd_docs.count()
    assert set(got[got.doc_id.isin([5, 6, 7])].lang_pred) == {"und"} and (got[~got.doc_id.isin([5, 6, 7])].lang_pred == "en").all()
    assert language.profiles(no_docs) == [] and language.identify(no_docs, []).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, []).collect()} == {"und"}

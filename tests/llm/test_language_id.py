import random
import zlib

import numpy as np

from stopfield.llm import language_id as ident
from tests.llm.conftest import ODD_TEXTS

WORDS = {"aa": "tara lino mesu karo pila sote", "bb": "schwur krafz pfölg drachz blütz knorz", "cc": "wyth hwyn llaed gwylf ynys cymry"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang, rng.randint(2, 60)).title() + ".", lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_documents(spark):
    rows = corpus(300)
    out = {r.doc_id: r for r in ident.language_report(frame(spark, rows)).collect()}
    assert {i for i, r in out.items() if r.held_out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(out[i].lang_pred == lang and out[i].score > 0.5 for i, _, lang in rows)
    assert len(out) == len(rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = corpus(200)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    pick = lambda rs: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in ident.language_report(frame(spark, rs)).collect()}
    assert pick(swapped) == pick(rows)


def test_shares_of_a_mixture(spark):
    rng = random.Random(4)
    training = frame(spark, corpus(200)).select("text", "lang")
    docs = frame(spark, [(1, sentence(rng, "aa", 75) + " " + sentence(rng, "bb", 25), None), (2, sentence(rng, "cc", 40), None)])
    got = {r.doc_id: r for r in ident.identified(docs, training).collect()}
    assert got[1].lang_pred == "aa" and [x.lang for x in got[1].languages] == ["aa", "bb"]
    assert abs(got[1].score - 0.75) < 0.02 and abs(sum(x.share for x in got[1].languages) - 1) < 1e-9
    assert [tuple(x) for x in got[2].languages] == [("cc", 1.0)]


def brute_shares(logs):
    p = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-30
    share = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(ident.ROUNDS):
        part = p * share
        share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
    return share


def test_sets_of_documents_side_by_side():
    rng = np.random.default_rng(2)
    sizes = [1, 30, 7, 90, 2]
    docs = [rng.normal(0, 3, (n, 4)) for n in sizes]
    docs[3][:45, 2] += 20
    docs[3][45:, 0] += 20
    together = ident.language_sets(np.concatenate(docs), np.cumsum([0, *sizes[:-1]]))
    for doc, shares in zip(docs, together):
        assert np.allclose(shares, ident.language_sets(doc, np.array([0]))[0])
        chosen = np.nonzero(shares)[0]
        assert np.allclose(shares[chosen], brute_shares(doc[:, chosen] - doc.max(axis=1, keepdims=True)) if len(chosen) > 1 else 1, atol=1e-6)
    assert set(np.nonzero(together[3])[0]) == {0, 2}


def test_counts_against_brute_force(spark, monkeypatch):
    rows = corpus(60)
    want = {}
    for _, text, lang in rows:
        for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
            for a, b, c in zip(" " + word, word, word[1:] + " "):
                key = (lang, (ord(a) << 42) | (ord(b) << 21) | ord(c))
                want[key] = want.get(key, 0) + 1
    for batch in (ident.BATCH_CHARS, 40):
        monkeypatch.setattr(ident, "BATCH_CHARS", batch)
        got = ident.learned(frame(spark, rows))
        assert {(r.lang, r.gram): r.n for r in got.collect()} == want


def test_large_alphabets_take_the_sorted_way():
    text = " " + " ".join(chr(0x4E00 + i) + chr(0x5E00 + i) for i in range(300)) + " ab "
    values, index, at = ident.trigrams(text)
    want = [(ord(text[i - 1]) << 42) | (ord(text[i]) << 21) | ord(text[i + 1]) for i in at]
    assert values[index].tolist() == want and (np.diff(values) > 0).all()
    small = ident.trigrams(" abc ab ")
    assert len(small[0]) == 4 and (np.diff(small[0]) > 0).all() and small[2].tolist() == [1, 2, 3, 5, 6]


def test_odd_rows_chunks_and_missing_labels(spark, odd_docs, no_docs, monkeypatch):
    training = frame(spark, [*corpus(50), (0, "no label", None), (1, None, "aa"), (2, "42 !", "digits")]).select("text", "lang")
    out = ident.identified(odd_docs, training)
    rows = out.collect()
    assert out.columns == ["doc_id", "lang_pred", "score", "languages"] and len(rows) == len(ODD_TEXTS) + 3
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2} and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {"und", "aa", "bb", "cc"}
    monkeypatch.setattr(ident, "CHUNK_BYTES", 1 << 10)
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 9))
    assert sorted(map(key, ident.identified(odd_docs, training).collect())) == sorted(map(key, rows))
    assert {(r.lang_pred, r.score) for r in ident.identified(odd_docs, training.limit(0)).collect()} == {("und", 0.0)}
    assert ident.identified(no_docs, training).collect() == []

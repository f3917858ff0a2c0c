import random
import zlib

import numpy as np

from stopfield.llm import quality
from tests.llm.conftest import ODD_TEXTS


def corpus(n):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(body) + "." if good else "!! ".join(w.upper() for w in body)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus(400)
    frame = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs_of(rows), frame).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert abs(np.mean([r.score - truth[r.doc_id] for r in held])) < 0.05
    again = quality.quality_scores(docs_of(rows[::-1]).repartition(3), frame).collect()
    assert {r.doc_id: round(r.score, 4) for r in out} == {r.doc_id: round(r.score, 4) for r in again}


def test_odd_rows_and_labels_of_one_class(spark, odd_docs, no_docs):
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd_docs, one).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and {r.score for r in rows} == {1.0}
    assert {r.score for r in quality.quality_scores(odd_docs, one.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(no_docs, one).collect() == []
    mixed = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(odd_docs, mixed).collect())


def test_pieces_do_not_change_counts(monkeypatch):
    vectors = quality.index_vectors()
    texts = ["one two three " * 500, None, "", "x!! y!!", "one two three " * 500]
    whole = quality.pooled(texts, vectors)
    monkeypatch.setattr(quality, "PIECE", 300)
    assert np.allclose(whole, quality.pooled(texts, vectors), atol=1e-4) and np.allclose(whole[0], whole[4])


def test_words_are_hashed_alike_anywhere():
    a, first = quality.word_buckets(b"foo bar!! foo\nbar\n", np.array([0, 14, 18]))
    assert a[0] == a[3] and a[1] == a[4] and first.tolist() == [0, 4, 5]

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stopfield.llm import bpe
from stopfield.llm.common import BATCH_SETTING
from stopfield.llm.queries import byte_vocabulary
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def automaton():
    with open(byte_vocabulary(), encoding="utf-8") as f:
        return bpe.Automaton(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_vocabulary())


def same(automaton, library, texts):
    for text, got, want in zip(texts, automaton.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, text[:80]
        assert automaton.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_texts_as_the_library(automaton, library):
    rng = random.Random(1)
    labels = [x.decode("utf-8", "ignore") for x in automaton.labels if x]
    texts = ["", " ", "  ", "a  b   c \n d\n\n  e  ", "it's we'll\u00a0x\x1c\x85y", "<|endoftext|>a<|endoftext|><|endoftext|> b", "aaaa" * 50, "ab" * 900, "日本語 テキスト" * 9, "՘ࢗ new", "🙂🙃"]
    texts += ["".join(rng.choice(labels) for _ in range(rng.randint(1, 20))) for _ in range(500)]
    texts += ["".join(rng.choice("ab ethnrs'01.\n") for _ in range(rng.randint(1, 120))) for _ in range(500)]
    same(automaton, library, texts)


def test_texts_are_encoded_some_bytes_at_a_time():
    texts = ["a b " * 50_000, None, "", *["日本 " * 30_000] * 12, "x " * 3_000_000, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    runs = list(bpe._slices(batch.slice(1), 1))
    assert [t for _, _, x in runs for t in x] == texts[1:] and [a for a, _, _ in runs] == [0, *[b for _, b, _ in runs[:-1]]]
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= 1 << 20 for _, _, x in runs)


def test_batches_are_bounded_in_bytes(spark):
    spark.conf.unset(BATCH_SETTING)
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab c', 1000)").alias("text"))
    bpe.token_rows(docs, byte_vocabulary())
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 20_000_000 and max(r["n"] for r in sizes) < 5_000_000


def test_a_full_cache_starts_anew(automaton, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    for _ in range(3):
        same(automaton, library, ["one two three four five six", "seven eight"])


def test_there_is_one_path(automaton):
    """Of all splits of a word into tokens the automaton accepts one."""
    ids = {x: i for i, x in enumerate(automaton.labels) if x}

    def paths(word, state):
        if not word:
            return [[]]
        tokens = [ids[word[:n]] for n in range(1, len(word) + 1) if word[:n] in ids]
        return [[t, *rest] for t in tokens if automaton.has_arc(np.array([state]), np.array([t]))[0] for rest in paths(word[len(automaton.labels[t]) :], t)]

    for word in ("there", "ation", "aaaaaaa", "inginging", " unhappiness", "ééé"):
        assert paths(word.encode(), automaton.start) == [automaton.encode([word])[0].tolist()]


def test_operators_round_trip(odd_docs, no_docs, library):
    path = byte_vocabulary()
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(odd_docs, path).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()) in rows
    back = bpe.decoded(bpe.encoded(odd_docs, path), path).collect()
    assert sorted((r.text for r in back)) == sorted([t or "" for t in ODD_TEXTS] + ["no id", "same text here", "other text under the same id"])
    assert bpe.token_rows(no_docs, path).collect() == []

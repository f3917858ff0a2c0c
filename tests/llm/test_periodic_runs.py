import hashlib
import random
import zlib

import numpy as np
import pytest

from stopfield.llm import periodic_runs as runs
from stopfield.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS


def brute(words):
    """All runs by the definition: every maximal stretch of a period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            end = i
            while end + 1 < n and words[end + 1] == words[end + 1 - q]:
                end += 1
            length = end - i + 1 + q
            if length >= max(12, 2 * q):
                found.setdefault((i - q, length), q)
            i = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def wanted(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    return (len(found), *top, sha(lines.encode()), sha(left))


def found_in(text):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in text], np.int64)
    return sorted((s, n, p) for (s, n), p in runs.batch_runs(ids, np.array([0, len(ids)])).items())


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_runs_against_the_definition(letters):
    rng = random.Random(letters)
    for _ in range(250):
        text = ""
        while len(text) < rng.randint(0, 160):
            piece = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
            text += piece * rng.choice([1, 1, 2, 3, 5]) + piece[: rng.randint(0, len(piece))]
        assert found_in(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 400, "ab" * 60 + "a" + "ab" * 60 + "a", ("a" * 40 + "b") * 9, ("abaab" * 7 + "c") * 6, "a" * 30 + "b" + "a" * 30 + "b" + "a" * 31, "x" * 11, "x" * 12])
def test_nested_and_neighbouring_powers(text):
    assert found_in(text) == brute(text)


def test_documents_in_one_batch_do_not_meet():
    a, b = [1, 2, 3] * 3, [1, 2, 3] * 5
    got = runs.batch_runs(np.array(a + b, np.int64), np.array([0, len(a), len(a) + len(b)]))
    assert got == {(9, 15): 3}


def test_report_against_brute_force(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = {i: t for i, t in texts.items() if len((t or "").split()) <= 700}
    got = {r.doc_id: tuple(r)[1:8] for r in runs.run_report(docs).collect()}
    assert set(got) == set(texts) and len(short) > 100
    assert all(got[i] == wanted(i, t) for i, t in short.items())
    assert sum(g[0] > 0 for g in got.values()) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    got = runs.run_report(odd_docs).collect()
    assert len(got) == len(ODD_TEXTS) + 3
    for r in got:
        text = "no id" if r.doc_id is None else None
        options = [ODD_TEXTS[r.doc_id], "other text under the same id"] if r.doc_id is not None else [text]
        if len(options[0] or "") < 1000:
            assert tuple(r)[1:8] in [wanted(r.doc_id, t) for t in options]
        else:  # one word 30,000 times and another once
            assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 30_000, 1)
    assert runs.run_report(no_docs).collect() == []


def test_real_output(docs_of):
    row = runs.periodic_runs(docs_of([(1, "see " + "buy now " * 8 + "end")])).first()
    assert row.runs == [(1, 16, 2)] and row.collapsed == "see buy now end" and row.n_words == 18


def test_batches_do_not_change_results(monkeypatch, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    work = runs._worked(runs.looped_words)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    out = [r for b in work([batch]) for r in b.to_pylist()]
    assert [sorted((x["start"], x["length"], x["period"]) for x in r["runs"]) for r in out] == [brute(runs.looped_words(i, t)) for i, t in rows]


def test_registered():
    assert "op13_periodic_runs" in QUERIES

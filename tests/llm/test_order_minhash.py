import hashlib
import random

from stopfield.llm import order_minhash as omh
from tests.llm.conftest import ODD_TEXTS


def brute(rows):
    """Neighbours in descending (id, then larger digest first is only needed for repeated ids)."""
    rows = sorted(rows, reverse=True)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = omh.edited(text, following)
        own, other, nxt = omh.sketch(text), omh.sketch(changed), omh.sketch(following)
        yield doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), omh.printed(own), omh.printed(other), omh.likeness(own, other), omh.likeness(own, nxt)


def test_report_against_brute_force(docs_of):
    rng = random.Random(2)
    rows = [(i * 3 - 50, "".join(rng.choice("abcde fg") for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(300)]
    assert sorted(tuple(r) for r in omh.edit_report(docs_of(rows).repartition(7)).collect()) == sorted(brute(rows))


def test_one_row_is_its_own_next(docs_of):
    (row,) = omh.edit_report(docs_of([(4, "abcdef")])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_follows_edits_and_order():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text, other = " ".join(words), " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    few, turned = " ".join(w if i % 60 else "x" for i, w in enumerate(words)), " ".join(words[200:] + words[:200])
    like = lambda a, b: omh.likeness(omh.sketch(a), omh.sketch(b))
    assert like(text, text) == 1 and like(text, few) > 0.5 and like(text, other) < 0.1
    assert like(text, turned) < like(text, few)


def test_occurrences_are_numbered():
    content, numbered = omh.kmers("abcdefgh" * 5)
    assert len(set(content.tolist())) == 8 and len(set(numbered.tolist())) == len(numbered)


def test_odd_rows(odd_docs, no_docs):
    rows = omh.edit_report(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert len({r.fingerprint for r in rows if r.doc_id in (0, 1)}) == 1
    assert omh.edit_report(no_docs).collect() == []
    assert len(omh.fingerprints(odd_docs).collect()) == len(rows)

import hashlib
import random

import numpy as np
import pytest

import stopfield.llm.suffix_dedup as dedup
from stopfield.llm.suffix_array import suffix_arrays
from tests.llm.conftest import ODD_TEXTS


def naive_suffixes(symbols, bounds):
    return [x for a, b in zip(bounds, bounds[1:]) for x in sorted(range(a, b), key=lambda p: symbols[p:b])]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays_against_sorting(seed):
    rng = random.Random(seed)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 8)):
            n, letters = rng.choice([0, 1, 2, 7, 40]), rng.choice([1, 2, 3, 26])
            part = [rng.randrange(letters) for _ in range(n)]
            parts.append((part[: rng.randint(1, 4)] * 40)[:n] if rng.random() < 0.3 else part)
        symbols, bounds = [x for p in parts for x in p], np.cumsum([0, *map(len, parts)]).tolist()
        assert suffix_arrays(np.array(symbols, int), np.array(bounds)).tolist() == naive_suffixes(symbols, bounds)


def brute(rows):
    """Every 100-byte string in order of (id, start)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def found(docs):
    return sorted((tuple(r) for r in dedup.repeat_report(docs).collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(70), text(12)
    rows = [(i, text(rng.randint(5, 90))) for i in range(25)]
    rows += [(100 + i, text(20) + " " + passage + " " + text(15)) for i in range(12)]
    rows += [(200 + i, line + "\n" + text(25)) for i in range(12)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, "ab" * 200), (303, "abc " * 100 + passage), (304, passage + passage)]
    rows += [(400 + i, " ".join(w if rng.random() > 0.02 else "q" for w in rows[30][1].split())) for i in range(6)]
    return rows


@pytest.mark.parametrize("group", [64, 2])
def test_planted_repeats(docs_of, monkeypatch, group):
    monkeypatch.setattr(dedup, "GROUP", group)  # 2: hot groups are split again and again
    rows = planted(7)
    assert found(docs_of(rows)) == sorted(brute(rows), key=str)


def test_long_text_in_pieces(docs_of, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 500)
    rows = planted(3) + [(900, " ".join(t for _, t in planted(3)[:20]))]
    assert found(docs_of(rows)) == sorted(brute(rows), key=str)


def test_odd_rows(odd_docs, no_docs):
    out = {r.doc_id: r for r in dedup.repeats_removed(odd_docs).collect()}
    assert len(dedup.repeats_removed(odd_docs).collect()) == len(ODD_TEXTS) + 3
    assert out[0].n_bytes == 0 and out[0].kept == b"" and out[3].n_removed == 0
    assert out[7].n_removed > 165_000 and out[7].n_spans == 2
    assert dedup.repeat_report(no_docs).collect() == []

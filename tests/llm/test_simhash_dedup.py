import random

import numpy as np
import pytest

from stopfield.llm import simhash_dedup as near
from stopfield.llm.common import landed
from stopfield.llm.components import components
from stopfield.llm.fingerprint import simhash
from tests.llm.conftest import ODD_TEXTS


def reach(nodes, linked):
    out = {}
    for n in sorted(nodes):
        if n not in out:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = n
                    stack += [y for y in nodes if linked(x, y) and y not in out]
    return out


@pytest.mark.parametrize("codes", [("golay", "hamming7"), ("golay", "golay", "hamming15"), ("hamming7",)])
def test_every_pair_within_the_threshold_meets(codes):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, homes = near.anchors_of(fps, codes, 0)
    assert len(homes) == len(fps)
    for fp, home in zip(fps, homes):
        other = fp ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        assert home in near.anchors_of(np.array([other]), codes, 3)[1]


def test_fingerprint_words():
    assert simhash(None) == simhash(" \n") == 0
    assert simhash("A b\tC  d") == simhash("a B c\nD") != simhash("a b c e")
    assert simhash("one two") == simhash("ONE\ntwo")
    import xxhash

    assert simhash("One two three") == xxhash.xxh64_intdigest(b"one two three", 42)


def test_components_against_brute_force(docs_of):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, " ".join(base[:i % 5] + base + [rng.choice(words)] * (i % 3))) for i in range(60)]
    prints = {i: simhash(t) for i, t in rows}
    want = reach(list(prints), lambda x, y: bin(prints[x] ^ prints[y]).count("1") <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near.near_duplicate_report(docs_of(rows)).collect()}
    assert got == {i: (format(prints[i], "016x"), want[i]) for i in prints}
    kept = [r.doc_id for r in near.one_of_each(docs_of(rows)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_a_long_chain_is_one_component(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}
    assert components(links.limit(0)).collect() == []


def test_odd_rows(odd_docs, no_docs):
    rows = near.near_duplicate_report(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    by_id = {r.doc_id: r for r in rows if r.doc_id in (0, 1, 2)}
    assert {r.component_id for r in by_id.values()} == {0} and {r.fingerprint for r in by_id.values()} == {"0" * 16}
    kept = near.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sum(r.text == "same text here" for r in kept.collect()) == 1
    assert near.near_duplicate_report(no_docs).collect() == [] and near.one_of_each(no_docs).collect() == []


def test_replicas_are_not_broadcast(spark):
    # few fingerprints make many replicas, which the planner takes for as few
    distinct = landed(spark.createDataFrame([(i * 7919,) for i in range(50)], "fp long"))
    plan = near.near_links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [home" in plan and "Broadcast" not in plan

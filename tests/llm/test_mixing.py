import math

import pytest

from stopfield.llm import mixing
from tests.llm.conftest import ODD_TEXTS


def filled(sizes, weights, most):
    """Excess is shared again by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1e-12)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, None: 5}, {"b": 0, "a": 10}, {"é": 3, "z": 50, "A": 7, "aa": 400, None: 9}, {"x": 4}])
def test_targets(spark, sizes):
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    want = filled(sizes, mixing.WEIGHTS, mixing.MOST_TIMES)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_copies_follow_the_rate(docs_of):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else "small") for i in range(6000)]
    report = mixing.mix_report(docs_of(rows)).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs_of(rows[::-1]).repartition(5)).collect()}
    assert {r.doc_id: r.taken for r in report} == again
    assert all(r.taken <= 3 * r.size and r.taken % r.size == 0 for r in report)
    for target in {r.target for r in report}:
        taken = sum(r.taken for r in report if r.target == target)
        assert abs(taken - target) < 0.05 * target
    mixed = mixing.mixed(docs_of(rows))
    assert mixed.columns == ["doc_id", "text", "source"] and mixed.count() == sum(r.taken // r.size for r in report)


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and {r.doc_id: r.size for r in rows}[0] == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(odd_docs).count() > 0
    assert mixing.mix_report(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []

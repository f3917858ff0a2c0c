import random

import pytest

from stopfield.llm import hamming_search


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(items, queries, k):
    return sorted((q, rank, i, d) for q, code in queries for rank, (d, i) in enumerate(sorted((bin(code ^ c).count("1"), i) for i, c in items if i != q)[:k], 1))


@pytest.mark.parametrize("near", [True, False])
def test_against_brute_force(spark, near):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    flip = lambda: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
    items = [(i, flip() if near else rng.getrandbits(64)) for i in range(120)] + [(200 + i, base) for i in range(20)]
    queries = items[::15] + items[-2:]
    frame = lambda rows: spark.createDataFrame([(i, signed(c)) for i, c in rows], "id long, code long")
    got = sorted(tuple(r) for r in hamming_search.nearest_codes(frame(items), frame(queries), 5).collect())
    assert got == brute(items, queries, 5)


def test_few_items_nulls_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, code long"
    df = spark.createDataFrame([(0, [1.0, -1.0], 1), (1, [1.0, None], 2), (50, [-1.0, 1.0], 3), (2, None, 4)], schema)
    got = sorted(tuple(r) for r in hamming_search.vector_search(df).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 50, 2), (50, 1, 0, 2), (50, 2, 1, 2)]
    assert hamming_search.vector_search(df.limit(0)).collect() == []


def test_wide_vectors_are_refused_and_every_row_of_an_id_counts(spark):
    schema = "vec_id long, embedding array<float>, id long, code long, q long, bound int, mask long"
    wide = spark.createDataFrame([(1, [1.0] * 66, 1, 1, 1, 1, 1)], schema)
    with pytest.raises(Exception, match="66 elements"):
        hamming_search.vector_search(wide).collect()
    rows = [(50, [1.0] * 64, 0, 0, 0, 0, 0)] * 2 + [(7, [1.0] * 63 + [-1.0], 0, 0, 0, 0, 0)] * 3 + [(8, [None] * 64, 0, 0, 0, 0, 0), (9, None, 0, 0, 0, 0, 0)]
    got = hamming_search.vector_search(spark.createDataFrame(rows, schema)).collect()
    assert [(r.query_id, r.vec_id, r.distance) for r in sorted(got, key=lambda r: r["rank"])] == [(50, 7, 1)] * 3 + [(50, 8, 64)]  # every row counts

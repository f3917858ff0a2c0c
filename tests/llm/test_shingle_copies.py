import random

import numpy as np

import corpus_pipeline
from stopfield.llm import shingle_copies
from stopfield.llm.components import joined_groups
from stopfield.llm.fingerprint import simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups_of(rows):
    sets, group = {d: shingles(t) for d, t in rows}, {}
    for d in sorted(sets):
        near = {group[x] for x in group if alike(sets[x], sets[d])}
        group = {x: min(near, default=d) if g in near else g for x, g in group.items()}
        group[d] = min(near, default=d)
    return group


def edited_texts(seed=3):
    rng, rows = random.Random(seed), []
    for base in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 5, 6, 9, 30, 200]))]
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, ""), (len(rows) + 3, "W1 w2")]


def test_groups_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(shingle_copies, "BUCKET_BYTES", 1000)
    rows = edited_texts()
    want, got = groups_of(rows), {r.doc_id: r.label for r in shingle_copies.near_copies(docs_of(rows).repartition(5)).collect()}
    ids = [d for d, _ in rows]
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in ids for b in ids)
    assert 20 < len(set(want.values())) < 120


def test_parities_never_differ_more_than_the_sets():
    rng = random.Random(4)
    for _ in range(40):
        a = {rng.randrange(-(2**63), 2**63) for _ in range(rng.randint(1, 900))}
        b = {g for g in a if rng.random() < 0.8} | {rng.randrange(-(2**63), 2**63) for _ in range(rng.randint(0, 90))}
        one, two = (shingle_copies.parities(np.unique(np.array(sorted(x), np.int64))) for x in (a, b))
        assert len(one) == shingle_copies.CELLS // 64 and int(np.bitwise_count((one ^ two).view(np.uint64)).sum()) <= len(a ^ b)


def test_a_large_group_without_links_and_one_with(spark, docs_of):
    """Copies of one text, each with its own changed words: with many changes no pair is linked, with few all are."""
    rng = random.Random(12)
    rows = []
    for changes in (1, 9):
        words = [f"v{changes}x{rng.randrange(3000)}" for _ in range(200)]
        for _ in range(60):
            copy = list(words)
            for k in rng.sample(range(200), changes):
                copy[k] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    want, got = groups_of(rows), {r.doc_id: r.label for r in shingle_copies.near_copies(docs_of(rows)).collect()}
    assert len({got[d] for d in range(60)}) == len({want[d] for d in range(60)}) == 1
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in want for b in want)


def test_stage_drops_pairs_of_five_word_similarity_at_0_8_that_fingerprints_keep(spark, docs_of):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(99)]
    one, two, three = list(words), list(words), list(words)
    two[10] = two[60] = "other"  # 10 of 95 shingles go: 85 / 105 = 0.81
    three[10] = three[40] = three[70] = "apart"  # 80 / 110 = 0.73
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(three))]
    assert (simhash(rows[0][1]) ^ simhash(rows[1][1])).bit_count() > 3
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs_of(rows), "").collect()) == [1, 3]


def test_stage_on_odd_rows(spark, odd_docs, no_docs):
    kept = corpus_pipeline.keep_one_of_near_copies(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 5, 7, 8, 9] and kept.filter("doc_id is null").count() == 1
    assert corpus_pipeline.keep_one_of_near_copies(spark, no_docs, "").collect() == []


def test_stage_drops_texts_whose_fingerprints_alone_are_near(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{i % 40}" for i in range(40)] * 12 + [f"u{rng.randrange(9000)}" for _ in range(50)]
    near = next(c for c in (words[:-50] + [f"x{seed}y{i}" for i in range(20)] + words[-30:] for seed in range(4000)) if (simhash(" ".join(words)) ^ simhash(" ".join(c))).bit_count() <= 3)
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "quite another text of some words")]
    grams = [set(shingle_copies.shingle_set(text)) for _, text in rows]
    assert len(grams[0] & grams[1]) < 0.8 * len(grams[0] | grams[1])
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs_of(rows), "").collect()) == [1, 3]


def test_groups_of_two_tables_are_joined(spark):
    kind = "doc_id long, h long, label long"
    one = spark.createDataFrame([(1, 11, 1), (2, 12, 1), (3, 13, 3), (4, 14, 4), (None, 14, 4)], kind)
    other = spark.createDataFrame([(1, 11, 1), (2, 12, 2), (3, 13, 2), (4, 14, 4), (None, 14, 4)], kind)
    got = {(r.doc_id, r.h): r.label for r in joined_groups(one, other).collect()}
    assert len(got) == 5 and got[1, 11] == got[2, 12] == got[3, 13] != got[4, 14] == got[None, 14]


def test_lists_that_an_explode_has_made_are_not_broadcast(docs_of, monkeypatch):
    plans = []
    landed = shingle_copies.landed
    monkeypatch.setattr(shingle_copies, "landed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or landed(df))
    text = " ".join(f"w{i}" for i in range(40))
    assert len({r.label for r in shingle_copies.near_copies(docs_of([(1, text), (2, text + " end"), (3, "other " + text), (4, "one more text of some words")])).collect()}) == 2
    met = [line for plan in plans for line in plan.splitlines() if "Join [g" in line]
    assert len(met) > 1 and all("SortMergeJoin" in line for line in met), met

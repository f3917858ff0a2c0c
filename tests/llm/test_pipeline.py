import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from stopfield.llm import line_dedup, queries
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_shingle_copies import groups_of
from tools import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, tables, name):
    df = contract.queries()[name](spark, SF)
    cur = tables.execute(contract.oracle_sql()[name])
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names, stages = [n for n, _ in corpus_pipeline.STAGES], [f for _, f in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = stages[0](spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    right = sum((d in kept) == bool(q) for d, q in labels.items())
    assert right > 0.95 * len(labels)

    lined = stages[1](spark, good, SF).cache()
    want = {d: t for d, (t, _, gone, _) in brute_lines([(r.doc_id, r.text) for r in good.collect()]).items() if t or not gone}
    assert {r.doc_id: r.text for r in lined.collect()} == want and all(r.n_chars == len(r.text) for r in lined.collect())

    alone = stages[2](spark, lined, SF).cache()
    groups = groups_of([(r.doc_id, r.text) for r in lined.collect()])  # every pair by its five-word Jaccard similarity
    assert {r.doc_id for r in alone.collect()} == set(groups.values()) and len(set(groups.values())) < len(groups)

    mixed = stages[3](spark, alone, SF)
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= {r.doc_id for r in alone.collect()}
    tokens = stages[4](spark, mixed, SF).collect()
    assert len(tokens) == mixed.count() and all(r.n_tokens == len(r.ids) for r in tokens)


def test_run_returns_tokens(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(out.columns) and out.count() > 100


def test_stage_of_lines_drops_what_is_left_empty(spark, docs_of):
    docs = docs_of([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, ""), (4, None)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()) == [1, 3, 4]
    assert line_dedup.REMOVED not in corpus_pipeline.drop_repeated_lines(spark, docs, SF).columns

import pytest
from pyspark.sql import types as T

#: Rows that every operator must take: nulls, empty and very long texts, repeats, ties and a null id.
LONG = "lang " * 30_000 + "\n" + "x" * 20_000
ODD_TEXTS = [None, "", " \n\t ", "a", "Ein Satz. Noch ein Satz über Straßen.", "same text here", "same text here", LONG, "line one\nline two\nline three\nline four", "🙂🙃 ñandú"]


@pytest.fixture(scope="session")
def docs_of(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
    return lambda rows: spark.createDataFrame([(*r, "s")[:3] if len(r) == 2 else r for r in rows], schema)


@pytest.fixture(scope="session")
def odd_docs(spark, docs_of):
    """The odd rows, with columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (5, "same text here"), (5, "other text under the same id")]
    df = docs_of(rows)
    clash = ["h", "d", "t", "k", "fp", "at", "first", "size", "copies", "target", "label", "bucket", "copy", "ids", "x", "starts", "mix_copy", "in_0", "quality"]
    return df.selectExpr("*", *[f"'c{i}' AS `{c}`" for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))

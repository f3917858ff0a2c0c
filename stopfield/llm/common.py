"""What the text operators share: reading tables, document keys, partition counts and lineage cuts."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopfield.session import checkpoint_folder

__all__ = ["WORD", "bounded_batches", "drop_landed", "keyed", "landed", "read_table", "shuffle_width", "utf8"]

WORD = r"[^\x20\x09-\x0D]+"
"""A word: the longest run of characters that are none of space, tab and the line breaks U+000A to U+000D."""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(text, F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``d`` (the id), ``h`` (digest of the text) and ``t`` (the text, null as empty) of every row.

    ``(d, h)`` names a document: rows that repeat both are one document, and whatever is found for it holds for each of its rows.
    """
    text = utf8(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text, F.lit(1)).alias("h"), text.alias("t"))


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python hold at most some MB of rows (or one longer row), on both sides of the pipe. Changes no result; where the cluster sets
    the figure, its own stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landed(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows written once as a table in the folder that ``spark.checkpoint.dir`` names, and read from there.

    Cuts the lineage without computing the rows twice; executors share the folder, so a lost one costs nothing. The shuffle files of the
    write go when it ends, as nothing reads them again. The cluster empties the folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


_PATHS: dict[int, str] = {}


def drop_landed(df: DataFrame) -> None:
    """Delete a landed table that no later step reads."""
    path = _PATHS.pop(id(df))
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)

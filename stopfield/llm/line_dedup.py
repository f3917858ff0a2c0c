"""Line dedup on overlapping three-line windows.

Each window of three consecutive lines is hashed (128 bits). Of the places that hold one window, over all documents, the first stays: the
smallest doc_id (null first), within a document the earliest line. The lines that any later place covers are removed; positions that
overlapping windows cover are merged first.

Defined cases: lines end at U+000A; a null text is empty and has one empty line; documents under three lines have no window and stay whole;
windows of empty lines and lines of spaces (U+0020) only are not looked at; rows with the same id and text count once as a place and get the same result; of two texts
under one id the smaller digest comes first; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopfield.llm.common import keyed, utf8

WINDOW = 3
REMOVED = "__removed_lines"
"""The column that ``rewritten`` adds."""


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(d, h, at, k1, k2): the digest of the ``size`` lines from line ``at`` of every document."""
    lined = keyed(docs).select("d", "h", F.split("t", "\n").alias("lines"))
    hashed = lined.select("d", "h", F.transform("lines", lambda x: F.struct(F.xxhash64(x, F.lit(7)).alias("a"), F.xxhash64(x, F.lit(11)).alias("b"), (F.length(F.trim(x)) == 0).alias("blank"))).alias("marks"))
    placed = hashed.filter(F.size("marks") >= size).select("d", "h", "marks", F.explode(F.sequence(F.lit(0), F.size("marks") - size)).alias("at"))
    of = [F.get("marks", F.col("at") + i) for i in range(size)]
    blank = of[0]["blank"]
    for x in of[1:]:
        blank = blank & x["blank"]
    return placed.filter(~blank).select("d", "h", "at", F.xxhash64(*[x["a"] for x in of]).alias("k1"), F.xxhash64(*[x["b"] for x in of]).alias("k2"))


def later_places(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document (d, h) that holds a window seen before: ``starts``, the sorted first lines of such windows.

    Counting is pre-aggregated; the join back is an equality join whose hot keys adaptive execution splits.
    """
    places = windows(docs, size)
    first = places.groupBy("k1", "k2").agg(F.min(F.struct("d", "h", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    later = places.join(first, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).filter(~F.struct("d", "h", "at").eqNullSafe(F.col("first")))
    return later.groupBy("d", "h").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def cut_lines(text: str, starts: np.ndarray, size: int = WINDOW) -> tuple[str, int, int, int]:
    """The text without the lines that the windows from ``starts`` cover; its number of lines, removed lines and removed runs."""
    lines = text.split("\n")
    if not len(starts):
        return text, len(lines), 0, 0
    gone = np.zeros(len(lines) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.subtract.at(gone, np.minimum(starts + size, len(lines)), 1)
    gone = np.cumsum(gone)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return "\n".join(x for x, out in zip(lines, gone) if not out), len(lines), int(gone.sum()), spans


def _rebuild(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column(2).to_pylist(), batch.column(3)
            cut = [cut_lines(t, np.asarray(s.values) if s.is_valid else np.empty(0, np.int64), size) for t, s in zip(texts, starts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c[0] for c in cut], pa.string()), *[pa.array([c[i] for c in cut], pa.int64()) for i in (1, 2, 3)]],
                ["d", "h", "text", "n_lines", "n_removed", "n_spans"],
            )

    return run


def deduplicated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the text left, n_lines, n_removed and n_spans (maximal removed runs)."""
    all_docs, later = keyed(docs), later_places(docs, size).withColumnsRenamed({"d": "ld", "h": "lh"})
    joined = all_docs.join(later, F.col("d").eqNullSafe(F.col("ld")) & (F.col("h") == F.col("lh")), "left").select("d", "h", "t", "starts")
    kind = dict(all_docs.dtypes)["d"]
    rebuilt = joined.mapInArrow(_rebuild(size), f"d {kind}, h long, text string, n_lines long, n_removed long, n_spans long")
    return rebuilt.select(F.col("d").alias("doc_id"), "text", "n_lines", "n_removed", "n_spans")


def _rewrite(size: int, text_at: int, schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            starts = columns.pop()
            texts, removed = columns[text_at].to_pylist(), []
            for i, s in enumerate(starts):
                gone = 0
                if s.is_valid and texts[i] is not None:
                    texts[i], _, gone, _ = cut_lines(texts[i], np.asarray(s.values), size)
                removed.append(gone)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names)

    return run


def rewritten(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and whatever else, kept) with the text left in ``text`` and the number of removed lines in ``REMOVED``."""
    text_at = docs.columns.index("text")
    fields = [T.StructField(f"c{i}", T.StringType() if i == text_at else f.dataType) for i, f in enumerate(docs.schema.fields)]
    text = utf8(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text, F.lit(1)).alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    later = later_places(docs, size).withColumnsRenamed({"d": "ld", "h": "lh"})
    joined = rows.join(later, F.col("d").eqNullSafe(F.col("ld")) & (F.col("h") == F.col("lh")), "left").select(*[f.name for f in fields], "starts")
    schema = T.StructType([*fields, T.StructField(REMOVED, T.LongType())])
    return joined.mapInArrow(_rewrite(size, text_at, schema), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], REMOVED)


SQL = r"""
WITH lined AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS spot FROM lined
), marked AS (
  SELECT doc_id, spot, lines[spot + 1] AS a, lines[spot + 2] AS b, lines[spot + 3] AS c FROM placed
), seen AS (
  SELECT doc_id, spot, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, spot) AS nth FROM marked
  WHERE length(replace(a || b || c, ' ', '')) > 0
), gone AS (
  SELECT DISTINCT doc_id, spot + unnest([0, 1, 2]) AS line FROM seen WHERE nth > 1
), numbered AS (
  SELECT doc_id, unnest(lines) AS x, unnest(range(0, len(lines))) AS line FROM lined
), flagged AS (
  SELECT n.doc_id, n.line, n.x, g.line IS NOT NULL AS out FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.line = n.line
), runs AS (
  SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM flagged
)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT out), '') AS text, count(*) AS n_lines,
       count(*) FILTER (out) AS n_removed, count(*) FILTER (opens) AS n_spans FROM runs GROUP BY doc_id
"""

"""SimHash near-duplicates by anchor-point covering.

A covering code gives the anchors: every fingerprint has an anchor within the covering radius, its home. A fingerprint that differs from
another in at most ``t`` bits therefore lies within radius + t of the other's home. So each fingerprint is sent to every anchor within
covering radius plus threshold, homes and replicas meet per anchor in an equality join, and the distance is checked there. No link is lost.

The anchors are the product of perfect cyclic codes on disjoint bits (the rest of the bits is free), and radius and threshold are kept per
code: a pair that differs in t_i bits of code i meets if the sum of all t_i is at most t. Fingerprints are made distinct first. Of n distinct
ones each makes R replicas and meets n x R / A of them at home:

    codes                      bits  anchors A  replicas R (t = 3)
    golay                      23    2^12       71
    golay, hamming7 (default)  30    2^16       155
    golay, golay               46    2^24       301
    golay, golay, hamming15    61    2^35       about 1,000

The default suits up to some 10^8 distinct fingerprints; each further code trades replicas for shorter lists. Results do not depend on it.

Defined cases: texts without words (null, empty, white space) have fingerprint 0 and are linked like any other; equal fingerprints are linked;
component_id is the smallest id of the component and null only if all its ids are null; repeated ids keep their rows; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import bounded_batches, landed, utf8
from stopfield.llm.components import components
from stopfield.llm.fingerprint import simhash

THRESHOLD = 3
CODES = {"golay": (23, 0b101011100011, 3), "hamming7": (7, 0b1011, 1), "hamming15": (15, 0b10011, 1)}
"""Fixed values: length, generator polynomial and covering radius of the perfect cyclic codes."""
DEFAULT_CODES = ("golay", "hamming7")
BATCH = 2048


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.array([simhash(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64))], [*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): the fingerprint of every whole text as a signed long, and the digest of the text."""
    bounded_batches(docs.sparkSession)
    kind, text = dict(docs.dtypes)["doc_id"], F.col("text").cast("string")
    return docs.select(text.alias("text"), "doc_id", F.xxhash64(utf8(text), F.lit(1)).alias("h")).mapInArrow(_prints, f"doc_id {kind}, h long, fp long")


def _remainder(words: np.ndarray, n: int, g: int) -> np.ndarray:
    """Remainder of polynomials over GF(2) of degree under n by g."""
    degree, left = g.bit_length() - 1, words.copy()
    for bit in range(n - 1, degree - 1, -1):
        left ^= ((left >> bit) & 1) * (g << (bit - degree))
    return left


@lru_cache(maxsize=None)
def code_table(name: str, threshold: int) -> tuple:
    """For each remainder: its least error pattern, and the codewords within radius + 0..threshold of that pattern.

    Lists of all remainders lie behind each other in order of excess: ``starts`` of a remainder, ``ends[excess]`` of it, message and excess.
    """
    n, g, radius = CODES[name]
    degree = g.bit_length() - 1
    messages = np.arange(1 << (n - degree), dtype=np.int64)
    words = np.zeros_like(messages)
    for bit in range(n - degree):
        words ^= ((messages >> bit) & 1) * (g << bit)
    leaders = np.zeros(1 << degree, np.int64)
    for weight in range(radius, -1, -1):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(n), weight)], np.int64)
        leaders[_remainder(errors, n, g)] = errors
    near, excess, starts, ends = [], [], np.zeros(len(leaders), np.int64), np.zeros((threshold + 1, len(leaders)), np.int64)
    at = 0
    for i, leader in enumerate(leaders):
        over = np.maximum(np.bitwise_count(words ^ leader).astype(np.int64) - radius, 0)
        order = np.argsort(over, kind="stable")
        order = order[over[order] <= threshold]
        near.append(messages[order])
        excess.append(over[order])
        starts[i] = at
        ends[:, i] = at + np.searchsorted(over[order], np.arange(threshold + 1), side="right")
        at += len(order)
    return n, g, leaders, np.concatenate(near), np.concatenate(excess), starts, ends


def _message(codewords: np.ndarray, n: int, g: int) -> np.ndarray:
    """Quotient of codewords by g: the message that makes them."""
    degree, left, out = g.bit_length() - 1, codewords.copy(), np.zeros_like(codewords)
    for bit in range(n - 1, degree - 1, -1):
        top = (left >> bit) & 1
        out |= top << (bit - degree)
        left ^= top * (g << (bit - degree))
    return out


def anchors_of(fps: np.ndarray, codes: tuple[str, ...] = DEFAULT_CODES, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each anchor within radius + threshold of the fingerprints (uint64). With threshold 0: the homes."""
    row, anchor, left, shift = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.full(len(fps), threshold), 0
    for name in codes:
        n, g, leaders, near, excess, starts, ends = code_table(name, threshold)
        bits = ((fps >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)
        rest = _remainder(bits, n, g)
        home = _message(bits ^ leaders[rest], n, g)
        begin, count = starts[rest[row]], ends[left, rest[row]] - starts[rest[row]]
        again = np.repeat(np.arange(len(row)), count)
        place = begin[again] + np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        row, left = row[again], left[again] - excess[place]
        size = n - (g.bit_length() - 1)
        anchor = (anchor[again] << size) | (home[row] ^ near[place])
        shift += n
    return row, anchor


def _spread(codes: tuple[str, ...], threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(every), BATCH):
                fps = every[start : start + BATCH]
                row, anchor = anchors_of(fps.view(np.uint64), codes, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row])], ["anchor", "fp"])

    return run


def near_links(distinct: DataFrame, threshold: int = THRESHOLD, codes: tuple[str, ...] = DEFAULT_CODES) -> DataFrame:
    """(a, b), a < b: the pairs of fingerprints of ``distinct`` (fp, no repeats) that differ in 1 to ``threshold`` bits."""
    replicas = distinct.select("fp").mapInArrow(_spread(codes, threshold), "anchor long, fp long").select("anchor", F.col("fp").alias("b"))
    homes = distinct.select("fp").mapInArrow(_spread(codes, 0), "anchor long, fp long").select(F.col("anchor").alias("home"), F.col("fp").alias("a"))
    # a merge join: the planner takes the replicas for as small as the fingerprints, about 1 in 155 of them, and would broadcast them
    met = homes.join(replicas.hint("merge"), (F.col("home") == F.col("anchor")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, codes: tuple[str, ...] = DEFAULT_CODES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h (digest of the text), fp and ``component_id``, the smallest doc_id its links reach;
    ``label`` is the component's least fingerprint, one value for each component."""
    prints = landed(fingerprints(docs))
    distinct = landed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(near_links(distinct, threshold, codes))
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "of")
    of_print = labelled.join(least, F.col("label") == F.col("of")).select(F.col("fp").alias("p"), "component_id", "label")
    return prints.join(of_print, F.col("fp") == F.col("p")).select("doc_id", "h", "fp", "component_id", "label")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and whatever else, kept) without near-duplicates: of each component the row of the smallest doc_id
    (null last), of several with that id the one of least text digest; of rows that repeat id and text any one. ``found`` names the
    component of each row (doc_id, h, label); without it, that of ``near_duplicates``."""
    found = near_duplicates(docs) if found is None else found
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h").alias("h"))
    chosen = found.groupBy("label").agg(F.min(order).alias("o")).select(F.col("o.d").alias("od"), F.col("o.h").alias("oh")).distinct()
    text = utf8(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text, F.lit(1)).alias("h"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(chosen, F.col("d").eqNullSafe(F.col("od")) & (F.col("h") == F.col("oh")), "left_semi").dropDuplicates(["d", "h"])
    return kept.select("row.*")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as 16 lower-case hexadecimal digits, and component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

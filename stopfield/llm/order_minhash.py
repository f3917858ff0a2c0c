"""Document fingerprints by Order MinHash.

A k-mer is ``K`` code points in a row with the number of times it has been seen before in the text. Each of ``SKETCHES`` random orders selects
the ``KEPT`` least k-mers, keeps them in text order, and hashes that tuple; equal tuples need equal contents in equal order, which makes the
share of equal components sensitive to edits rather than to sets. The fingerprint is the tuples' hashes, 8 hexadecimal digits each.

The edited text of a document replaces the last third of its code points by the start of the next document in descending id. Neighbours
are found bucket by bucket (``order.in_order``): each text is shuffled once.

Defined cases: a null text is empty; a text shorter than a k-mer is one k-mer; the fingerprint of texts without characters is that of no k-mers,
and equals itself; null ids come after all others; rows that repeat an id are ordered by the digest of their text, larger first; a single
row is its own next; an empty table gives an empty result; other columns of the input are not read. Memory: about 60 bytes per code point
of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import utf8
from stopfield.llm.order import in_order

K = 8
KEPT = 2
SKETCHES = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 2**64, SKETCHES, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Content hash of the k-mer at each position, and the same hash with the k-mer's occurrence number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points += np.uint64(1)
    if not len(points):
        return points, points
    if len(points) < K:
        power = np.uint64(1)
        digest = np.zeros(1, np.uint64)
        for p in points:
            digest = digest * _BASE + p
    else:
        digest, power, width = points, _BASE, 1
        while width < K:
            digest = digest[:-width] * power + digest[width:]
            power = np.uint64(int(power) ** 2 % (1 << 64))
            width *= 2
    content = _mixed(digest)
    low = np.uint64((1 << len(content).bit_length()) - 1)
    runs = np.sort((content & ~low) | np.arange(len(content), dtype=np.uint64))
    place = (runs & low).astype(np.int64)
    new = np.ones(len(runs), bool)
    new[1:] = ((runs[1:] ^ runs[:-1]) & ~low) != 0
    index = np.arange(len(runs))
    first = np.maximum.accumulate(np.where(new, index, 0))
    numbered = np.empty(len(content), np.uint64)
    numbered[place] = (index - first).astype(np.uint64)
    numbered *= np.uint64(0xD6E8FEB86659FD93)
    numbered += content
    return content, _mixed(numbered)


def sketch(text: str) -> np.ndarray:
    """The fingerprint as ``SKETCHES`` numbers of 32 bits."""
    with np.errstate(over="ignore"):
        content, numbered = kmers(text)
        out = np.zeros(SKETCHES, np.uint64)
        if not len(content):
            return out.astype(np.uint32)
        taken = np.empty((SKETCHES, min(KEPT, len(content))), np.int64)
        order = np.empty_like(numbered)
        for i in range(SKETCHES):
            np.bitwise_xor(numbered, _XOR[i], out=order)
            np.multiply(order, _MULTIPLY[i], out=order)
            for j in range(taken.shape[1]):
                at = int(order.argmin())
                taken[i, j] = at
                order[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        taken.sort(axis=1)
        for j in range(taken.shape[1]):
            out = out * _BASE + content[taken[:, j]]
        return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def printed(numbers: np.ndarray) -> str:
    return numbers.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and the ``fingerprint`` of its whole text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([printed(sketch(t.as_py())) for t in batch.column(1)], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, utf8(F.col(text_col).cast("string")).alias("text")).mapInArrow(run, f"{id_col} {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order within a bucket; the copy that ends a bucket only serves as the next of the row before it."""
    waiting, rows = None, []

    def told(row, following: str, print_next: np.ndarray) -> tuple:
        doc_id, text, own = row
        changed = edited(text, following)
        other = own if changed == text else sketch(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), printed(own), printed(other), likeness(own, other), likeness(own, print_next)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    for batch in batches:
        buckets, copies, ids, texts = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            bucket, copy, text = buckets[i].as_py(), copies[i].as_py(), texts[i].as_py()
            own = None
            if waiting is not None and waiting[0] == bucket:
                own = sketch(text)
                rows.append(told(waiting[1], text, own))
                waiting = None
            if not copy:
                waiting = (bucket, (ids[i].as_py(), text, sketch(text) if own is None else own))
            if len(rows) >= 512:
                yield batch_of(rows)
                rows = []
    if rows:
        yield batch_of(rows)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edit_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (integer doc_id, text): its and its edited text's fingerprints and their likeness, and that to the next document."""
    text = utf8(F.col("text").cast("string"))
    smallest = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # descending order as ascending keys: ~id = -id - 1 has no overflow
    ordered = rows.withColumn("k1", F.bitwise_not(F.coalesce("doc_id", smallest))).withColumn("k0", F.col("doc_id").isNull().cast("int")).withColumn("k2", F.bitwise_not(F.xxhash64("text")))
    near = in_order(ordered, ["k0", "k1", "k2"], after=True, wrap=True)
    # within one key a copy comes last; a copy of a bucket's own first row (the only bucket of a ring) closes it
    lined = near.sortWithinPartitions("bucket", "copy", "k0", "k1", "k2").select("bucket", "copy", "doc_id", "text")
    return lined.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Exact removal of repeated byte strings with suffix arrays (linear grouping construction, ``suffix_array``).

A byte goes if a string of ``LENGTH`` bytes (a window) that covers it also starts earlier: in a smaller document, or before in the same one. Which
windows are equal is read from suffix arrays. For these the texts are cut so that equal windows meet in one small array, wherever they are:

1. Anchors. The anchor of a window is its ``GRAM``-byte string of least digest, the leftmost of equals: equal windows have equal anchors at equal
   places. Neighbouring windows share anchors, one for about 35 of them. An anchor seen in one place only has no repeated window: counts of
   anchors are the one pass over all data, 8-byte digests, combined before and joined back by digest.
2. Strings. What the windows of a repeated anchor cover is one string. Equal strings are one, with its first owner; all windows of the later
   owners start earlier at the first.
3. Suffix arrays. Different strings with one anchor form a group. Each group has a suffix array; windows that are equal stand next to each
   other in it, and all but the first owner's go. No two groups share a window.
4. Hot groups. A group of over ``GROUP`` different strings is split by more context: of the bytes that a window has beside the anchor, half lie to
   its left or to its right, so each of its windows goes to a group of the same longer left or right context; again, until groups are small. When
   the context is the window, equal keys are equal strings, so this ends after a few rounds at any number of strings, without a cut.

Rows with equal texts are one text with its smallest id as owner; of the others, each window starts earlier there.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes stay whole; null ids come first; rows that repeat id and text are one document and
get the same result; of two texts under one id the smaller digest comes first; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import drop_landed, landed, utf8
from stopfield.llm.suffix_array import suffix_arrays

LENGTH = 100
GRAM = 32
GROUP = 64
PIECE = 1 << 20
"""Bytes looked at at once when anchors are chosen; longer texts are taken in pieces that overlap by a window."""
BATCH = 1 << 21
"""Bytes of strings whose suffix arrays are built side by side."""

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_digests(raw: np.ndarray, size: int) -> np.ndarray:
    """Digest of the ``size`` bytes from each position."""
    bits, out, width, power = [], None, 0, _BASE
    level, span = raw.astype(np.uint64) + np.uint64(1), 1
    while span <= size:
        bits.append((level, span, power))
        if 2 * span <= size:
            level = level[:-span] * power + level[span:]
        span, power = 2 * span, np.uint64(int(power) ** 2 % (1 << 64))
    for level, span, power in reversed(bits):
        if size & span:
            if out is None:
                out = level[: len(raw) - size + 1].copy() if span == size else level
            else:
                out = out[: len(raw) - size + 1] * power + level[width : width + len(raw) - size + 1]
            width += span
    return _mixed(out[: len(raw) - size + 1])


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor, of texts that lie between ``bounds`` in ``raw``: text, first window, number of windows, place of
    the anchor (both counted in the text) and the anchor's digest."""
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.astype(np.uint64)
    digest = gram_digests(raw, gram)
    place = np.arange(len(digest), dtype=np.uint64)
    least = (digest & ~np.uint64((1 << 24) - 1)) | place  # the piece is shorter than 2^24
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(raw) - length + 1], least[span - width : span - width + len(raw) - length + 1])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int8)
    sizes = np.diff(bounds)
    has = np.nonzero(sizes >= length)[0]
    valid[bounds[has]] += 1
    valid[bounds[has + 1] - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    start = np.nonzero(fresh)[0]
    text = np.searchsorted(bounds, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], len(at)), bounds[text + 1] - length + 1)
    return text, start - bounds[text], stop - start, at[start] - bounds[text], digest[at[start]]


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts behind each other in runs of about ``PIECE`` bytes: bytes, bounds, the rows, and where in the row each part starts."""
    parts, rows, offsets, size = [], [], [], 0

    def emit():
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), np.array(rows), np.array(offsets)

    for row, text in enumerate(texts):
        for start in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[start : start + PIECE + LENGTH - 1]
            parts.append(part)
            rows.append(row)
            offsets.append(start)
            size += len(part)
            if size >= PIECE:
                yield emit()
                parts, rows, offsets, size = [], [], [], 0
    if parts:
        yield emit()


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py().encode("utf-8", "surrogatepass") for x in batch.column(1)]
        for raw, bounds, rows, offsets in _pieces(texts):
            text, first, number, place, digest = anchors(raw, bounds)
            at = (first + offsets[text]) << 16 | (place - first) << 8 | number
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), batch.column(0).take(pa.array(rows[text])), pa.array(at)], ["k", "h", "at"])


def _cut_strings(kind: str):
    """Rows h, d, text and places: the strings of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _STRING_NAMES]
            for h, d, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                for k, at in ((p["k"], p["at"]) for p in places):
                    first, place, number = at >> 16, at >> 8 & 255, at & 255
                    for c, v in zip(columns, (k, d, h, first, number, place, GRAM, data[first : first + number + LENGTH - 1])):
                        c.append(v)
            for start in range(0, len(columns[0]), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 14)], t) for c, t in zip(columns, _string_types(batch.schema.field(1).type))], _STRING_NAMES)

    return run


_STRING_NAMES = ["k", "d", "h", "first", "number", "place", "context", "bytes"]


def _string_types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _string_schema(kind: str) -> str:
    return f"k long, d {kind}, h long, first long, number int, place int, context int, bytes binary"


def _split_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of hot groups as at most two each: windows that hold half of the rest of the context to the left of it, and the others."""
    for batch in batches:
        columns: list[list] = [[] for _ in _STRING_NAMES]
        for k, d, h, first, number, place, context, data in zip(*(c.to_pylist() for c in batch.columns)):
            more = (LENGTH - context + 1) // 2
            left = min(number, max(0, place - more + 1))  # windows that start early enough
            for a, n, p in ((0, left, place - more), (left, number - left, place - left)):
                if n > 0:
                    part = data[a : a + n + LENGTH - 1]
                    side = b"l" if a == 0 and n == left and left > 0 else b"r"
                    digest = hashlib.blake2b(part[p : p + context + more], digest_size=8, key=side + bytes([context]) + k.to_bytes(8, "little", signed=True)).digest()
                    for c, v in zip(columns, (int.from_bytes(digest, "little", signed=True), d, h, first + a, n, p, context + more, part)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _string_types(batch.schema.field(1).type))], _STRING_NAMES)


def later_windows(groups: list[list[tuple[bytes, int]]]) -> list[np.ndarray]:
    """For each string of each group (bytes, number of windows; owners in order) whether each window also is in an earlier string."""
    strings = [s for g in groups for s in g]
    sizes = np.array([len(s) + 1 for s, _ in strings])
    raw = np.frombuffer(b"".join(s + b"\0" for s, _ in strings), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    symbols = raw.astype(np.int64) + 1
    symbols[starts[1:] - 1] = 0  # between the strings of a group
    per_group = np.array([len(g) for g in groups])
    order = suffix_arrays(symbols, starts[np.concatenate([[0], np.cumsum(per_group)])])
    string = np.repeat(np.arange(len(strings)), sizes)
    number = np.array([n for _, n in strings])
    is_window = np.arange(len(raw)) - starts[string] < number[string]
    order = order[is_window[order]]
    view = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(LENGTH, np.uint8)), LENGTH)
    group = np.repeat(np.arange(len(groups)), per_group)[string[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = group[1:] != group[:-1]
    for at in range(1, len(order), 1 << 15):
        a, b = order[at - 1 : at - 1 + (1 << 15)], order[at : at + (1 << 15)]
        fresh[at : at + len(b)] |= (view[a[: len(b)]] != view[b]).any(axis=1)
    heads = np.nonzero(fresh)[0]
    owner = string[order]
    earliest = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(order)))) if len(order) else owner
    later = np.zeros(len(raw), bool)
    later[order] = owner > earliest
    return [later[a : a + n] for a, n in zip(starts[:-1], number)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def _search_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by group and owner: (h, d, start, stop), the bytes that later windows cover at the strings' first owners."""

    def search(groups: list[list[tuple]]) -> pa.RecordBatch | None:
        found = later_windows([[(row[5], row[4]) for row in g] for g in groups])
        out = [(row[2], row[1], row[3] + a, row[3] + b + LENGTH - 1) for row, flags in zip((row for g in groups for row in g), found) if flags.any() for a, b in _runs(flags)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), id_type, pa.int64(), pa.int64()))], ["h", "d", "start", "stop"])

    groups, size, id_type = [], 0, None
    for batch in batches:
        id_type = batch.schema.field(1).type
        for row in zip(*(c.to_pylist() for c in batch.columns)):  # k, d, h, first, number, bytes
            if groups and groups[-1][0][0] == row[0]:
                groups[-1].append(row)
            else:
                if size >= BATCH:
                    groups, done = [], groups
                    size = 0
                    if (result := search(done)) is not None:
                        yield result
                groups.append([row])
            size += len(row[5]) + 1
    if groups and (result := search(groups)) is not None:
        yield result


def covered_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` has d, h, g (digests) and t. Spans (h, d, start, stop) to remove from each distinct text, and (h, g, owner), its smallest id."""
    kind = dict(docs.dtypes)["d"]
    owners = landed(docs.groupBy("h", "g").agg(F.min(F.struct("d")).alias("o")).select("h", "g", F.col("o.d").alias("owner")))
    found = landed(docs.select("h", "t").mapInArrow(_find_anchors, "k long, h long, at long"), "zstd")
    # an anchor is repeated if it is seen in two places; copies of a text are one place
    place = F.xxhash64("h", "at")
    repeated = found.groupBy("k").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select(F.col("k").alias("r"))
    kept = landed(found.join(repeated, F.col("k") == F.col("r"), "left_semi"), "zstd")
    drop_landed(found)
    places = kept.groupBy("h").agg(F.collect_set(F.struct("k", "at")).alias("places")).withColumnRenamed("h", "ph")
    ours = owners.join(places, F.col("h") == F.col("ph")).select("ph", "g", "owner", "places").withColumnRenamed("g", "pg")
    texts = docs.select("h", "g", "d", "t").join(ours, (F.col("h") == F.col("ph")) & (F.col("g") == F.col("pg")) & F.col("d").eqNullSafe(F.col("owner"))).select("h", "d", "t", "places")
    strings = landed(texts.mapInArrow(_cut_strings(kind), _string_schema(kind)), "zstd")
    drop_landed(kept)

    spans = []
    while True:
        owner = F.struct("d", "h", "first")
        digest = [F.xxhash64("bytes").alias("f"), F.xxhash64("bytes", F.lit(9)).alias("e")]
        marked = strings.select(*_STRING_NAMES, *digest)
        distinct = landed(marked.groupBy("k", "f", "e").agg(F.min(owner).alias("o"), F.count(F.lit(1)).alias("owners"), F.first("number").alias("number"), F.first("place").alias("place"), F.first("context").alias("context"), F.first("bytes").alias("bytes")), "zstd")
        again = distinct.filter("owners > 1").select(F.col("k").alias("ok"), F.col("f").alias("of"), F.col("e").alias("oe"), "o")
        later = marked.select("k", "f", "e", "d", "h", "first", "number").join(again, (F.col("k") == F.col("ok")) & (F.col("f") == F.col("of")) & (F.col("e") == F.col("oe"))).filter(~owner.eqNullSafe(F.col("o")))
        spans.append(landed(later.select("h", "d", F.col("first").alias("start"), (F.col("first") + F.col("number") + LENGTH - 1).alias("stop"))))
        sizes = distinct.groupBy("k").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1").withColumnRenamed("k", "sk")
        several = distinct.join(sizes, F.col("k") == F.col("sk")).select("k", "o.d", "o.h", "o.first", "number", "place", "context", "bytes", "strings")
        rows = several.filter(F.col("strings") <= GROUP).select("k", "d", "h", "first", "number", "bytes")
        sorted_groups = rows.repartition("k").sortWithinPartitions("k", F.col("d").asc_nulls_first(), "h", "first")
        spans.append(landed(sorted_groups.mapInArrow(_search_groups, f"h long, d {kind}, start long, stop long")))
        hot = landed(several.filter(F.col("strings") > GROUP).select(*_STRING_NAMES).mapInArrow(_split_strings, _string_schema(kind)), "zstd")
        if hot.isEmpty():
            break
        alone = hot.groupBy("k").agg(F.min(F.xxhash64("d", "h", "first")).alias("a"), F.max(F.xxhash64("d", "h", "first")).alias("b")).filter("a <> b").select(F.col("k").alias("r"))
        strings = landed(hot.join(alone, F.col("k") == F.col("r"), "left_semi"), "zstd")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out, owners


def cut_text(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left of the bytes, how many go, and the maximal runs that go."""
    runs: list[list[int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    left, at = [], 0
    for start, stop in runs:
        left.append(data[at:start])
        at = stop
    left.append(data[at:])
    return b"".join(left), sum(b - a for a, b in runs), [tuple(r) for r in runs]


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, text, copy, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
            data = text.encode("utf-8", "surrogatepass")
            if copy:
                found = [(0, len(data))] if len(data) >= LENGTH else []
            else:
                found = [(s["start"], s["stop"]) for s in spans or []]
            left, gone, runs = cut_text(data, found)
            rows.append((d, len(data), gone, len(runs), hashlib.sha256(left).hexdigest(), left, [{"start": a, "stop": b} for a, b in runs]))
        types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        columns = zip(*rows) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def repeats_removed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, ``kept`` (the bytes left) and ``spans`` (start, stop)."""
    text = utf8(F.col("text").cast("string"))
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text, F.lit(1)).alias("h"), F.xxhash64(text, F.lit(2)).alias("g"), text.alias("t"))
    kind = dict(keyed.dtypes)["d"]
    spans, owners = covered_spans(keyed)
    lists = spans.groupBy("h", "d").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnsRenamed({"h": "sh", "d": "sd"})
    known = owners.join(lists, (F.col("h") == F.col("sh")) & F.col("owner").eqNullSafe(F.col("sd")), "left").select(F.col("h").alias("oh"), F.col("g").alias("og"), "owner", "spans")
    joined = keyed.join(known, (F.col("h") == F.col("oh")) & (F.col("g") == F.col("og")))
    rows = joined.select("d", "t", (~F.col("d").eqNullSafe(F.col("owner"))).alias("copy"), "spans")
    return rows.mapInArrow(_rebuild, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, stop: long>>")


def repeat_report(docs: DataFrame) -> DataFrame:
    """``repeats_removed`` without bytes and spans."""
    return repeats_removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

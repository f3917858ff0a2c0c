"""Runs of words that repeat with a period, by an online dynamic programme over sparse diagonals.

A diagonal is a lag: place i lies on diagonal d when the word d places before it is the same. Words are read in order; the earlier occurrences of
a word lengthen the matches of the lags that are active or open new ones, and a diagonal that is not met again ends there: if its match is long
enough, the run is emitted at once. A run of period q and length m + q is a match of m words on diagonal q.

What keeps the diagonals sparse, without losing a run:

* A run needs a match of at least max(q, 12 - q) words. An earlier occurrence at a lag from L to 2L therefore counts only where the last L words
  agree as well (L = 6, 12, 24, ...; the first level takes lags from 1). These windows are named by 64-bit digests, doubled from level to level;
  places whose window occurs once are left out, so ordinary prose ends after the first level.
* Inside a run of period p that an earlier level found, windows of L >= 2p words recur every p places. Lags to those are multiples of p, end where
  the run ends and are never the smallest period, so they are passed over: a text of one repeated word costs n log n, not n squared.

A multiple of p that a level still meets spans the same words as the run of p, which is kept. Texts built to hold quadratically long matches
(neighbouring powers of a short word at all lengths) cost what these matches are long.

Defined cases: a null or empty text has no words and no runs; words are cut at space, tab and U+000A to U+000D; repeated rows get equal results; a
null id counts as the empty text in ``looped_words``; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
"""A run has at least so many words, and at least two periods."""
FIRST_WINDOW = LEAST_WORDS // 2
BATCH_WORDS = 1 << 18
"""Words of many documents worked on at once; changes no result."""
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SLOTS = 22


def split_words(doc_id: object, text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def looped_words(doc_id: object, text: str | None) -> list[bytes]:
    """The words, where every tenth document (by crc32 of its id) repeats a stretch of its own words from some place to its end."""
    words = split_words(doc_id, text)
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _repeated(names: np.ndarray) -> np.ndarray:
    """Indices of names that occur more than once, by name and then in order."""
    slot = (names >> np.uint64(64 - _SLOTS)).astype(np.int64)
    some = np.nonzero(np.bincount(slot, minlength=1 << _SLOTS)[slot] > 1)[0] if len(names) > 1 << (_SLOTS - 6) else np.arange(len(names))
    some = some[np.argsort(names[some], kind="stable")]
    same = names[some[1:]] == names[some[:-1]]
    both = np.zeros(len(some), bool)
    both[1:] |= same
    both[:-1] |= same
    return some[both]


def _occurrences(names: np.ndarray, at: np.ndarray, low: int, high: int, window: int, runs: dict) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag), by place, of the earlier occurrences of each window at a lag from ``low`` to ``high`` - 1. ``at`` are the places in order of
    name and place; occurrences at a multiple of the period of a known run that holds both windows are passed over."""
    skip = np.zeros(len(at), np.int64)
    if runs:
        start, period = np.full(int(at.max()) + 1, -1), np.ones(int(at.max()) + 1, np.int64)
        for (s, length), p in runs.items():
            if 2 * p <= window <= length:
                start[s + window - 1 : s + length], period[s + window - 1 : s + length] = s, p
        inside = start[at] >= 0
        skip[inside] = (at[inside] - start[at[inside]] - window + 1) // period[at[inside]]
    places, lags = [], []
    here, back = np.arange(len(at)), skip + 1
    while len(here):
        there = here - back[here]
        near = (there >= 0) & (names[here] == names[there])
        here, there = here[near], there[near]
        lag = at[here] - at[there]
        near = lag < high
        here, lag = here[near], lag[near]
        far = lag >= low
        places.append(at[here[far]])
        lags.append(lag[far])
        back[here] += 1
    place, lag = np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(lags or [np.zeros(0, np.int64)])
    order = np.argsort(place, kind="stable")
    return place[order], lag[order]


def _diagonals(place: np.ndarray, lag: np.ndarray, window: int, runs: dict) -> None:
    """Read the places in order: lags met again grow by one word, new ones start with the window, those not met again end and emit."""
    active: dict[int, int] = {}

    def end(d: int, match: int, last: int) -> None:
        if match >= max(d, LEAST_WORDS - d):
            key = (last - match - d + 1, match + d)
            runs[key] = min(d, runs.get(key, d))

    before, met = -2, {}
    for i, d in zip(place.tolist(), lag.tolist()):
        if i != before:
            for old, match in active.items():
                end(old, match, before - 1)
            if i != before + 1:
                for old, match in met.items():
                    end(old, match, before)
                met = {}
            active, met, before = met, {}, i
        met[d] = active.pop(d, window - 1) + 1
    for found in (active, met):
        for old, match in found.items():
            end(old, match, before - (found is active))


def batch_runs(ids: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], int]:
    """Runs of the documents whose word numbers lie behind each other in ``ids``, cut at ``bounds``: (first word, words) -> smallest period."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    runs: dict[tuple[int, int], int] = {}
    with np.errstate(over="ignore"):
        word = _mixed(ids.astype(np.uint64) * _MIX[0] + _MIX[1])
        name = word.copy()
        for i in range(1, FIRST_WINDOW):
            name[i:] = _mixed(name[i:] * _MIX[0] + word[: len(word) - i])
        name = _mixed(name + doc.astype(np.uint64) * _MIX[0])
        place_in = np.arange(len(ids)) - bounds[doc]
        window, at = FIRST_WINDOW, np.nonzero((place_in >= FIRST_WINDOW - 1) & (sizes[doc] >= LEAST_WORDS))[0]
        while len(at):
            at = at[_repeated(name[at])]
            if not len(at):
                break
            place, lag = _occurrences(name[at], at, 1 if window == FIRST_WINDOW else window, 2 * window, window, runs)
            _diagonals(place, lag, window, runs)
            seen = np.zeros(len(ids), bool)
            seen[at] = True
            at = np.sort(at)
            at = at[(place_in[at] >= 2 * window - 1) & (sizes[doc[at]] >= 4 * window)]
            at = at[seen[at - window]]
            longer = np.zeros_like(name)
            longer[at] = _mixed(_mixed(name[at] * _MIX[0]) + name[at - window])
            name, window = longer, 2 * window
    return runs


def _worked(words_of: Callable):
    def emit(docs: list[list[bytes]]) -> tuple:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        sizes = [len(w) for w in docs]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        numbers = np.concatenate([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in docs])
        runs = batch_runs(numbers, bounds)
        of = sorted((s, n, p) for (s, n), p in runs.items())
        doc = np.searchsorted(bounds, [r[0] for r in of], side="right") - 1
        gone: dict[int, np.ndarray] = {}
        lists: dict[int, list] = {}
        for k, (s, n, p) in zip(doc.tolist(), of):
            first = s - int(bounds[k])
            lists.setdefault(k, []).append({"start": first, "length": n, "period": p})
            gone.setdefault(k, np.zeros(sizes[k], bool))[first + p : first + n] = True
        left = [b" ".join(w if k not in gone else [w[i] for i in np.nonzero(~gone[k])[0].tolist()]) for k, w in enumerate(docs)]
        return sizes, [lists.get(k, []) for k in range(len(docs))], left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            begin = 0
            while begin < len(batch):
                docs, total, end = [], 0, begin
                while end < len(batch) and (total < BATCH_WORDS or end == begin):
                    docs.append(words_of(ids[end].as_py(), texts[end].as_py()))
                    total += len(docs[-1])
                    end += 1
                sizes, runs, left = emit(docs)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(runs, runs_type), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
                )
                begin = end

    return run


def periodic_runs(docs: DataFrame, words_of: Callable[[object, str | None], list[bytes]] = split_words) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, ``runs`` (start, length, smallest period; by start, then length) and ``collapsed``, the
    words that no run repeats after its first period, joined by one space. Nothing is shuffled; a document is one task's work."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_worked(words_of), schema)


def _listed(runs: Column) -> Column:
    """One line per run, by start and then period."""
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct(r["start"].alias("s"), r["period"].alias("p"), r["length"].alias("n"))))
    return F.array_join(F.transform(ordered, lambda r: F.concat(r["s"], F.lit(","), r["n"], F.lit(","), r["p"], F.lit("\n"))), "")


def run_report(docs: DataFrame) -> DataFrame:
    """The digests of ``periodic_runs`` over documents of which every tenth has looped words, and the longest run of each."""
    found = periodic_runs(docs, looped_words)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(1000 * -best.n) div best.p").alias("exponent_milli"),
        F.sha2(_listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )

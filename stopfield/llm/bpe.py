"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts as one state that loops on every byte, and each merge (u, v -> uv) in order adds its gadget: wherever an
arc u leads to a state with an arc v, a new arc uv leads past both, and the state behind u loses its arc v. The state behind a token then
depends on the token alone, so the automaton is: one state per token, and the arcs it has lost. Behind uv the arcs are those behind v at that
time; a state without arc u gets no arc uv. Both are inheritance, so the gadgets are kept as tables (halves and time of each token, merges by
pair) and an arc is looked up by walking the halves back in time, newest first; each looked-up arc is stored in the transition table. The paths
of the finished automaton are exactly the token sequences that merging yields, one for each byte string.

Texts are cut at special tokens and pre-split into words; a word's path is found left to right by table lookups: at each byte position the one
state in which the bytes so far end. Many words step together in numpy; words over ``LONG`` bytes step alone, by the same tables. A bounded
cache keeps the paths of words, and of what stands between spaces: a space before another character always begins a word, so a text
without runs that a space continues is cut there first. Decoding emits the bytes of each arc label.

Defined cases: a null text is encoded as the empty one (no tokens); invalid UTF-8 in decoded bytes becomes U+FFFD; ids that the vocabulary
does not have raise; any length of text or word works; repeated rows and ids keep their rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import bounded_batches

LONG = 32
CACHE_WORDS = 200_000
"""Strings whose paths a worker keeps; beyond, it starts anew. Bounds memory, changes no result."""
ARC_SLOTS = 1 << 19
SLICE_BYTES = 1 << 20
"""Bytes of text encoded at once: bounds the tables that are made for its new words, changes no result."""

# Fixed value: the published pattern that pre-splits words for this kind of vocabulary.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PRE_SPLIT)
_RUN = re.compile(r"\s (?:\s|\Z)")
"""White space that goes on around a space: there the words are not cut at the space."""
_NEWER = regex.compile(r"[^\u0000-՗‐-⁞ぁ-ゖァ-ヺ一-龥가-힣]")
"""Characters outside of ranges that no version of Unicode since 6 has changed: texts with one are pre-split by the tokenizers library, so
that both agree on letters added to Unicode later."""


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, the others for 256, 257, ... in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Slots:
    """Integer keys to integer values in open addressing, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(8, int(4 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        left = np.arange(len(keys))
        spot = self._spot(keys)
        while len(left):
            free = self.keys[spot] == -1
            self.keys[spot[free]] = keys[left[free]]  # of several at one spot the last stays
            won = self.keys[spot] == keys[left]
            self.values[spot[won]] = values[left[won]]
            left, spot = left[~won], (spot[~won] + 1) & self.mask

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(24)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        spot = self._spot(keys)
        seen = self.keys[spot]
        out = np.where(seen == keys, self.values[spot], -1)
        todo = np.nonzero((seen != keys) & (seen != -1))[0]
        while len(todo):
            spot[todo] = (spot[todo] + 1) & self.mask
            seen = self.keys[spot[todo]]
            out[todo] = np.where(seen == keys[todo], self.values[spot[todo]], -1)
            todo = todo[(seen != keys[todo]) & (seen != -1)]
        return out


class Automaton:
    """The compiled tables of one vocabulary file (the JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.source, self._library = source, None
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes | None] = [None] * self.size
        for word, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.labels[i] = word.encode()
        self.widths = np.array([len(x or b"") for x in self.labels])
        self.start = self.size  # the state before any token: all arcs
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        self.time = np.zeros(self.size + 1, np.int64)
        pairs, ranks = [], []
        for rank, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            pairs.append(u * self.size + v)
            ranks.append(rank)
            self.left[uv], self.right[uv], self.time[uv] = u, v, rank
        self.merges = _Slots(np.array(pairs, np.int64), np.array(ranks, np.int64))
        self.arcs = np.full(ARC_SLOTS, -1, np.int64)
        self._trie(vocab)
        self._forget()

    def _trie(self, vocab: dict[str, int]) -> None:
        """Steps (node, byte) -> node over the labels of all arcs, and the token that ends at a node. A special token is no arc of a word.

        Node 0 is the root and node b + 1 stands behind the single byte b; the steps from these are a dense table, the others are hashed.
        """
        self.steps: dict[int, int] = {b: b + 1 for b in range(256)}
        ends = [-1] * 257
        for i in vocab.values():
            if i in self.special.values():
                continue
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                node = self.steps.get(key, -1)
                if node < 0:
                    node = self.steps[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        keys, values = np.fromiter(self.steps.keys(), np.int64), np.fromiter(self.steps.values(), np.int64)
        self.dense = np.full(257 << 8, -1, np.int64)
        self.dense[keys[keys < 257 << 8]] = values[keys < 257 << 8]
        self.step = _Slots(keys[keys >= 257 << 8], values[keys >= 257 << 8])

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.offsets, self.paths = np.zeros(1, np.int64), np.empty(0, np.int32)

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state behind ``state`` has the arc ``token``: from the transition table, else from the gadgets."""
        key = state * self.size + token
        slot = ((key * np.int64(0x2545F4914F6CDD1D)) >> np.int64(30)) & (ARC_SLOTS - 1)
        kept = self.arcs[slot]
        out = (kept & 1) == 1
        new = np.nonzero((kept >> 1) != key)[0]
        if len(new):
            out[new] = self._walk_gadgets(state[new], token[new])
            self.arcs[slot[new]] = key[new] << 1 | out[new]
        return out

    def _walk_gadgets(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """An arc x behind w is lost if some merge joins the end of w with the start of x before either was made.

        Of the pair the newer token is replaced by its half at the border, back at the time it was made. Merging u with u is the one
        gadget that takes its own arc along: behind u there is no uu, hence the limit that includes the merge.
        """
        kept = np.ones(len(w), bool)
        todo = np.nonzero(w != self.start)[0]
        w, x, limit = w[todo], x[todo], np.full(len(todo), np.iinfo(np.int64).max)
        while len(todo):
            rank = self.merges.get(w * self.size + x)
            lost = (rank > 0) & (rank < limit)
            kept[todo[lost]] = False
            tw, tx = self.time[w], self.time[x]
            on = ~lost & ((tw > 0) | (tx > 0))
            todo, w, x, tw, tx = todo[on], w[on], x[on], tw[on], tx[on]
            limit = np.where(tx > tw, tx + 1, tw)
            w, x = np.where(tw >= tx, self.right[w], w), np.where(tx >= tw, self.left[x], x)
        return kept

    def _path_long(self, word: bytes) -> list[int]:
        last, one = [-1] * (len(word) + 1), np.empty(1, np.int64)
        last[0] = self.start
        memo: dict[tuple[int, int], bool] = {}
        for i in range(len(word)):
            node = 0
            for j in range(i, len(word)):
                node = self.steps.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                token = int(self.ends[node])
                if token >= 0 and last[j + 1] < 0:
                    pair = (last[i], token)
                    if pair not in memo:
                        memo[pair] = bool(self.has_arc(one * 0 + last[i], one * 0 + token)[0])
                    if memo[pair]:
                        last[j + 1] = token
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at -= len(self.labels[last[at]])
        return path[::-1]

    def _paths_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and, one behind the other, the paths of words of 1 to ``LONG`` bytes. The longer words are the first lanes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        longest = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(longest + 1), side="left")  # lanes of words of more than i bytes
        data = np.zeros((longest, len(words)), np.int64)
        flat = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        rows = np.repeat(np.arange(len(words)), lengths)
        data[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows] = flat
        last = np.full((longest + 1, len(words)), -1, np.int64)
        last[0] = self.start
        for i in range(longest):
            node = self.dense[data[i, : live[i]]]
            lanes = np.arange(live[i])
            for j in range(i, longest):
                if j > i:
                    go = lanes[: np.searchsorted(lanes, live[j])]
                    key = node[: len(go)] << 8 | data[j, go]
                    node = self.dense[key] if j == i + 1 else self.step.get(key)
                    keep = np.nonzero(node >= 0)[0]
                    lanes, node = go[keep], node[keep]
                    if not len(lanes):
                        break
                token, behind = self.ends[node], last[j + 1]
                ask = np.nonzero((token >= 0) & (behind[lanes] < 0))[0]
                if len(ask):
                    at, token = lanes[ask], token[ask]
                    fits = self.has_arc(last[i, at], token)
                    behind[at[fits]] = token[fits]
        path, counts, at, lanes = np.full((len(words), longest), -1, np.int32), np.zeros(len(words), np.int64), lengths.copy(), np.arange(len(words))
        while len(lanes):
            token = last[at[lanes], lanes]
            counts[lanes] += 1
            path[lanes, longest - counts[lanes]] = token
            at[lanes] -= self.widths[token]
            lanes = lanes[at[lanes] > 0]
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        path, counts = path[back], counts[back]
        return counts, path[path >= 0]

    def _store(self, counts: np.ndarray, parts: list[np.ndarray]) -> int:
        """Keep paths; the number of the first."""
        base = len(self.offsets) - 1
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        self.paths = np.concatenate([self.paths, *parts])
        return base

    def _learn(self, words: list[str]) -> None:
        """Find and keep the paths of words."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [w for w, c in zip(words, coded) if len(c) <= LONG]
        if short:
            counts, path = self._paths_short([c for c in coded if len(c) <= LONG])
            base = self._store(counts, [path])
            self.words.update(zip(short, range(base, base + len(short))))
        if len(short) < len(words):
            long = [(w, np.array(self._path_long(c), np.int32)) for w, c in zip(words, coded) if len(c) > LONG]
            base = self._store(np.array([len(p) for _, p in long]), [p for _, p in long])
            self.words.update((w, base + i) for i, (w, _) in enumerate(long))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the paths ``at`` and the paths, one behind the other."""
        begin = self.offsets[at]
        count = self.offsets[at + 1] - begin
        place = np.repeat(begin - (np.cumsum(count) - count), count)
        place += np.arange(len(place))
        return count, self.paths[place]

    def _paths_of(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_gather``, for lists of words."""
        flat = [w for words in split for w in words]
        new = [w for w in dict.fromkeys(flat) if w not in self.words]
        if new:
            self._learn(new)
        count, path = self._gather(np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat)))
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(words) for words in split])]
        return np.diff(ends, prepend=0), path

    def split(self, text: str) -> list[str]:
        if _NEWER.search(text) is None:
            return _WORDS.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) + len(self.words) > CACHE_WORDS:
            self._forget()
        strings: list[str] = []  # what stands between the spaces of all texts; after a space of its own the start of a text, which has none before it
        odd: list[tuple[int, list]] = []
        bounds = [0]
        for n, text in enumerate(texts):
            special = self.cut is not None and any(s in text for s in self.special)
            if special or _RUN.search(text) or _NEWER.search(text):
                pieces = self.cut.split(text) if special else [text]
                odd.append((n, [self.special[p] if p in self.special else self.split(p) for p in pieces if p]))
            elif text:
                between = text.split(" ")
                between[0] = " " + between[0]
                strings += between
            bounds.append(len(strings))
        at = list(map(self.known.get, strings))
        new = list(dict.fromkeys(x for x, i in zip(strings, at) if i is None))
        if new:
            count, path = self._paths_of([_WORDS.findall(x[1:] if x[:1] == " " else " " + x) for x in new])
            base = self._store(count, [path])
            self.known.update(zip(new, range(base, base + len(new))))
            at = list(map(self.known.__getitem__, strings))
        count, path = self._gather(np.array(at, np.int64))
        ends = np.concatenate([[0], np.cumsum(count)])[bounds]
        out = [path[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for n, pieces in odd:
            out[n] = np.concatenate([np.empty(0, np.int32), *[np.array([p], np.int32) if isinstance(p, int) else self._paths_of([p])[1] for p in pieces]])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _compiled(source: str) -> Automaton:
    return Automaton(source)


def _shipped(df: DataFrame, vocabulary: str):
    """The vocabulary file, read once where the query is built and sent to the executors (its size is the vocabulary's)."""
    bounded_batches(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[tuple[int, int, list]]:
    """Rows of a batch in runs of at most ``most`` bytes of text (or one longer text). Only the texts of a run are Python strings at a time."""
    most = SLICE_BYTES if most is None else most
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, more in enumerate(sizes.tolist()):
        if size + more > most and i > start:
            yield start, i, batch.column(column)[start:i].to_pylist()
            start, size = i, 0
        size += more
    if start < len(sizes):
        yield start, len(sizes), batch.column(column)[start:].to_pylist()


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids``, the tokens of the text."""
    tables, kind = _shipped(docs, vocabulary), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(tables.value)
        for batch in batches:
            for a, b, texts in _slices(batch, 1):
                ids = automaton.encode([t or "" for t in texts])
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], [id_col, "ids"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``text``, what the tokens stand for; null ids give an empty text."""
    tables, kind = _shipped(tokens, vocabulary), dict(tokens.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(tables.value)
        for batch in batches:
            texts = [automaton.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} {kind}, text string")


def _digested(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    tables, kind = _shipped(docs, vocabulary), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(tables.value)
        names = [str(i) for i in range(automaton.size)]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for a, b, texts in _slices(batch, 1):
                counts, of_ids, of_texts = [], [], []
                paths = automaton.encode([t or "" for t in texts])
                for path in paths:
                    ids = path.tolist()
                    counts.append(len(ids))
                    of_ids.append(sha(",".join(map(names.__getitem__, ids)).encode()))
                    of_texts.append(sha(automaton.decode(ids).encode()))
                columns = [batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(paths).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them, in one pass."""
    return _digested(docs, vocabulary, id_col, text_col, with_ids=False)


def token_rows(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``token_digests`` with the ids."""
    return _digested(docs, vocabulary, id_col, text_col, with_ids=True)

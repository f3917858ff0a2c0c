"""Language identification by mixture inference: expectation-maximisation of language shares from n-gram likelihoods, sets by penalised likelihood.

A text is its words (runs of letters, lower-cased). Each letter and its two neighbours in the word, or the word's edge, are one trigram; a
language's trigram probabilities are counted over all labelled texts and smoothed by ``SMOOTHING``. A word is written in one language, whose
likelihood is the product of its trigrams'; a document mixes languages with shares that expectation-maximisation estimates from its words.
The set of languages grows from the best single one in order of the shares under all languages, as long as the log-likelihood gains more
than ``PENALTY`` times the logarithm of the number of words. The prediction is the language of the greatest share in the set.

The counts are a table that grows with the corpus and never goes to the driver or to a broadcast. Documents are dealt to chunks of about
``CHUNK_BYTES`` once; the different trigrams of a chunk fetch their counts in an equality join, and chunk and counts meet again in a cogroup. Only
the list of languages with its totals is collected: one row for each label.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as are all where nothing is learned; null labels are not learned
from; of languages with equal shares the first by name is predicted; repeated rows get equal results; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import landed, shuffle_width, utf8

SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 15
UNKNOWN = "und"
CHUNK_BYTES = 8 << 20
BATCH_CHARS = 1 << 20
"""Characters counted or scored at once; changes no result."""
FOLDS, HELD_FOLD = 4, 2


def letters(text: Column) -> Column:
    """The words of a text, lower-cased, with one space between them; empty without a letter."""
    return F.trim(F.regexp_replace(F.lower(utf8(text.cast("string"))), r"[^\p{L}]+", " "))


def trigrams(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words between spaces (one at each end): the different trigrams, sorted, the index among them for each letter, and the letters' places."""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.nonzero(c != 32)[0]
    seen = np.zeros(int(c.max()) + 1, np.int64)
    seen[c] = 1
    symbols = np.nonzero(seen)[0]
    n = len(symbols)
    if n**3 > 1 << 22:
        values, index = np.unique((c[at - 1] << 42) | (c[at] << 21) | c[at + 1], return_inverse=True)
        return values, index, at
    seen[symbols] = np.arange(n)
    small = seen[c]
    dense = (small[at - 1] * n + small[at]) * n + small[at + 1]
    there = np.bincount(dense, minlength=n**3) > 0
    used = np.nonzero(there)[0]
    values = (symbols[used // (n * n)] << 42) | (symbols[used // n % n] << 21) | symbols[used % n]
    return values, (np.cumsum(there) - 1)[dense], at


def _batched(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    """The row numbers in lists of about ``BATCH_CHARS`` characters of text."""
    held, size = [], 0
    for i in rows:
        held.append(i)
        size += len(texts[i])
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: the trigram counts of the texts of each language (text, lang), once for about ``BATCH_CHARS`` characters."""
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}

    def emit(lang: str) -> pa.RecordBatch:
        values, index, _ = trigrams(" " + " ".join(held.pop(lang)) + " ")
        del sizes[lang]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(np.bincount(index, minlength=len(values)))], ["lang", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= 4 * BATCH_CHARS:
                yield emit(lang)
    for lang in list(held):
        yield emit(lang)


def learned(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over every text of ``training`` (text, lang) that has letters and a label."""
    rows = training.select(letters(F.col("text")).alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text <> ''")
    return rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, held = batch.column("text").to_pylist(), {}
        for i, chunk in enumerate(batch.column("chunk").to_pylist()):
            if texts[i]:
                held.setdefault(chunk, []).append(i)
        for chunk, rows in held.items():
            for part in _batched(rows, texts):
                values, _, _ = trigrams(" " + " ".join([texts[i] for i in part]) + " ")
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(values), pa.int64()), pa.array(values)], ["of", "gram"])


def _mixture(p: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of each document (words from ``starts``) from word likelihoods ``p`` up to a factor per word, by ``rounds`` of EM from equal shares."""
    sizes = np.diff(np.append(starts, len(p)))
    share = np.full((len(starts), p.shape[1]), 1 / p.shape[1])
    for _ in range(rounds):
        part = p * np.repeat(share, sizes, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
    return share


def language_sets(logs: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of each document, zero outside the chosen set, from the words' log-likelihoods (words x languages)."""
    docs, langs = len(starts), logs.shape[1]
    sizes = np.diff(np.append(starts, len(logs)))
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top) + 1e-30
    alone = np.add.reduceat(logs - top, starts, axis=0)
    full = _mixture(p, starts)
    rank = np.argsort(-full - 2 * (np.arange(langs) == alone.argmax(axis=1)[:, None]), axis=1, kind="stable")
    shares = np.zeros((docs, langs))
    shares[np.arange(docs), rank[:, 0]] = 1
    best, open_docs = alone.max(axis=1), np.arange(docs)
    for k in range(2, langs + 1):
        mine = np.repeat(np.isin(np.arange(docs), open_docs), sizes)
        n = sizes[open_docs]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        some = np.take_along_axis(p[mine], np.repeat(rank[open_docs, :k], n, axis=0), axis=1)
        share = _mixture(some, at)
        fit = np.add.reduceat(np.log((some * np.repeat(share, n, axis=0)).sum(axis=1)), at) - penalty * (k - 1) * np.log(n + 1)
        better = fit > best[open_docs]
        open_docs, share = open_docs[better], share[better]
        if not len(open_docs):
            break
        best[open_docs] = fit[better]
        shares[open_docs] = 0
        shares[open_docs[:, None], rank[open_docs, :k]] = share
    return shares


def _scored(names: list[str], totals: list[int], types: int):
    total = np.array(totals, float)

    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        grams, row = np.unique(counts.column("gram").to_numpy(), return_inverse=True)
        seen = np.zeros((len(grams) + 1, len(names)))
        np.add.at(seen, (row, counts.column("lang").to_numpy()), counts.column("n").to_numpy())
        table = np.log((seen + SMOOTHING) / (total + SMOOTHING * (types + 1)))
        texts = docs.column("text").to_pylist()
        pred, score, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
        known = [i for i, t in enumerate(texts) if t and len(names)]
        for part in _batched(known, texts):
            values, index, at = trigrams(" " + " ".join([texts[i] for i in part]) + " ")
            spot = np.searchsorted(grams, values)
            spot[np.append(grams, -1)[spot] != values] = len(grams)
            first = np.nonzero(np.diff(at, prepend=-2) > 1)[0]
            words = np.add.reduceat(table[spot][index], first, axis=0)
            starts = np.concatenate([[0], np.cumsum([texts[i].count(" ") + 1 for i in part])[:-1]])
            shares = language_sets(words, starts)
            for i, share in zip(part, shares):
                k = int(share.argmax())
                pred[i], score[i] = names[k], min(1.0, share[k])
                sets[i] = [{"lang": names[j], "share": float(share[j])} for j in np.argsort(-share, kind="stable") if share[j] > 0]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.table({"doc_id": docs.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": score, "languages": pa.array(sets, kind)})

    return run


def identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score (the share of that language) and ``languages``, the chosen set with its
    shares, greatest first. ``training`` has text and lang."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    counts = landed(learned(training))
    langs = sorted(counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect())
    names = [r.lang for r in langs]
    numbers = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int") - 1 if names else F.lit(0)
    model = counts.select("gram", numbers.alias("lang"), "n")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // CHUNK_BYTES))
    dealt = docs.select("doc_id", letters(F.col("text")).alias("text")).withColumn("chunk", chunk).repartition(shuffle_width(spark), "chunk")
    grams = dealt.mapInArrow(_chunk_grams, "of long, gram long").distinct()
    fetched = grams.join(model, "gram").select("of", "gram", "lang", "n")
    score = _scored(names, [r.n for r in langs], max([r.types for r in langs], default=0))
    schema = f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return dealt.groupBy("chunk").cogroup(fetched.groupBy("of")).applyInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_FOLD


def language_report(docs: DataFrame) -> DataFrame:
    """``identified`` for every document, learned from those that are not held out."""
    found = identified(docs.select("doc_id", "text"), docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")

"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 3
SEED = 42
CHUNK = 1 << 15
"""Shingles turned to bits at once: bounds the memory of a long text and changes no result."""


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is 1 if it is set in over half of the XXH64 digests of the text's shingles, repeats included.

    A-Z are lower-cased; words are cut at space, tab and U+000A to U+000D (what ``bytes.split`` cuts at); a text of fewer words than a
    shingle is one shingle; a text without words, or null, has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, len(grams), CHUNK):
        part = np.array([digest(g, seed) for g in grams[start : start + CHUNK]], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])

"""Seeded draws that depend only on the key, so a sample is the same under any partitioning and after a lost executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13


def digest(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from the leading digits of the digest."""
    return F.conv(F.substring(digest(key, seed), 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)


def bucket(key: Column, seed: int | str, n: int) -> Column:
    """One of ``n`` equally likely buckets."""
    return F.floor(uniform(key, seed) * n).cast("int")


def exponential(key: Column, seed: int | str) -> Column:
    """A draw from Exp(1)."""
    return -F.log1p(-uniform(key, seed))


def poisson_one(key: Column, seed: int | str) -> Column:
    """A draw from Poisson(1) by its distribution function, cut where less than 1e-10 is left."""
    u, total, term, out = uniform(key, seed), 0.0, 0.36787944117144233, None
    out = F.lit(0)
    for k in range(1, 13):
        total += term
        out = out + F.when(u >= total, 1).otherwise(0)
        term /= k
    return out

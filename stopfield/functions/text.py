"""Text expressions for names, tokens and delimited lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

# Words of agency names that say nothing about which agency it is.
STOP_WORDS = (
    "of", "the", "and", "city", "county", "town", "transit", "transportation", "authority", "district", "department", "dept", "board",
    "commissioners", "public", "system", "services", "service", "agency", "regional", "metropolitan", "metro", "corporation", "corp", "inc",
    "co", "dba", "area", "urban", "mass", "government", "commission", "rapid", "state", "dot", "llc", "benefit", "special",
)


def plain_lower(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def name_key(c: Column) -> Column:
    """Accent-free lower-case key with single spaces."""
    return F.trim(F.regexp_replace(plain_lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Safe file or feed name."""
    return F.regexp_replace(F.regexp_replace(plain_lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(c: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct words of two letters or more that are no stop words."""
    words = F.array_distinct(F.filter(F.split(name_key(c), " "), lambda w: F.length(w) > 1))
    return F.array_except(words, F.array(*[F.lit(s) for s in stop]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.when(union > 0, union), F.lit(0.0))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in order."""
    pattern = F.concat(F.lit("^.*"), F.regexp_replace(F.regexp_replace(short, "[^a-z0-9]", ""), "(.)", "$1.*"))
    return F.regexp_like(long, pattern)


def acronym(words: Column) -> Column:
    """First letters of an array of words."""
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def split_list(c: Column, mark: str = ";") -> Column:
    """Items of a delimited list, trimmed, blanks dropped, first mention kept."""
    items = F.transform(F.split(c, mark), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: F.length(x) > 0))


def join_list(items: Column, mark: str = ";") -> Column:
    return F.array_join(items, mark)


def geoid_level(geoid: Column, digits: int) -> Column:
    return F.substring(geoid, 1, digits)


def pad_code(c: Column, width: int) -> Column:
    """Left-pad a code with zeros, leaving longer codes whole."""
    s = F.trim(c.cast("string"))
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))

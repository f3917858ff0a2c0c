"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact join.

A listed entry is a host and a path prefix. It fits its host and all subdomains of it, for paths that start with its path. A URL's candidates
are therefore its host's suffixes at label borders with each prefix of its path whose length some entry has. The filter rules out nearly
all candidates where they are made; what passes meets the list in an equality join, which removes false positives. The longest entry wins.

The filter is one row of ``4 * blocks`` longs: each key sets one bit in each of the four words of its block. Its size is a parameter (32 bytes
a block, 128 KB by default) and does not grow with the list or the pages; a fuller filter lets more candidates through to the join and
changes no result.

Defined cases: null urls and urls without ``://`` have empty host and path and fit no entry; equal urls are judged once and each row gets the
verdict; repeated entries count once; of entries of one length the longer host wins, then block; no listed entry fits: ``default``; an empty
list or table works; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCKS = 4096
WORDS = 4


def _lower(host: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``? #`` or the end. Else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and for each word of the block the mask of its bit."""
    digest = F.xxhash64(key)
    spread = F.xxhash64(key, F.lit(3))
    return F.pmod(digest, F.lit(blocks)).cast("int"), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row ``filter``: the words of all blocks. ``keys`` has a column ``key``; at most one row per block leaves the aggregation."""
    block, masks = _place(F.col("key"), blocks)
    filled = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    words = F.array(*[F.col(f"w{i}") for i in range(WORDS)])
    packed = filled.agg(F.map_from_entries(F.collect_list(F.struct("block", words))).alias("filled"))
    none = F.array(*[F.lit(0).cast("long")] * WORDS)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    return packed.select(F.flatten(F.transform(every, lambda b: F.coalesce(F.element_at("filled", b), none))).alias("filter"))


def may_hold(filter_col: Column, key: Column, blocks: int = BLOCKS) -> Column:
    block, masks = _place(key, blocks)
    found = None
    for i, mask in enumerate(masks):
        hit = F.get(filter_col, block * WORDS + i).bitwiseAND(mask) != 0
        found = hit if found is None else found & hit
    return found


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """Per distinct url of ``pages``: url, host, path, ``rule`` (host and path of the entry that wins, or null) and ``verdict``.

    ``rules`` has host, path and verdict. The lengths of the entries' paths are one small distinct list (at most the longest path).
    """
    host, path = host_and_path(F.col("url"))
    listed = rules.select(_lower(F.col("host")).alias("rhost"), F.col("path").alias("rpath"), "verdict").groupBy("rhost", "rpath").agg(F.max("verdict").alias("rverdict")).withColumn("key", F.concat("rhost", "rpath"))
    lengths = listed.agg(F.sort_array(F.collect_set(F.length("rpath"))).alias("lengths"))
    urls = pages.select(F.col(url_col).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    one_row = F.broadcast(bloom(listed, blocks).crossJoin(lengths))
    parts = urls.crossJoin(one_row).select("url", "host", "path", "filter", F.when(F.col("host") != "", suffixes).otherwise(F.array().cast("array<string>")).alias("suffixes"), prefixes.alias("prefixes"))
    keys = F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: F.struct(s.alias("s"), p.alias("p")))))
    candidates = parts.select("url", "host", "path", "filter", F.explode_outer(keys).alias("c")).select("url", F.col("c.s").alias("s"), F.col("c.p").alias("p"), "filter")
    passed = candidates.filter(may_hold(F.col("filter"), F.concat("s", "p"), blocks)).select("url", "s", "p")
    hits = passed.join(listed, (F.col("s") == F.col("rhost")) & (F.col("p") == F.col("rpath")))
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), F.length("rhost").alias("m"), "rverdict", "key")).alias("best")).select(F.col("url").alias("burl"), "best")
    out = urls.join(best, F.col("url") == F.col("burl"), "left")
    return out.select("url", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rverdict", F.lit(default)).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule and verdict."""
    found = judged(pages, rules, default=default).withColumnRenamed("url", "jurl")
    rows = pages.select("page_id", "url")
    return rows.join(found, F.col("url").eqNullSafe(F.col("jurl"))).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT s.page_id, s.host, s.path, r.rhost || r.rpath AS rule, r.rverdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS nth
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE nth = 1
"""

"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import landed


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 5))")).first())


def _least(sides: DataFrame) -> DataFrame:
    """Per node ``u`` of (u, v): the least of itself and its neighbours. A minimum per key: combined before the shuffle."""
    return sides.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: longs, any direction, repeats allowed): the least node it is connected to.

    Each round hangs every node's larger neighbours on the least one it sees, then its smaller ones; stars remain and nothing changes. The
    number of rounds grows with the logarithm of the largest component; the loop ends only there. Only nodes and links are kept, nothing
    is collected; hot nodes meet in equality joins, which adaptive execution splits.
    """
    edges = landed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(_least(large), F.col("u") == F.col("w"))
        hung = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = landed(hung.filter("a <> b").distinct())
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))


def joined_groups(one: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, h, label) of the groups that the links of both tables make together; in each of them (doc_id, h, label) h decides the label."""
    node = lambda df, side: df.select("h", F.xxhash64(F.lit(side), "label").alias(side)).distinct()
    named = node(one, "a").join(node(other, "b"), "h")
    labels = components(named.select("a", "b"))
    of_text = node(one, "a").join(labels, F.col("a") == F.col("node")).select(F.col("h").alias("t"), F.col("label").alias("l"))
    return one.join(of_text, F.col("h") == F.col("t")).select("doc_id", "h", F.col("l").alias("label"))

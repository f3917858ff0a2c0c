"""Rows next to each other in a global order, without one task seeing all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopfield.llm.common import landed, shuffle_width

PER_BUCKET = 4
"""Keys sampled for each bucket when its bounds are chosen; the bounds decide where rows are worked on, never what comes out."""


def _bounds(only: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """One row with an array of less than ``parts`` keys that cut the order into like buckets, from a sample by key digest."""
    one_in = max(1, only.count() // (parts * PER_BUCKET))
    sample = only.filter(F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(one_in)) == 0)
    seen = sample.agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("k"))
    n = F.size("k")
    nth = F.transform(F.sequence(F.lit(1), F.lit(max(1, parts - 1))), lambda i: F.element_at("k", (F.floor(n * i / parts) + 1).cast("int")))
    cut = F.when(n >= parts, F.array_distinct(nth)).when(n > 1, F.slice("k", F.lit(2), n)).otherwise(F.slice("k", F.lit(1), F.lit(0)))
    return seen.select(cut.alias("_bounds"))


def in_order(df: DataFrame, keys: list[str], before: bool = False, after: bool = False, wrap: bool = False) -> DataFrame:
    """``df`` cut into buckets of the order of ``keys`` (no nulls), with ``bucket`` and ``copy``; sort by bucket and keys in each partition.

    Every bucket also gets a copy (``copy`` true) of the last row of the bucket before it (``before``) and of the first row of the one after
    it (``after``); with ``wrap`` the order is a ring. A bucket's rows lie together in one partition. There are at most four buckets for each shuffle
    partition; their bounds and end keys are small tables in the shared folder (one row, and two rows a bucket, which is what is broadcast). The
    driver sees one number, the plan does not grow with the buckets, and rows are shuffled once.
    """
    parts = 4 * shuffle_width(df.sparkSession)
    key = F.struct(*keys)
    bounds = landed(_bounds(df.select(*keys), keys, parts))
    halves = F.array(*[F.lit(1 << i) for i in range(parts.bit_length(), -1, -1)])

    def placed(rows: DataFrame) -> DataFrame:
        reach = lambda at, step: F.when(F.get("_bounds", at + step - 1) <= key, at + step).otherwise(at)
        return rows.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.aggregate(halves, F.lit(0), reach)).drop("_bounds")

    ends = placed(df.select(*keys)).groupBy("bucket").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    order = Window.orderBy("bucket")  # over one row a bucket
    ring = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back, on = F.lag("bucket").over(order), F.lead("bucket").over(order)
    if wrap:
        back, on = F.coalesce(back, F.last("bucket").over(ring)), F.coalesce(on, F.first("bucket").over(ring))
    sent = ends.select("first", "last", back.alias("back"), on.alias("on"))
    pairs = F.array(*([F.struct(F.col("first").alias("k"), F.col("back").alias("to"))] if after else []), *([F.struct(F.col("last").alias("k"), F.col("on").alias("to"))] if before else []))
    if not (before or after):
        return placed(df).withColumn("copy", F.lit(False)).repartition(shuffle_width(df.sparkSession), "bucket")
    targets = sent.select(F.inline(pairs)).filter(F.col("to").isNotNull()).groupBy("k").agg(F.collect_list("to").alias("_to"))
    targets = landed(targets.select(*[F.col(f"k.{k}").alias(f"_k{i}") for i, k in enumerate(keys)], "_to"))
    is_end = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    met = placed(df).join(F.broadcast(targets), is_end, "left")
    own = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("c")))
    copies = F.transform(F.coalesce("_to", F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("c")))
    out = met.select(*df.columns, F.explode(F.concat(own, copies)).alias("_at"))
    return out.select(*df.columns, F.col("_at.b").alias("bucket"), F.col("_at.c").alias("copy")).repartition(shuffle_width(df.sparkSession), "bucket")

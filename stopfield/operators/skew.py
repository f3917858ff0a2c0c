"""Building blocks that stay balanced when one key holds a large part of all rows.

* totals of a group are aggregated with a map-side partial step and joined back; adaptive execution splits hot keys of the join;
* the best row of a key is an aggregate over a struct, never a sorted group;
* order statistics and running sums work on buckets of the order column, with bounds from its quantiles in the same plan: bucket totals are small,
  only one bucket at a time is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skewed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where a key of ``big`` may be hot.

    An equality join that adaptive execution splits where it measures a hot key (``session.tune`` switches that on, also where the split costs
    another shuffle). Nothing is repeated for keys that are not hot.
    """
    return big.join(small, list(keys), how)


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Every row with aggregates of its group (what a window over an unordered partition gives, without gathering the group)."""
    sums = df.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    return skewed_join(df, sums, keys, "left")


def with_grand_totals(df: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Every row with aggregates of the whole table; the other side is one row, so it can be broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(name) for name, c in totals.items()])))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest ``order`` tuple. Negate a number to prefer the largest."""
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    best = F.min(F.struct(*named, F.struct(*keep).alias("row")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.row.{c}").alias(c) for c in keep])


BUCKETS = 4096
"""Buckets of an order column; their bounds are that many quantiles of its values."""


def numbers(values: Sequence[float]) -> Column:
    """A constant array of doubles as one expression, however long."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def with_order_bucket(df: DataFrame, value: str, weight: str, name: str = "_b", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with a long ``name`` that never falls when ``value`` rises, from bounds that are quantiles of the values of ``df``.

    The bounds are one row with an array of at most ``buckets`` + 1 numbers (a sketch of fixed size), broadcast and searched by halving. They are
    part of the plan, no job of their own: ``df`` should be an aggregate whose last step is its shuffle, and ``weight`` another of its columns, so
    that both sides read one exchange. Each bucket holds about its share of the rows, whatever the values' tail; equal values share a bucket.
    """
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v) & F.col(weight).isNotNull(), v)
    probs = numbers([i / buckets for i in range(buckets + 1)])
    edges = df.agg(F.array_distinct(F.percentile_approx(known, probs, 10 * buckets)).alias("_edges"))
    # one projection per halving: these are compiled with the join, so the array of bounds is read in place and not copied with every row
    out = df.crossJoin(F.broadcast(edges)).withColumn(name, F.lit(0))
    for i in range(buckets.bit_length(), -1, -1):
        out = out.withColumn(name, F.col(name) + F.when(F.get("_edges", F.col(name) + F.lit((1 << i) - 1)) <= v, F.lit(1 << i)).otherwise(F.lit(0)))
    return out.withColumn(name, F.col(name).cast("long")).drop("_edges")


def _distinct_values(df: DataFrame, by: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Total weight of every (group, value): equal values of a hot group collapse before the shuffle."""
    return with_order_bucket(df.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w")), "_v", "_w")


def values_at(
    df: DataFrame, by: Sequence[str], value: str, weight: Column, targets: Sequence[Column] | Column
) -> DataFrame:
    """Value at which the cumulative weight of a group first reaches each target.

    ``targets`` are columns of ``_total``, the weight of the group, or one array of them. Returns the group keys, ``_i`` (index of the target), ``_total`` and
    ``_value``. Two passes: the running sum over buckets finds the bucket, then only that bucket is put in order.
    """
    distinct = _distinct_values(df, by, value, weight)
    buckets = distinct.groupBy(*by, "_b").agg(F.sum("_w").alias("_bw"))
    ordered = Window.partitionBy(*by).orderBy("_b")
    whole = Window.partitionBy(*by)
    buckets = (
        buckets.withColumn("_cum", F.sum("_bw").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bw").over(whole))
        .withColumn("_last", F.max("_b").over(whole) == F.col("_b"))
        .withColumn("_before", F.lag("_cum").over(ordered))
    )
    goals = targets if isinstance(targets, Column) else F.array(*[t.cast("double") for t in targets])
    goals = F.transform(goals, lambda goal, i: F.struct(i.alias("i"), goal.alias("goal")))
    reached = buckets.filter(F.col("_total") > 0).withColumn(
        "_goal",
        F.explode(
            F.filter(
                goals,
                lambda g: ((g["goal"] <= F.col("_cum")) | F.col("_last")) & (F.col("_before").isNull() | (g["goal"] > F.col("_before"))),
            )
        ),
    ).select(*by, "_b", "_total", F.coalesce("_before", F.lit(0.0)).alias("_before"), F.col("_goal.i").alias("_i"), F.col("_goal.goal").alias("_g"))
    inside = Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        distinct.join(reached, [*by, "_b"])
        .withColumn("_reach", F.col("_before") + F.sum("_w").over(inside))
        .groupBy(*by, "_i")
        .agg(
            F.first("_total").alias("_total"),
            F.coalesce(F.min(F.when(F.col("_reach") >= F.col("_g"), F.col("_v"))), F.max("_v")).alias("_value"),
        )
    )


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: str, weight: str | None, probs: Mapping[str, float]) -> DataFrame:
    """First value whose cumulative weight reaches each share of the group's weight; one column per named share."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (w >= 0))
    at = values_at(rows, by, value, w, [F.col("_total") * p for p in probs.values()])
    picks = [F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(name) for i, name in enumerate(probs)]
    return at.groupBy(*by).agg(*picks)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, one row per group and probability (``q``, ``value``)."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    each, n = numbers(probs), len(probs)
    rank = lambda ends: F.transform(each, lambda p: (ends(p * (F.col("_total") - 1)) + 1).cast("double"))
    at = values_at(rows, by, value, F.lit(1.0), F.concat(rank(F.floor), rank(F.ceil)))
    prob = F.element_at(each, (F.col("_i") % n + 1).cast("int"))
    pairs = at.withColumn("q", prob).groupBy(*by, "q").agg(
        F.first("_total").alias("_total"),
        F.max(F.when(F.col("_i") < n, F.col("_value"))).alias("_low"),
        F.max(F.when(F.col("_i") >= n, F.col("_value"))).alias("_high"),
    )
    position = F.col("q") * (F.col("_total") - 1)
    return pairs.select(*by, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * (position - F.floor(position))).alias("value"))


def median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, by, value, [0.5]).select(*by, F.col("value").alias(name))


def counts_below(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per (group, distinct value): its count, how many rows lie below it and the group's size."""
    distinct = _distinct_values(df, by, value, F.lit(1).cast("long"))
    buckets = distinct.groupBy(*by, "_b").agg(F.sum("_w").alias("_bw"))
    ordered = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_offset", F.coalesce(F.sum("_bw").over(ordered), F.lit(0))).withColumn(
        "size", F.sum("_bw").over(Window.partitionBy(*by))
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return distinct.join(buckets.drop("_bw"), [*by, "_b"]).select(
        *by,
        F.col("_v").alias(value),
        F.col("_w").alias("count"),
        (F.col("_offset") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).alias("below"),
        "size",
    )


def rank_within(df: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """``rank()`` of every row within its group, missing values last, without putting a group in one task.

    The rank of a value is 1 + the rows before it; it is found on the distinct values and joined back.
    """
    v = F.col(value).cast("double")
    rows = df.withColumn("_k", F.when(~F.isnan(v), -v if descending else v))
    known = rows.filter(F.col("_k").isNotNull())
    below = counts_below(known, by, "_k").select(*by, "_k", (F.col("below") + 1).alias(name))
    keys = [*by, "_k"]
    placed = skewed_join(known, below, keys, "inner").drop("_k")
    sizes = df.groupBy(*by).agg(F.count_if(v.isNotNull() & ~F.isnan(v)).alias("_n"))
    missing = rows.filter(F.col("_k").isNull()).drop("_k")
    missing = skewed_join(missing, sizes, by) if by else missing.crossJoin(F.broadcast(sizes))
    return placed.unionByName(missing.withColumn(name, F.col("_n") + 1).drop("_n"))


def running_sum(
    df: DataFrame, groups: Sequence[str], order: str, tie: str, weight: str, name: str
) -> DataFrame:
    """Running sum of ``weight`` over the whole table ordered by ``groups``, then ``order``, then the md5 of the unique key ``tie``.

    Offsets are found level by level: groups, buckets of the order column, distinct values in a bucket, 256 slices of equal values. The only
    rows ever sorted together are one slice of one value, so neither a hot group nor a hot value ends up in one task.
    """
    rows = df.withColumn("_s", F.substring(F.md5(F.col(tie).cast("string")), 1, 2))
    value = [*groups, "_b", order]
    slices = with_order_bucket(rows.groupBy(*groups, order, "_s").agg(F.sum(weight).alias("_sw")), order, "_sw")
    values = slices.groupBy(*value).agg(F.sum("_sw").alias("_vw"))
    buckets = values.groupBy(*groups, "_b").agg(F.sum("_vw").alias("_bw"))
    totals = buckets.groupBy(*groups).agg(F.sum("_bw").alias("_gw"))

    def before(w, column):
        return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))

    # one row per distinct group tuple: the window without a partition runs over that short list only
    totals = totals.select(*groups, before(Window.orderBy(*groups), "_gw").alias("_go"))
    buckets = buckets.select(*groups, "_b", before(Window.partitionBy(*groups).orderBy("_b"), "_bw").alias("_bo"))
    values = values.select(*value, before(Window.partitionBy(*groups, "_b").orderBy(order), "_vw").alias("_vo"))
    slices = slices.select(*value, "_s", before(Window.partitionBy(*value).orderBy("_s"), "_sw").alias("_so"))
    upper = (buckets.join(totals, list(groups)) if groups else buckets.crossJoin(F.broadcast(totals))).select(
        *groups, "_b", (F.col("_go") + F.col("_bo")).alias("_o1")
    )
    offsets = slices.join(values, value).join(upper, [*groups, "_b"]).select(
        *groups, order, "_s", (F.col("_o1") + F.col("_vo") + F.col("_so")).alias("_o")
    )
    inside = Window.partitionBy(*groups, order, "_s").orderBy(F.md5(F.col(tie).cast("string"))).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*groups, order, "_s"]).withColumn(name, F.col("_o") + F.sum(weight).over(inside)).select(*df.columns, name)
    )


def global_ids(df: DataFrame, group: str, key: str, name: str, slices: int = 4096) -> DataFrame:
    """Running ids 0, 1, 2, ... over the whole table, group after group, within a group by the md5 slice and value of ``key``."""
    digits = 3 if slices > 256 else 2
    rows = df.withColumn("_s", F.substring(F.md5(F.col(key).cast("string")), 1, digits))
    sizes = rows.groupBy(group, "_s").agg(F.count("*").alias("_n"))
    totals = sizes.groupBy(group).agg(F.sum("_n").alias("_gn"))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(group, ahead(Window.orderBy(group), "_gn").alias("_go"))
    offsets = sizes.select(group, "_s", ahead(Window.partitionBy(group).orderBy("_s"), "_n").alias("_so")).join(totals, group)
    place = F.row_number().over(Window.partitionBy(group, "_s").orderBy(key)) - 1
    return rows.join(offsets, [group, "_s"]).withColumn(name, F.col("_go") + F.col("_so") + place).select(*df.columns, name)

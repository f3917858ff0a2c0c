"""Keeping, ranking and ordering rows: best rows, top-K lists, places, running ids, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.operators.skew import counts_below, first_row, rank_within, skewed_join

def _descending(c: str) -> Column:
    """Key that puts large numbers first and missing ones last when sorted upwards."""
    v = F.col(c).cast("double")
    return F.coalesce(-v, F.lit(float("inf")))


def merge_by_location(stops: DataFrame, row_id: str, score: str, routes: str, digits: int = 6) -> DataFrame:
    """One row per rounded coordinate: the best-scored stop (first row wins ties) with all routes of the place, best stop's routes first.

    The route list is built from distinct (place, route) pairs, so many stops at one place do not pile up in one task.
    """
    keyed = stops.withColumn("_lat", F.round("lat", digits)).withColumn("_lon", F.round("lon", digits))
    keys = ["_lat", "_lon"]
    best = first_row(keyed, keys, [_descending(score), F.col(row_id)], [c for c in stops.columns if c != routes])
    each = keyed.select(*keys, _descending(score).alias("_s"), F.col(row_id).alias("_r"), F.posexplode(routes).alias("_p", "_route"))
    distinct = each.groupBy(*keys, "_route").agg(F.min(F.struct("_s", "_r", "_p")).alias("_at"))
    lists = distinct.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_route"))), lambda x: x["_route"]).alias(routes)
    )
    return best.join(lists, keys, "left").drop(*keys)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_row(df, keys, order, [c for c in df.columns if c not in keys])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, slot: str | None = None) -> DataFrame:
    """The first k rows of every key. Spark keeps at most k rows per key and map task before the shuffle, so a hot key stays small."""
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k)
    return out.withColumn(slot, F.col("_n") - 1).drop("_n") if slot else out.drop("_n")


def far_slots(candidates: DataFrame, k: int) -> DataFrame:
    """(cell, station, group, rank, dist): duplicates of a station in a group give their nearest row, then slots by rank and distance."""
    single = candidates.groupBy("cell", "station", "group").agg(F.min(F.struct("dist", "rank")).alias("m"))
    rows = single.select("cell", "station", "group", F.col("m.rank").alias("rank"), F.col("m.dist").alias("dist"))
    return top_k(rows, ["cell"], [F.col("rank"), F.col("dist"), F.col("station"), F.col("group")], k, slot="slot")


def extremes(df: DataFrame, columns: Sequence[str], tie: str) -> DataFrame:
    """The rows holding the smallest and the largest value of each column."""
    row = F.struct(*df.columns)
    known = lambda c: F.col(c).isNotNull()
    picks = []
    for c in columns:
        picks.append(F.min(F.when(known(c), F.struct(F.col(c).alias("v"), F.col(tie).alias("t"), row.alias("row")))))
        picks.append(F.max(F.when(known(c), F.struct(F.col(c).alias("v"), (-F.col(tie)).alias("t"), row.alias("row")))))
    found = df.agg(F.array_compact(F.array(*[p["row"] for p in picks])).alias("r"))
    return found.select(F.inline("r")).distinct()


def place_of(df: DataFrame, by: Sequence[str], column: str, name: str = "place") -> DataFrame:
    """Place by a column, largest first, missing values after all others."""
    return rank_within(df, by, column, name, descending=True)


def percentile_of(df: DataFrame, by: Sequence[str], column: str, name: str = "percentile") -> DataFrame:
    """``percent_rank`` of every row in its group."""
    below = counts_below(df.filter(F.col(column).isNotNull()), by, column)
    share = below.select(*by, column, F.when(F.col("size") > 1, F.col("below") / (F.col("size") - 1)).otherwise(0.0).alias(name))
    return skewed_join(df, share, [*by, column])


def percentile_from_table(df: DataFrame, table: DataFrame, column: str, name: str = "percentile") -> DataFrame:
    """Percentile from a 101-point table of the column: the highest point at or below the value.

    ``table`` has (q, value): 101 rows, folded into one array that every row searches.
    """
    points = table.agg(F.array_sort(F.collect_list(F.struct("value", "q"))).alias("_pts"))
    at = F.filter("_pts", lambda p: p["value"] <= F.col(column))
    return df.crossJoin(F.broadcast(points)).withColumn(name, F.round(100 * F.coalesce(F.element_at(at, F.greatest(F.size(at), F.lit(1)))["q"], F.lit(0.0)), 0)).drop("_pts")


def spatial_order(df: DataFrame, cell: str) -> DataFrame:
    """Rows near each other in space to the same partition, in order inside it."""
    return df.repartitionByRange(F.col(cell)).sortWithinPartitions(cell)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing somewhere becomes null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cells_either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def cells_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def cells_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)

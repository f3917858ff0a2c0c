"""Nearest features and sums within a radius, by descending cubes of the unit sphere on both sides at once.

Positions are taken as vectors on the sphere, so every distance is the great-circle one and no latitude has to be chosen; a chord grows with its arc,
and the chords between two cubes have exact bounds. Pairs of cubes that can still matter are cut further, in rounds landed in the shared folder (as both sets of places are, once),
while the feature cube holds more than ``FEW`` different places. A crowded square is cut until it is no longer crowded, an empty region never; a
point is compared with a bounded number of features wherever it lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions.geo import haversine_km
from stopfield.functions.grid import EARTH_M
from stopfield.session import cut_lineage

FEW = 16
"""A feature cube of so many places or fewer is compared place by place."""
LEAST_SIDE = 1e-3
"""Metres; cubes are not cut below."""
SLACK = 1e-3
"""Metres by which bounds give way to rounding; the distance itself decides."""
BITS = 2
"""Halvings of the side in a round: a pair becomes up to 16 x 16 pairs on the ground."""
AXES = ("_x", "_y", "_z")


def chord(metres: float) -> float:
    """Straight line through the sphere between two places this far apart on it."""
    return 2 * EARTH_M * math.sin(min(metres / (2 * EARTH_M), math.pi / 2))


def with_axes(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The vector of each position in metres, as ``_x``, ``_y`` and ``_z``."""
    a, b = F.radians(lon), F.radians(lat)
    return df.withColumn("_x", F.cos(b) * F.cos(a) * EARTH_M).withColumn("_y", F.cos(b) * F.sin(a) * EARTH_M).withColumn("_z", F.sin(b) * EARTH_M)


def _cube(side: float) -> Column:
    return F.struct(*[F.floor(F.col(a) / side).alias(n) for a, n in zip(AXES, "ijk")])


def _bounds(side: float) -> tuple[Column, Column]:
    """Least and greatest chord between places of the cubes p and f."""
    steps = [F.abs(F.col(f"p.{n}") - F.col(f"f.{n}")) for n in "ijk"]
    square = lambda parts: F.sqrt(sum(((x * x).cast("double") for x in parts), F.lit(0.0))) * side
    return square([F.greatest(s - 1, F.lit(0)) for s in steps]), square([s + 1 for s in steps])


def _start(where: DataFrame, places: DataFrame, side: float, by: Sequence[str]) -> DataFrame:
    """Touching cubes that hold points and features, with the number of feature places ``n``."""
    near = F.array(*[F.struct(*[(F.col(f"p.{n}") + o).alias(n) for n, o in zip("ijk", (a, b, c))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    p = where.select(_cube(side).alias("p")).distinct().select("p", F.explode(near).alias("f"))
    return p.join(places.groupBy(_cube(side).alias("f"), *by).agg(F.count("*").alias("_n")), "f")


def _finer(pairs: DataFrame, where: DataFrame, places: DataFrame, side: float, finer: float, by: Sequence[str]) -> DataFrame:
    """The pairs of the smaller occupied cubes inside each pair.

    Large cubes are few, so what meets on them is dealt out by the smaller cubes before it is multiplied.
    """
    p = where.select(_cube(side).alias("p"), _cube(finer).alias("p2")).distinct()
    f = places.groupBy(_cube(side).alias("f"), _cube(finer).alias("f2"), *by).agg(F.count("*").alias("_n"))
    inside = f.groupBy("f", *by).agg(F.collect_list(F.struct(F.col("f2").alias("f"), "_n")).alias("_inside"))
    met = pairs.drop("_n").join(inside, ["f", *by]).drop("f").join(p, "p").drop("p").withColumnRenamed("p2", "p")
    return met.repartition(_width(pairs), "p").select(*[c for c in met.columns if c != "_inside"], F.inline("_inside"))


def _width(df: DataFrame) -> int:
    """Partitions of rows that are about to be multiplied: their number, not their present size, says what a task has to do."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(points: DataFrame, keep: Sequence[str]) -> DataFrame:
    return with_axes(points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(*keep, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")))


def nearest_pairs(where: DataFrame, places: DataFrame, cap: float | None, by: Sequence[str] = ()) -> list[tuple[float, DataFrame]]:
    """(side, pairs p and f): cubes of that side whose places must be compared to know the nearest place within ``cap`` of each point."""
    limit = chord(cap) if cap is not None else 2 * EARTH_M
    side = limit if cap is not None else EARTH_M * 1.001
    low, high = _bounds(side)
    pairs = _start(where, places, side, by).withColumn("best", F.lit(2.0 * EARTH_M))
    out = []
    while True:
        # what the bound of the round before rules out neither stays nor lowers the next bound
        near = pairs.withColumn("_low", low).filter((F.col("_low") <= limit + SLACK) & (F.col("_low") <= F.col("best") + SLACK))
        marked = near.withColumn("best", F.least("best", F.min(high).over(Window.partitionBy("p", *by))))
        # the cubes in reach of one cube are a bounded number: those touched at first, then those no farther than the best bound
        pairs = cut_lineage(marked.filter(F.col("_low") <= F.col("best") + SLACK).drop("_low"))
        crowded = pairs.filter(F.col("_n") > FEW) if side > LEAST_SIDE else pairs.limit(0)
        out.append((side, (pairs.filter(F.col("_n") <= FEW) if side > LEAST_SIDE else pairs).select("p", "f", *by)))
        if crowded.isEmpty():
            return out
        finer = side / (1 << BITS)
        pairs, side = _finer(crowded, where, places, side, finer, by), finer
        low, high = _bounds(side)


def nearest(points: DataFrame, features: DataFrame, point: str, feature: str, cap: float | None, by: Sequence[str] = ()) -> DataFrame:
    """Nearest feature within ``cap`` metres of every point, per value of the feature columns ``by``: (point, by, feature, dist).

    Exact; the smallest feature id wins ties; points without a feature in reach, or without a position, are absent. Without a cap (None) every
    point has its nearest feature.
    """
    p = _placed(points, [point])
    where = cut_lineage(p.drop(point).distinct())
    f = _placed(features, [*by, feature])
    places = cut_lineage(f.groupBy(*by, "lon", "lat", *AXES).agg(F.min(feature).alias(feature)))
    right = places.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), *AXES, *by, feature)
    compared = None
    for side, pairs in nearest_pairs(where, places, cap, by):
        rows = pairs.join(where.withColumn("p", _cube(side)).drop(*AXES), "p").repartition(_width(where), "f", *by).join(right.withColumn("f", _cube(side)).drop(*AXES), ["f", *by]).drop("p", "f")
        compared = rows if compared is None else compared.unionByName(rows)
    d = haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) * 1000
    near = compared.withColumn("dist", d)
    near = near if cap is None else near.filter(F.col("dist") <= cap)
    best = near.groupBy("lon", "lat", *by).agg(F.min(F.struct("dist", feature)).alias("_m")).select("lon", "lat", *by, f"_m.{feature}", "_m.dist")
    return p.select(point, "lon", "lat").join(best, ["lon", "lat"]).select(point, *by, feature, "dist")


def radius_sums(points: DataFrame, features: DataFrame, point: str, values: Sequence[str], radius: float) -> DataFrame:
    """Sums of feature values within ``radius`` metres of every point (0 where there is none): (point, values).

    Cubes wholly within reach of every place of a cube add their subtotal at once; only the rim is cut further and compared.
    """
    p = points.select(point, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    where = cut_lineage(_placed(p, []).distinct())
    places = cut_lineage(_placed(features, values).groupBy("lon", "lat", *AXES).agg(*[F.sum(v).alias(v) for v in values]))
    reach = side = chord(radius)
    pairs, parts = _start(where, places, side, ()), []
    right = places.withColumnRenamed("lon", "_lon").withColumnRenamed("lat", "_lat")
    while True:
        low, high = _bounds(side)
        pairs = cut_lineage(pairs.withColumn("_in", high <= reach - SLACK).filter(low <= reach + SLACK))
        rim = pairs.filter(~F.col("_in"))
        few = rim.filter(F.col("_n") <= FEW) if side > LEAST_SIDE else rim
        total = places.groupBy(_cube(side).alias("f")).agg(*[F.sum(v).alias(v) for v in values])
        gain = pairs.filter("_in").join(total, "f").groupBy("p").agg(*[F.sum(v).alias(v) for v in values])
        at = where.withColumn("p", _cube(side)).drop(*AXES)
        d = haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) * 1000
        parts += [at.join(gain, "p").select("lon", "lat", *values), few.join(at, "p").join(right.withColumn("f", _cube(side)).drop(*AXES), "f").filter(d <= radius).select("lon", "lat", *values)]
        crowded = rim.filter(F.col("_n") > FEW) if side > LEAST_SIDE else rim.limit(0)
        if crowded.isEmpty():
            break
        finer = side / (1 << BITS)
        pairs, side = _finer(crowded.drop("_in"), where, places, side, finer, ()), finer
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy("lon", "lat").agg(*[F.sum(v).alias(v) for v in values])
    return p.join(sums, ["lon", "lat"], "left").select(point, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])

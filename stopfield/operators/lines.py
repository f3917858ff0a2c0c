"""Positions of stops along drawn lines, as tables: pieces of lines with the kilometre they start at, and how near each stop is to each piece.

Points are vectors on the unit sphere, so distances need no local projection. Positions are kilometres along the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions.geo import EARTH_KM
from stopfield.functions.numeric import let

# Fixed values of the rule: a pass of the line within this of the nearest one competes with it; places farther apart than this differ.
NEAR_KM, AMBIGUOUS_KM = 0.0111195, 0.1


def _vector(lon: Column, lat: Column) -> Column:
    x, y = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(y) * F.cos(x)).alias("x"), (F.cos(y) * F.sin(x)).alias("y"), F.sin(y).alias("z"))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] - b[c]).alias(c) for c in ("x", "y", "z")])


def line_pieces(routes: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, piece, a, way, km, long): start and direction vector of every straight piece, the kilometre it starts at and its length.

    The running sum is over the pieces of one line.
    """
    points = routes.select(key, F.posexplode(line).alias("piece", "p")).select(key, "piece", _vector(F.col("p.lon"), F.col("p.lat")).alias("a"))
    along = Window.partitionBy(key).orderBy("piece")
    pairs = points.withColumn("b", F.lead("a").over(along)).filter(F.col("b").isNotNull())
    ways = pairs.select(key, "piece", "a", _minus(F.col("b"), F.col("a")).alias("way"))
    chord = F.sqrt(_dot(F.col("way"), F.col("way")))
    length = F.lit(2 * EARTH_KM) * F.asin(F.least(chord / 2, F.lit(1.0)))
    before = F.coalesce(F.sum("long").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ways.withColumn("long", length).withColumn("km", before)


def _reaches(routes: DataFrame, key: str, line: str, stops: str) -> DataFrame:
    """Per stop of a route: ``reach``, for each piece in order its start and end kilometre, ``foot``, the kilometre nearest to the stop, and ``off``, so that
    the squared distance at a kilometre is off + (kilometre - foot)^2."""
    asked = routes.select(key, F.posexplode(stops).alias("nth", "s")).select(key, "nth", _vector(F.col("s.lon"), F.col("s.lat")).alias("p"))
    # merged, not broadcast: the planner guesses the size of unpacked lists far too low
    both = asked.join(line_pieces(routes, key, line).hint("merge"), key)
    to = _minus(F.col("p"), F.col("a"))
    size = _dot(F.col("way"), F.col("way"))
    share = F.when(size > 0, _dot(to, F.col("way")) / size).otherwise(0.0)
    # distances in kilometres: chords of these lengths are as long as their arcs to a millionth
    both = both.withColumn("share", share).withColumn("side", (_dot(to, to) - F.col("share") * F.col("share") * size) * (EARTH_KM * EARTH_KM))
    flat = both.select(
        key, "nth", F.struct("piece", "km", (F.col("km") + F.col("long")).alias("to"), (F.col("km") + F.col("share") * F.col("long")).alias("foot"), F.greatest("side", F.lit(0.0)).alias("off")).alias("r"),
    )
    return flat.groupBy(key, "nth").agg(F.array_sort(F.collect_list("r")).alias("reach"))


def _nearest(reach: Column, start: Column) -> Column:
    """(squared distance, kilometre) of the nearest place of the line that is not before ``start``; the first of equals."""

    def place(r):
        at = F.greatest(F.least(r["foot"], r["to"]), r["km"], start)
        away = at - r["foot"]
        return F.struct(F.round(r["off"] + away * away, 9).alias("d"), at.alias("at"))  # a pass over the same place ties with it

    return F.array_min(F.transform(F.filter(reach, lambda r: r["to"] >= start), place))


def stop_positions(routes: DataFrame, key: str = "route", line: str = "line", stops: str = "stops") -> DataFrame:
    """Adds ``km``: the distance along the line of every stop in order, each at or after the one before it, and ``ambiguous``: the line
    passes some stop nearly as close at a place over ``AMBIGUOUS_KM`` from its position.

    ``line``: array of (lon, lat); ``stops``: array of structs with lon and lat; ``key`` is unique. A line of one point has no position (null).
    The fold over a route's stops sees, for each, its list of pieces.
    """
    per_route = _reaches(routes, key, line, stops).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "reach"))).alias("asked"))
    start = F.array().cast("array<double>")

    def follow(done, s):
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0))
        return F.array_append(done, F.coalesce(_nearest(s["reach"], last)["at"], last))

    placed = per_route.withColumn("km", F.aggregate("asked", start, follow))

    def doubtful(s, km):
        least = F.array_min(F.transform(s["reach"], lambda r: _gap(r)))
        return let(least, lambda m: F.exists(s["reach"], lambda r: (_gap(r) <= m + NEAR_KM) & (F.abs(_held(r) - km) > AMBIGUOUS_KM)))

    unsure = F.exists(F.arrays_zip(F.col("asked").alias("s"), F.col("km").alias("k")), lambda z: doubtful(z["s"], z["k"]))
    return routes.join(placed.select(key, "km", unsure.alias("ambiguous")).hint("merge"), key, "left")


def _held(r: Column) -> Column:
    """The kilometre of a piece that is nearest to the stop."""
    return F.greatest(F.least(r["foot"], r["to"]), r["km"])


def _gap(r: Column) -> Column:
    away = _held(r) - r["foot"]
    return F.sqrt(r["off"] + away * away)

"""Vehicle-kilometres inside areas on one day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopfield.operators.gtfs import active_services, runs_per_trip
from stopfield.operators.skew import skewed_join
from stopfield.operators.spatial import lines_inside


def _segments(points: DataFrame, line: str, order: str) -> DataFrame:
    """(line, x1, y1, x2, y2) from the points of a line in order; a line's points are a short list (a shape, the calls of a trip)."""
    w = Window.partitionBy(line).orderBy(order)
    return points.select(line, F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(w).alias("x2"), F.lead("lat").over(w).alias("y2")).filter("x2 IS NOT NULL AND y2 IS NOT NULL")


def vehicle_km(
    trips: DataFrame, calls: DataFrame, stops: DataFrame, frequencies: DataFrame, calendar: DataFrame, exceptions: DataFrame, day: str,
    areas: DataFrame, key: str, res: int, shapes: DataFrame | None = None,
) -> DataFrame:
    """Per area: runs of the day's trips times the length of their lines inside it, cut at the border, and the trips seen.

    A trip follows its ``shape`` (a column of ``trips``; ``shapes`` has shape, seq, lon, lat); without one, or with one that has no line, the straight
    lines between its stops. Each shape is cut once, however many trips run on it. Trip, stop and shape ids are unique over all feeds
    (``gtfs.qualified`` makes them so); trips are cut to the day first.
    """
    today = active_services(calendar, exceptions, day, day).select("feed", "service")
    day_trips = trips.join(today, ["feed", "service"], "left_semi")
    running = runs_per_trip(day_trips, frequencies).select("trip", "runs")
    if shapes is None:
        drawn, shaped = None, None
        rest = running.select("trip")
    else:
        drawn = _segments(shapes.filter("lon IS NOT NULL AND lat IS NOT NULL"), "shape", "seq")
        shaped = day_trips.select("trip", "shape").join(drawn.select("shape").distinct(), "shape", "left_semi")
        rest = running.select("trip").join(shaped, "trip", "left_anti")
    at = skewed_join(calls.join(rest, "trip", "left_semi"), stops.select("stop", "lon", "lat"), ["stop"], "inner")
    inside = lines_inside(_segments(at.filter("lon IS NOT NULL AND lat IS NOT NULL"), "trip", "seq"), ["trip"], areas, key, res)
    if shapes is not None:
        used = drawn.join(shaped.select("shape").distinct(), "shape", "left_semi")
        inside = inside.unionByName(skewed_join(shaped, lines_inside(used, ["shape"], areas, key, res), ["shape"], "inner").select("trip", key, "km"))
    return inside.join(running, "trip").groupBy(key).agg(F.sum(F.col("km") * F.col("runs")).alias("vehicle_km"), F.count("*").alias("trips"))

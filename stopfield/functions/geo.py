"""Distances and small geometry on longitude / latitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopfield.functions.grid import METRES_PER_DEGREE

EARTH_KM = 6371.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def plane_x(lon: Column, lat0: float | Column) -> Column:
    """Metres east of the prime meridian on the plane about latitude ``lat0``."""
    lat0 = F.lit(lat0) if not isinstance(lat0, Column) else lat0
    return lon * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat0))


def plane_y(lat: Column) -> Column:
    return lat * F.lit(METRES_PER_DEGREE)


def plane_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat0: float | Column | None = None) -> Column:
    """Equirectangular distance about ``lat0`` (the mean of both latitudes when not given)."""
    mid = (lat1 + lat2) / 2 if lat0 is None else (lat0 if isinstance(lat0, Column) else F.lit(lat0))
    dx = (lon2 - lon1) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(mid))
    dy = (lat2 - lat1) * F.lit(METRES_PER_DEGREE)
    return F.sqrt(dx * dx + dy * dy)


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment (0 to 1) the nearest position to a point lies."""
    vx, vy = bx - ax, by - ay
    length2 = vx * vx + vy * vy
    raw = ((px - ax) * vx + (py - ay) * vy) / F.when(length2 > 0, length2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0))))


def _fold(ring: Column, term) -> Column:
    """Sum ``term(a, b)`` over the edges of a closed ring."""
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0.0),
        lambda acc, i: acc + term(F.element_at(ring, i.cast("int")), F.element_at(ring, (i + 1).cast("int"))),
    )


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area of a closed ring of (lon, lat), scaled by the cosine of its mean latitude."""
    lats = F.transform(ring, lambda p: p["lat"])
    mid = (F.array_min(lats) + F.array_max(lats)) / 2
    k = METRES_PER_DEGREE / 1000.0
    raw = F.abs(_fold(ring, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])) / 2
    return raw * F.lit(k * k) * F.cos(F.radians(mid))


def ring_centroid(ring: Column) -> Column:
    """Area centroid (lon, lat), computed about the first vertex so that small rings keep their precision.

    One pass over the ring, which is evaluated once: the state holds the first and the last vertex seen and the three sums.
    """
    names = ("ox", "oy", "px", "py", "area2", "sx", "sy")
    state = lambda n, *values: F.struct(n.alias("n"), *[v.cast("double").alias(c) for c, v in zip(names, values)])
    nothing, zero = F.lit(None), F.lit(0.0)

    def step(acc: Column, b: Column) -> Column:
        first = acc["n"] == 0
        cross = (acc["px"] - acc["ox"]) * (b["lat"] - acc["oy"]) - (b["lon"] - acc["ox"]) * (acc["py"] - acc["oy"])
        added = state(
            acc["n"] + 1, acc["ox"], acc["oy"], b["lon"], b["lat"], acc["area2"] + cross,
            acc["sx"] + (acc["px"] + b["lon"] - 2 * acc["ox"]) * cross, acc["sy"] + (acc["py"] + b["lat"] - 2 * acc["oy"]) * cross,
        )
        return F.when(first, state(F.lit(1), b["lon"], b["lat"], b["lon"], b["lat"], zero, zero, zero)).otherwise(added)

    def finish(acc: Column) -> Column:
        safe = F.when(acc["area2"] != 0, acc["area2"] * 3)
        return F.struct((acc["ox"] + acc["sx"] / safe).alias("lon"), (acc["oy"] + acc["sy"] / safe).alias("lat"))

    return F.aggregate(ring, state(F.lit(0), nothing, nothing, nothing, nothing, zero, zero, zero), step, finish)


def ring_box(ring: Column) -> Column:
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north")
    )


def crossing_inside(edges: Column, lon: Column, lat: Column) -> Column:
    """Crossing-number test of a point against an array of edges (x1, y1, x2, y2)."""
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.pmod(F.size(crossed), F.lit(2)) == 1


def densify(a: Column, b: Column, metres: float) -> Column:
    """Points from ``a`` to ``b`` (structs of lon, lat) at most ``metres`` apart, both ends included."""
    length = plane_metres(a["lon"], a["lat"], b["lon"], b["lat"])
    n = F.greatest(F.lit(1), F.ceil(length / metres).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            (a["lon"] + (b["lon"] - a["lon"]) * i / n).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * i / n).alias("lat")
        ),
    )

"""Building timetables: trips from stops and speeds, frequency windows, fleet headways, calibration, phases, route lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions import clock
from stopfield.functions.geo import haversine_km
from stopfield.functions.hashing import uniform
from stopfield.operators.gtfs import fingerprint
from stopfield.operators.rollup import positive
from stopfield.operators.skew import first_row, skewed_join

# Shares of a fleet in maintenance and in reserve, layover, and the limits of a fleet headway in minutes.
MAINTENANCE, RESERVE, LAYOVER, HEADWAY_LIMITS = 0.08, 0.09, 0.10, (2.0, 60.0)
# Limits in seconds of calibrated headways, layover factor and smallest compression.
CALIBRATED_LIMITS, CALIBRATED_LAYOVER, SMALLEST_K, LEAST_FREE = (240.0, 5400.0), 1.15, 0.5, 0.15
# Fixed values: (largest km from the centre, weight) of central to outer routes.
CENTRE_TIERS = ((3.0, 0.55), (5.0, 0.7), (12.0, 1.0), (1e9, 1.4))
# Distance from which a route is rural (km), and its least headways in minutes in and outside the peaks, villages apart.
RURAL_KM, RURAL_FLOOR, VILLAGE_FLOOR = 25.0, (40.0, 60.0), (60.0, 90.0)
# Speed shape of urban segments (km/h at the short and the long spacing in metres), congestion factor and limits.
SHAPE_KMH, SHAPE_METRES, CONGESTED, SPEED_LIMITS = (10.0, 20.0), (300.0, 1000.0), 0.7, (7.0, 30.0)
# Fixed values: (largest segment km, km/h) by stop spacing and (largest km from the centre, km/h) caps of other cities.
SPACING_SPEEDS = ((0.4, 14.0), (1.0, 20.0), (2.0, 28.0), (4.0, 34.0), (1e9, 40.0))
ZONE_CAPS = ((5.0, 20.0), (12.0, 24.0), (25.0, 32.0), (1e9, 45.0))


def step_table(c: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """Value of the first step whose limit is not exceeded."""
    out = F.when(F.lit(False), F.lit(0.0))
    for limit, value in steps:
        out = out.when(c <= limit, F.lit(float(value)))
    return out


def trips_from_stops(routes: DataFrame, speed: str) -> tuple[DataFrame, DataFrame]:
    """Trips and stop times of both directions of every route. ``routes``: (route, seq, stop, lon, lat, speed in km/h).

    The stops of a route are a short sequence; times are cumulative distance over speed, rounded to seconds.
    """
    n = routes.groupBy("route").agg(F.max("seq").alias("_n"))
    there = routes.withColumn("direction", F.lit(0))
    back = routes.join(n, "route").withColumn("seq", F.col("_n") - F.col("seq") + 1).withColumn("direction", F.lit(1)).drop("_n")
    both = there.unionByName(back).withColumn("trip", F.concat_ws("_", "route", "direction"))
    w = Window.partitionBy("trip").orderBy("seq")
    metres = F.coalesce(haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")) * 1000, F.lit(0.0))
    along = both.withColumn("_m", metres).withColumn("metres", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    secs = F.rint(F.col("metres") / (F.col(speed) / 3.6)).cast("long")
    calls = along.withColumn("sec", secs).select("trip", "seq", "stop", "sec", clock.text(F.col("sec")).alias("departure_time"))
    trips = both.select("route", "direction", "trip").distinct()
    return trips, calls


def frequency_windows(
    routes: DataFrame, bands: Sequence[tuple[int, int, str]], profiles: Mapping[str, Mapping[str, float]], kind: str = "class"
) -> DataFrame:
    """Headway windows of routes: the bands of the day clipped to the opening hours, with the headway of the route's class in the band.

    ``routes``: (route, class, open, close) in minutes. Bands without a headway, and empty overlaps, give no window.
    """
    table = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e"), F.lit(n).alias("band")) for a, b, n in bands])
    rows = routes.withColumn("_b", F.explode(table))
    headway = F.when(F.lit(False), F.lit(0.0))
    for name, profile in profiles.items():
        for band, minutes in profile.items():
            headway = headway.when((F.col(kind) == name) & (F.col("_b.band") == band), F.lit(float(minutes)))
    start, end = F.greatest(F.col("_b.s"), F.col("open")), F.least(F.col("_b.e"), F.col("close"))
    out = rows.select("route", F.col("_b.band").alias("band"), start.alias("start"), end.alias("end"), headway.alias("headway"))
    return out.filter("start < end and headway is not null")


def active_at(windows: DataFrame, instant) -> DataFrame:
    return windows.filter((F.col("start") <= instant) & (F.col("end") > instant))


def fleet_headway(fleet: Column, round_trip_km: Column, kmh: Column) -> Column:
    """Minutes between buses of a fleet on a round trip, ties rounded to even, within the limits."""
    in_service = fleet * (1 - MAINTENANCE - RESERVE)
    minutes = F.rint(round_trip_km / kmh * 60 * (1 + LAYOVER) / positive(in_service))
    return F.greatest(F.lit(HEADWAY_LIMITS[0]), F.least(F.lit(HEADWAY_LIMITS[1]), minutes))


def fleet_lines(branches: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per (corridor, line): the corridor's round trip and the headway each line's fleet gives on it.

    ``branches``: (corridor, km); ``lines``: (corridor, line, fleet, kmh).
    """
    trip = branches.groupBy("corridor").agg(F.sum("km").alias("round_trip_km"))
    joined = lines.join(trip, "corridor")
    return joined.withColumn("headway", fleet_headway(F.col("fleet"), F.col("round_trip_km"), F.col("kmh")))


def shape_speed(segment_km: Column, congested: Column) -> Column:
    """Raw speed of a segment from its length: linear between the two spacings, lower where congested."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (segment_km * 1000 - SHAPE_METRES[0]) / (SHAPE_METRES[1] - SHAPE_METRES[0])))
    return (SHAPE_KMH[0] + t * (SHAPE_KMH[1] - SHAPE_KMH[0])) * F.when(congested, CONGESTED).otherwise(1.0)


def spacing_speed(segment_km: Column, centre_km: Column) -> Column:
    """Speed by stop spacing, faster outside the built-up area, capped by distance to the centre."""
    uplift = F.when(centre_km <= 12, 1.0).when(centre_km <= 25, 1.1).otherwise(1.2)
    return F.least(step_table(centre_km, ZONE_CAPS), uplift * step_table(segment_km, SPACING_SPEEDS))


def calibrate_speeds(segments: DataFrame, targets: Mapping[str, float], rounds: int = 4, points: int = 32, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Per zone the factor k for which the length-weighted harmonic mean of the clipped speeds meets the target: (zone, k).

    ``segments``: (zone, km, kmh). Every round measures all points of the interval in one aggregate and keeps the step that holds the target.
    The interval of every zone of ``targets`` is a short list and broadcast: segments are neither shuffled nor sorted, only partial sums are.
    """
    at = [i / points for i in range(points + 1)]
    ks = segments.select("zone").distinct().withColumn("_lo", F.lit(low)).withColumn("_hi", F.lit(high))
    goal = F.when(F.lit(False), F.lit(0.0))
    for zone, value in targets.items():
        goal = goal.when(F.col("zone") == zone, F.lit(float(value)))
    for _ in range(rounds):
        rows = segments.join(F.broadcast(ks), "zone")
        k = lambda s: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * s
        time = lambda s: F.sum(F.col("km") / F.greatest(F.lit(SPEED_LIMITS[0]), F.least(F.lit(SPEED_LIMITS[1]), F.col("kmh") * k(s))))
        sums = rows.groupBy("zone").agg(F.sum("km").alias("_km"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[time(s).alias(f"_t{i}") for i, s in enumerate(at)])
        below = sum((F.when(F.col("_km") / F.col(f"_t{i}") < goal, 1).otherwise(0) for i in range(1, points)), F.lit(0))
        width = (F.col("_hi") - F.col("_lo")) / points
        ks = sums.select("zone", (F.col("_lo") + width * below).alias("_lo"), (F.col("_lo") + width * (below + 1)).alias("_hi"))
    return ks.select("zone", ((F.col("_lo") + F.col("_hi")) / 2).alias("k"))


def calibrate_headways(windows: DataFrame, fleets: DataFrame, instant: int = 8 * 3600 + 1800, rounds: int = 8) -> DataFrame:
    """Headways of a city's routes scaled so that the buses they need at one instant match the fleet: windows with ``new_headway``.

    ``windows``: (city, route, start, end, headway, duration, weight, least, free); ``fleets``: (city, target). Free routes get
    headway x weight x k between ``least`` and the upper limit; the others keep theirs and use up buses first. k is found by fixed-point
    rounds, each one aggregate per city, and is never below one half.
    """
    high = CALIBRATED_LIMITS[1]
    raw = F.col("headway") * F.col("weight")
    at = (F.col("start") <= instant) & (F.col("end") > instant)
    running = windows.filter(at)
    load = lambda h: F.col("duration") * CALIBRATED_LAYOVER / h
    first = running.groupBy("city").agg(
        F.sum(F.when(F.col("free"), load(raw)).otherwise(0.0)).alias("_base"), F.sum(F.when(F.col("free"), 0.0).otherwise(load(F.col("headway")))).alias("_fixed")
    )
    need = F.greatest(F.col("target") - F.col("_fixed"), LEAST_FREE * F.col("target"))
    ks = first.join(fleets, "city").select("city", need.alias("_need"), (F.col("_base") / need).alias("_k"))
    free = running.filter("free").select("city", "duration", raw.alias("_raw"), "least")
    for _ in range(rounds):
        floor = F.greatest(F.col("_k"), F.lit(SMALLEST_K))
        h = F.least(F.greatest(F.col("_raw") * floor, F.col("least")), F.lit(high))
        rows = skewed_join(free, ks, ["city"], "inner")
        ks = rows.groupBy("city").agg(F.max("_need").alias("_need"), (F.max(floor) * F.sum(load(h)) / F.max("_need")).alias("_k"))
    out = skewed_join(windows, ks.select("city", F.col("_k").alias("k")), ["city"])
    new = F.least(F.greatest(raw * F.coalesce("k", F.lit(1.0)), F.col("least")), F.lit(high))
    return out.withColumn("new_headway", F.rint(F.when(F.col("free"), new).otherwise(F.col("headway"))).cast("long"))


def rural_floor(headway: Column, km: Column, peak: Column, village: Column) -> Column:
    """Least headway in seconds of routes far from the centre."""
    floor = F.when(village, F.when(peak, VILLAGE_FLOOR[0]).otherwise(VILLAGE_FLOOR[1])).otherwise(F.when(peak, RURAL_FLOOR[0]).otherwise(RURAL_FLOOR[1]))
    return F.when(km > RURAL_KM, F.greatest(headway, floor * 60)).otherwise(headway)


def stagger(windows: DataFrame, line: str, seed: int = 0) -> DataFrame:
    """Window starts shifted by a share of the headway that depends on the line only, so lines do not depart in lockstep."""
    shift = F.floor(uniform(F.col(line), seed) * F.col("headway")).cast("long")
    return windows.withColumn("start", F.least(F.col("start") + shift, F.col("end")))


def route_lines(routes: DataFrame, trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Distinct drawn lines of every route: (feed, route, shape, points, mark), copies of a line kept once.

    ``shapes``: (feed, shape, seq, lon, lat). Points of a shape are gathered into its line; equal lines are found by their marks.
    """
    place = fingerprint(F.col("seq"), F.round(F.col("lon") * 1_000_000).cast("long"), F.round(F.col("lat") * 1_000_000).cast("long"))
    lines = shapes.groupBy("feed", "shape").agg(F.count("*").alias("points"), place.alias("mark")).filter("points > 1")
    used = trips.select("feed", "route", "shape").distinct().join(routes.select("feed", "route"), ["feed", "route"], "left_semi")
    joined = used.join(lines, ["feed", "shape"])
    return first_row(joined, ["feed", "route", "mark"], [F.col("shape")], ["shape", "points"])

"""From timetable tables to scored stops: one job for all feeds, each on its own scoring day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.operators import gtfs as G
from stopfield.operators.score import best_subset
from stopfield.operators.skew import skewed_join
from stopfield.operators.windows import merge_by_location
from stopfield.plans.params import StudyParams
from stopfield.session import cut_lineage


@dataclass(frozen=True)
class Feeds:
    """Timetable tables of all feeds together; trip and stop ids are unique over all feeds (:func:`stopfield.operators.gtfs.qualified`).

    ``trips``: (trip, feed, route, service, direction); ``calls``: (trip, seq, stop, sec); ``stops``: (stop, station, lon, lat);
    ``routes``: (feed, route, mode); ``calendar`` and ``exceptions`` as in :func:`stopfield.operators.gtfs.active_services`.
    """

    trips: DataFrame
    calls: DataFrame
    stops: DataFrame
    routes: DataFrame
    calendar: DataFrame
    exceptions: DataFrame


def day_trips(feeds: Feeds, shared_day: str, params: StudyParams) -> DataFrame:
    """Trips of each feed's scoring day, repeated publications removed."""
    active = G.active_services(feeds.calendar, feeds.exceptions)
    days = G.scoring_day(G.trips_per_day(active, feeds.trips), shared_day, params.day_type)
    trips = G.trips_on_scoring_day(feeds.trips, active, days)
    return G.dedupe_trips(trips, feeds.calls, ["feed", "route", "direction", "service", "day", "fallback"])


def score_stations(feeds: Feeds, shared_day: str, params: StudyParams = StudyParams()) -> DataFrame:
    """One row per station with its best mode tier and speed cut-off.

    The day's calls are written once: headways and speeds both read them.
    """
    trips = day_trips(feeds, shared_day, params).select("trip", "feed", "route", "direction")
    calls = feeds.calls.join(trips, "trip")  # a trip is a short list of calls
    along = G.along_trip(calls, feeds.stops).select("trip", "seq", "stop", "sec", "feed", "route", "direction", "metres", "seconds")
    placed = cut_lineage(skewed_join(along, feeds.stops.select("stop", "station"), ["stop"], "inner"))
    placed = placed.withColumn("route", F.concat_ws(":", "feed", "route"))
    window = (params.day_start, params.day_end)
    headway = G.headways(placed, ["station", "route", "direction"], window)
    inside = placed.filter((F.col("sec") >= window[0]) & (F.col("sec") < window[1]))
    # a trip's own distance and time count at every station it serves
    whole = placed.groupBy("trip").agg(F.max("metres").alias("_m"), F.max("seconds").alias("_s"))
    rides = inside.select("station", "route", "trip").distinct().join(whole, "trip")
    speed = rides.groupBy("station", "route").agg(F.sum("_m").alias("distance"), F.sum("_s").alias("time"))
    modes = feeds.routes.select(F.concat_ws(":", "feed", "route").alias("route"), "mode").dropDuplicates(["route"])
    return best_subset(headway.select("station", "route", "direction", "headway"), skewed_join(speed, modes, ["route"]), params.curves)


def scored_stops(feeds: Feeds, shared_day: str, params: StudyParams = StudyParams()) -> DataFrame:
    """Scored stations at their mean place, stations at one place merged."""
    scores = score_stations(feeds, shared_day, params)
    place = feeds.stops.groupBy("station").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    rows = scores.join(place, "station")
    return merge_by_location(rows, "station", "score", "route_ids")

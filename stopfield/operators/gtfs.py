"""Timetable feeds as tables: service calendars, representative days, departures, headways, feed identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions import clock, grid
from stopfield.functions.geo import haversine_km
from stopfield.operators.columns import route_kinds, route_mode
from stopfield.operators.rollup import positive
from stopfield.operators.skew import first_row, skewed_join

# The daily window of all headways and speeds, and the accepted volume of a day against the usual one.
DAY_WINDOW = (6 * 3600, 22 * 3600)
VOLUME_RANGE = (0.8, 1.25)
# Fixed value: no two stops of a group are farther apart than this, in metres.
GROUP_METRES = 150.0
# Scoring mode of the agencies' own mode names, and the kinds of routes a feed for that mode must hold.
AGENCY_MODES = {
    "Heavy Rail": "rail", "Commuter Rail": "rail", "Hybrid Rail": "rail", "Alaska Railroad": "rail", "Monorail/Automated Guideway": "rail",
    "Light Rail": "tram", "Streetcar Rail": "tram", "Cable Car": "tram", "Inclined Plane": "tram", "Aerial Tramway": "tram",
    "Bus Rapid Transit": "tram", "Bus": "bus", "Commuter Bus": "bus", "Trolleybus": "bus", "Ferryboat": "bus",
}
AGENCY_KINDS = {
    "Heavy Rail": ["rail"], "Commuter Rail": ["rail"], "Light Rail": ["rail"], "Hybrid Rail": ["rail"], "Streetcar Rail": ["rail"],
    "Monorail/Automated Guideway": ["rail"], "Alaska Railroad": ["rail"], "Cable Car": ["rail"], "Inclined Plane": ["rail"],
    "Aerial Tramway": ["rail"], "Bus": ["bus"], "Commuter Bus": ["bus"], "Trolleybus": ["bus", "rail"], "Bus Rapid Transit": ["bus", "rail"],
    "Ferryboat": ["ferry"],
}


def _lookup(c: Column, table: dict, default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for key, value in table.items():
        out = out.when(c == key, F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value))
    return out.otherwise(default)


def fingerprint(*columns: Column) -> Column:
    """Aggregate: a text that identifies a set of rows whatever their order. Row digests are added up, so no group is collected."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    part = lambda start: F.sum(F.conv(F.substring(F.md5(text), start, 13), 16, 10).cast("decimal(38,0)"))
    return F.concat_ws("-", F.count("*").cast("string"), part(1).cast("string"), part(14).cast("string"))


def qualified(table: DataFrame, *ids: str) -> DataFrame:
    """The table with its ids made unique over all feeds: ``feed`` joined with the id. Null ids stay null."""
    return table.withColumns({c: F.when(F.col(c).isNotNull(), F.concat_ws(":", F.col("feed").cast("string"), F.col(c).cast("string"))) for c in ids})


def active_services(calendar: DataFrame, exceptions: DataFrame, first=None, last=None) -> DataFrame:
    """(feed, service, date): the weekday flags inside each date range, plus added dates, minus removed ones, clipped to [first, last].

    Both tables carry ``feed``: feeds use the same service ids for different days.
    """
    start = F.col("start_date") if first is None else F.greatest("start_date", F.lit(first).cast("date"))
    end = F.col("end_date") if last is None else F.least("end_date", F.lit(last).cast("date"))
    ranged = calendar.withColumn("_s", start).withColumn("_e", end).filter("_s <= _e")
    days = ranged.select("feed", "service", *clock.WEEKDAYS, F.explode(clock.date_range(F.col("_s"), F.col("_e"))).alias("date"))
    runs = F.element_at(F.array(*[F.col(d) for d in clock.WEEKDAYS]), F.weekday("date") + 1) == 1
    within = F.lit(True)
    if first is not None:
        within = within & (F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        within = within & (F.col("date") <= F.lit(last).cast("date"))
    changes = exceptions.filter(within)
    added = changes.filter("exception_type = 1").select("feed", "service", "date")
    removed = changes.filter("exception_type = 2").select("feed", "service", "date")
    return days.filter(runs).select("feed", "service", "date").union(added).distinct().join(removed, ["feed", "service", "date"], "left_anti")


def trips_per_day(active: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips of every feed on every date; trips are counted per service before the dates multiply them."""
    per_service = trips.groupBy("feed", "service").agg(F.count("*").alias("_n"))
    return active.join(per_service, ["feed", "service"]).groupBy("feed", "date").agg(F.sum("_n").alias("trips"))


def day_volume(counts: DataFrame) -> DataFrame:
    """Ratio of a date's trips to the median of the same weekday, and whether it is a normal day.

    A (feed, weekday) group holds at most one row per week of the calendar.
    """
    usual = counts.groupBy("feed", F.weekday("date").alias("_d")).agg(F.percentile("trips", 0.5).alias("usual"))
    joined = counts.withColumn("_d", F.weekday("date")).join(usual, ["feed", "_d"])
    ratio = F.col("trips") / positive(F.col("usual"))
    return joined.select("feed", "date", "trips", ratio.alias("ratio"), F.coalesce(ratio.between(*VOLUME_RANGE), F.lit(False)).alias("normal"))


def representative_day(counts: DataFrame, day_type: str, pinned: DataFrame | None = None) -> DataFrame:
    """Per feed the busiest date of a day type (the earliest of equals); a pinned date wins."""
    picked = first_row(
        counts.filter(clock.day_type(F.col("date")) == day_type), ["feed"], [-F.col("trips"), F.col("date")], ["date", "trips"]
    )
    if pinned is None:
        return picked
    both = picked.join(pinned.select("feed", F.col("date").alias("_pin")), "feed", "full_outer")
    return both.select("feed", F.coalesce("_pin", "date").alias("date"), F.when(F.col("_pin").isNull() | (F.col("_pin") == F.col("date")), F.col("trips")).alias("trips"))


def scoring_day(counts: DataFrame, shared, day_type: str = "weekday") -> DataFrame:
    """Per feed the day it is scored on: the shared date where it runs normally, else its own representative day (``fallback``)."""
    on_day = day_volume(counts).filter((F.col("date") == F.lit(shared).cast("date")) & F.col("normal")).select("feed", F.lit(True).alias("_ok"))
    own = representative_day(counts, day_type).select("feed", "date")
    joined = own.join(on_day, "feed", "full_outer")
    ok = F.coalesce("_ok", F.lit(False))
    return joined.select("feed", F.when(ok, F.lit(shared).cast("date")).otherwise(F.col("date")).alias("day"), (~ok).alias("fallback"))


def trips_on_scoring_day(trips: DataFrame, active: DataFrame, days: DataFrame) -> DataFrame:
    """All feeds' trips of their own scoring day in one job."""
    services = days.withColumnRenamed("day", "date").join(active, ["feed", "date"]).select("feed", "service", F.col("date").alias("day"), "fallback")
    return skewed_join(trips, services, ["feed", "service"], "inner")


HORIZON_DAYS = 400
"""A calendar that ends before, or begins after, so many days from today is another time's."""


def stops_served(trips: DataFrame, calls: DataFrame, first: int = 6 * 3600, last: int = 22 * 3600) -> DataFrame:
    """(feed, stops, served): stops that the trips (feed, trip) call at, and those with a departure in the window of seconds."""
    at = skewed_join(calls.select("trip", "stop", "sec"), trips.select("feed", "trip"), ["trip"], "inner")
    each = at.groupBy("feed", "stop").agg(F.max(((F.col("sec") >= first) & (F.col("sec") < last)).cast("int")).alias("_in"))
    return each.groupBy("feed").agg(F.count("*").alias("stops"), F.sum("_in").alias("served"))


def feed_audit(counts: DataFrame, picked: DataFrame, today, served: DataFrame | None = None, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Per feed: trips on the picked date, on the busiest and the median working day, calendar limits and a verdict text.

    ``served`` (feed, stops, served) tells whether any stop has service in the window of the day; without it that is not looked at.
    """
    work = counts.filter(clock.day_type(F.col("date")) == "weekday")
    # one number per working day of the calendar: a short list per feed
    stats = work.groupBy("feed").agg(F.max("trips").alias("busiest"), F.sort_array(F.collect_list("trips")).alias("_v"))
    limits = counts.groupBy("feed").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    rows = picked.select("feed", F.col("date").alias("picked")).join(stats, "feed", "left").join(limits, "feed", "left")
    rows = rows.join(work.select("feed", F.col("date").alias("picked"), "trips"), ["feed", "picked"], "left")
    trips = F.coalesce("trips", F.lit(0))
    ratio = trips / positive(F.col("busiest"))
    now = F.lit(today).cast("date")
    rows = rows.join(served.select("feed", "stops", "served"), "feed", "left") if served is not None else rows.withColumns({"stops": F.lit(0), "served": F.lit(0)})
    beyond = (F.col("last") < F.date_sub(now, horizon)) | (F.col("first") > F.date_add(now, horizon))
    problems = F.array(
        F.when(clock.day_type(F.col("picked")) != "weekday", "weekend date"),
        F.when(F.col("trips").isNull(), "no working-day service on the date"),
        F.when(F.col("last") < now, F.concat(F.lit("service over since "), F.col("last").cast("string"))),
        F.when((F.col("picked") < F.col("first")) | (F.col("picked") > F.col("last")), "date not within the calendar"),
        F.when(ratio < 0.8, F.concat(F.round(100 * ratio, 0).cast("int").cast("string"), F.lit("% of the trips of the busiest working day"))),
        F.when((F.col("stops") > 0) & (F.col("served") == 0), "no stop served between 06:00 and 22:00"),
        F.when(beyond, "calendar of another period"),
    )
    text = F.array_join(problems, "; ")
    return rows.select(
        "feed", "picked", trips.alias("trips_on_date"), "busiest", F.element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int")).alias("median"),
        F.round(ratio, 3).alias("ratio_to_busiest"), F.when(text == "", "OK").otherwise(text).alias("verdict"),
    )


def departures(frequencies: DataFrame, offsets: DataFrame) -> DataFrame:
    """Every run of every frequency window at every stop of its trip: (trip, stop, seq, sec)."""
    runs = frequencies.filter("headway > 0 and end > start").select(
        "trip", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.col("headway"))).alias("_go")
    )
    first = offsets.groupBy("trip").agg(F.min("sec").alias("_first"))
    calls = offsets.join(first, "trip").select("trip", "stop", "seq", (F.col("sec") - F.col("_first")).alias("_off"))
    return runs.join(calls, "trip").select("trip", "stop", "seq", (F.col("_go") + F.col("_off")).alias("sec"))


def runs_per_trip(trips: DataFrame, frequencies: DataFrame) -> DataFrame:
    """How often a trip runs: the whole headways of its windows, 1 for a plain trip."""
    runs = frequencies.groupBy("trip").agg(F.sum(F.floor((F.col("end") - F.col("start")) / F.col("headway"))).alias("runs"))
    return trips.join(runs, "trip", "left").withColumn("runs", F.coalesce("runs", F.lit(1)))


def headways(calls: DataFrame, by: Sequence[str], window: tuple[int, int] = DAY_WINDOW) -> DataFrame:
    """Mean wait-based headway in minutes per group: sum of squared gaps over the window, the night counted as one gap.

    Simultaneous departures count once, so a group holds at most one row per second of the window.
    """
    start, end = window
    length = end - start
    inside = calls.filter((F.col("sec") >= start) & (F.col("sec") < end)).select(*by, "sec").distinct()
    w = Window.partitionBy(*by).orderBy("sec")
    gap = F.lead("sec").over(w) - F.col("sec")
    spread = inside.withColumn("_gap", gap.cast("double"))
    night = (F.lit(length) - (F.max("sec") - F.min("sec"))).cast("double")
    total = F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0)) + night * night
    return spread.groupBy(*by).agg((total / length / 60).alias("headway"), F.count("*").alias("departures"))


def along_trip(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """Calls with the metres and seconds from the first call of their trip. A trip is a short, naturally bounded sequence."""
    at = skewed_join(calls, stops.select("stop", "lon", "lat"), ["stop"], "inner")
    w = Window.partitionBy("trip").orderBy("seq")
    step = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")) * 1000
    stepped = at.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_t", F.coalesce(F.col("sec") - F.lag("sec").over(w), F.lit(0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("metres", F.sum("_d").over(run)).withColumn("seconds", F.sum("_t").over(run)).drop("_d", "_t")


def trip_durations(calls: DataFrame) -> DataFrame:
    """Last arrival minus first departure."""
    return calls.groupBy("trip").agg((F.max_by("sec", "seq") - F.min_by("sec", "seq")).alias("duration"))


def dedupe_trips(trips: DataFrame, calls: DataFrame, same: Sequence[str]) -> DataFrame:
    """Trips that make the same calls at the same times within ``same`` kept once, the smallest id staying."""
    marks = calls.groupBy("trip").agg(fingerprint(F.col("seq"), F.col("stop"), F.col("sec")).alias("_mark"))
    marked = trips.join(marks, "trip")
    return first_row(marked, [*same, "_mark"], [F.col("trip")], [c for c in trips.columns if c not in same]).drop("_mark").select(*trips.columns)


def scoring_modes(routes: DataFrame, agency_modes: DataFrame) -> DataFrame:
    """bus, tram or rail of every route: the agency's single mode unless the feed's route types contradict it (a missing type is one of its own); rapid bus is always tram."""
    own = route_mode(F.col("route_type"))
    types = routes.groupBy("feed").agg(F.count_distinct(F.coalesce("route_type", F.lit("none"))).alias("_types"))
    modes = agency_modes.groupBy("feed").agg(F.count_distinct("mode_name").alias("_modes"), F.max("mode_name").alias("_name"))
    joined = skewed_join(skewed_join(routes, types, ["feed"]), modes, ["feed"])
    default = F.when(F.col("_modes") == 1, _lookup(F.col("_name"), AGENCY_MODES, F.lit(None).cast("string")))
    contradiction = (F.col("_types") > 1) & default.isNotNull()
    rapid = F.col("route_type").try_cast("int") == 702
    mode = F.when(rapid, "tram").when(contradiction | default.isNull(), own).otherwise(default)
    return joined.select(*routes.columns, mode.alias("mode"), F.coalesce(contradiction, F.lit(False)).alias("contradiction"))


def feed_problems(routes: DataFrame, agency_modes: DataFrame) -> DataFrame:
    """Per feed why it cannot stand for the agency modes it was matched to; null is fine. The kinds of a feed are at most three."""
    have = routes.select("feed", F.explode(route_kinds(F.col("route_type"))).alias("k")).groupBy("feed").agg(F.sort_array(F.collect_set("k")).alias("have"))
    kinds = _lookup(F.col("mode_name"), AGENCY_KINDS, F.array().cast("array<string>"))
    need = agency_modes.select("feed", F.explode(kinds).alias("k")).groupBy("feed").agg(F.sort_array(F.collect_set("k")).alias("need"))
    rows = agency_modes.select("feed").distinct().join(need, "feed", "left").join(have, "feed", "left")
    reason = (
        F.when(F.col("need").isNull(), F.lit(None))
        .when(F.col("have").isNull(), "feed has no usable routes")
        .when(~F.arrays_overlap("need", "have"), F.concat(F.lit("needs "), F.array_join("need", "/"), F.lit(" but has only "), F.array_join("have", "/")))
    )
    return rows.select("feed", reason.alias("problem"))


def unserved_modes(agency_modes: DataFrame, problems: DataFrame) -> DataFrame:
    """(agency, mode) pairs that end without any valid feed."""
    valid = problems.filter(F.col("problem").isNull()).select("feed")
    served = agency_modes.join(valid, "feed", "left_semi").select("agency", "mode_name").distinct()
    return agency_modes.select("agency", "mode_name").distinct().join(served, ["agency", "mode_name"], "left_anti")


def feed_resolutions(broken: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """How each broken agency feed was replaced: the first source that has the agency, else unresolved."""
    rows, label = broken, F.lit(None).cast("string")
    for name, source in sources:
        rows = rows.join(source.select("agency").distinct().withColumn(f"_{name}", F.lit(True)), "agency", "left")
        label = F.coalesce(label, F.when(F.col(f"_{name}"), name))
    return rows.select(*broken.columns, F.coalesce(label, F.lit("unresolved")).alias("resolution"))


def kept_feed_rows(expected: DataFrame, dropped: DataFrame) -> DataFrame:
    """Expected agency rows of dropped duplicate feeds moved to the feed kept in their place, each once."""
    moved = expected.join(dropped.select(F.col("dropped").alias("feed"), "kept"), "feed", "left")
    return moved.withColumn("feed", F.coalesce("kept", "feed")).drop("kept").distinct()


def stop_groups(stops: DataFrame, metres: float = GROUP_METRES) -> DataFrame:
    """Group key such that no two stops of a group are farther apart than ``metres``: squares whose diagonal is that long."""
    side = metres / 2**0.5
    row = F.floor(F.col("lat") * F.lit(grid.METRES_PER_DEGREE / side))
    # the widest parallel of the row decides the number of columns, so cells never exceed the side
    south = row * F.lit(side / grid.METRES_PER_DEGREE)
    widest = F.greatest(F.cos(F.radians(south)), F.cos(F.radians(south + F.lit(side / grid.METRES_PER_DEGREE))))
    col = F.floor(F.col("lon") * F.lit(grid.METRES_PER_DEGREE / side) * widest)
    return stops.withColumn("group", F.concat_ws("_", row.cast("string"), col.cast("string")))


def area_fingerprints(stops: DataFrame, area: str) -> DataFrame:
    """Per area the fingerprint of its scored stops (coordinates to 1e-6, score to 1e-4)."""
    micro = lambda c, k: F.round(F.col(c) * k).cast("long")
    return stops.groupBy(area).agg(fingerprint(micro("lat", 1_000_000), micro("lon", 1_000_000), micro("score", 10_000)).alias("mark"))


def changed_areas(now: DataFrame, before: DataFrame, area: str) -> DataFrame:
    return now.join(before, [area, "mark"], "left_anti").select(area)


def stop_table(stops: DataFrame, stations: DataFrame, stop_routes: DataFrame) -> DataFrame:
    """Every real stop with its station's scores and its own routes, once per (stop, place). ``stop_routes`` has (stop, route) pairs."""
    lists = stop_routes.select("stop", "route").distinct().groupBy("stop").agg(F.sort_array(F.collect_list("route")).alias("routes"))
    joined = stops.join(stations, "station", "left").join(lists, "stop", "left")
    rest = [c for c in joined.columns if c not in ("stop", "lon", "lat")]
    # of several stations at one stop and place the least id
    return first_row(joined, ["stop", "lon", "lat"], [F.col("station")], rest).select(*joined.columns)


def feed_marks(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """One mark per feed from its stops and routes; copies of a feed share it."""
    s = stops.groupBy("feed").agg(fingerprint(F.col("stop")).alias("_s"))
    r = routes.groupBy("feed").agg(fingerprint(F.col("route")).alias("_r"))
    return s.join(r, "feed", "full_outer").select("feed", F.concat_ws("/", F.coalesce("_s", F.lit("")), F.coalesce("_r", F.lit(""))).alias("mark"))


def keep_first_tier(feeds: DataFrame, marks: DataFrame) -> DataFrame:
    """Of feeds with one mark only the one of the lowest tier (then smallest id): later sources add what earlier ones miss."""
    return first_row(feeds.join(marks, "feed"), ["mark"], [F.col("tier"), F.col("feed")], feeds.columns).select(*feeds.columns)


COPY_SHARE = 0.9
"""Of the smaller feed's stops so many are shared with the larger one, at least, if one is a copy of the other."""
SHARED_RARE = 10
"""Stops that two feeds must share among the smaller one's rarest ones before they are counted in full; changes no result."""


def overlapping_feeds(stops: DataFrame, share: float = COPY_SHARE) -> DataFrame:
    """(small, large, shared): pairs of feeds where at least ``share`` of the stops of the one with fewer are also the other's.

    The feed with fewer stops can miss few of them, so of its rarest stops (as many as it may miss, and ``SHARED_RARE`` more) at least
    ``SHARED_RARE`` are the other's, or all that it must share if these are fewer: only the rarest are joined, and only pairs that meet there that
    often are counted in full. Feeds with equal sets should be one feed before (``copied_feeds`` sees to it).
    """
    own = stops.select("feed", "stop").distinct()
    sizes = own.groupBy("feed").agg(F.count("*").alias("_n"))
    rarity = own.groupBy("stop").agg(F.count("*").alias("_f"))
    each = skewed_join(own, rarity, ["stop"], "inner").join(sizes, "feed")
    must = F.ceil(F.col("_n") * share - F.lit(1e-9))
    asked = F.greatest(F.lit(1), F.least(F.lit(SHARED_RARE), must))
    place = F.row_number().over(Window.partitionBy("feed").orderBy("_f", "stop"))  # the stops of one feed
    rare = each.withColumn("_p", place).filter(F.col("_p") <= F.col("_n") - must + asked).select(F.col("feed").alias("small"), F.col("_n").alias("_ns"), asked.alias("_asked"), "stop")
    other = each.select(F.col("feed").alias("large"), F.col("_n").alias("_nl"), "stop")
    order = (F.col("_ns") < F.col("_nl")) | ((F.col("_ns") == F.col("_nl")) & (F.col("small") < F.col("large")))
    met = rare.join(other, "stop").filter(order).groupBy("small", "large", "_ns", "_asked").agg(F.count("*").alias("_met"))
    met = met.filter(F.col("_met") >= F.col("_asked")).select("small", "large", "_ns")
    shared = met.join(own.withColumnRenamed("feed", "small"), "small").join(own.withColumnRenamed("feed", "large"), ["large", "stop"], "left_semi")
    counted = shared.groupBy("small", "large", "_ns").agg(F.count("*").alias("shared"))
    return counted.filter(F.col("shared") >= F.col("_ns") * share - 1e-9).select("small", "large", "shared")


def copied_feeds(feeds: DataFrame, stops: DataFrame, routes: DataFrame, operators: DataFrame, share: float = COPY_SHARE) -> DataFrame:
    """(feed, kept, reason): feeds that copy one of an earlier tier (then smaller id), with the earliest feed they copy.

    A copy has the same stops and routes, the same operators (of feeds that name any), or nearly all stops of the smaller one in common. Feeds with
    equal marks are compared with the earliest of them only, so a thousand copies are a thousand rows and not a million pairs.
    """
    marks = feed_marks(stops, routes).select("feed", F.concat(F.lit("c"), "mark").alias("mark"))
    names = operators.filter(F.col("operator").isNotNull()).select("feed", "operator").distinct().groupBy("feed").agg(fingerprint(F.col("operator")).alias("mark"))
    both = marks.select("feed", "mark", F.lit("content").alias("reason")).unionByName(names.select("feed", F.concat(F.lit("o"), "mark").alias("mark"), F.lit("operators").alias("reason")))
    placed = both.join(feeds.select("feed", "tier"), "feed")
    first = placed.groupBy("mark").agg(F.min(F.struct("tier", "feed")).alias("_b"))
    equal = skewed_join(placed, first, ["mark"], "inner").filter(F.col("_b.feed") != F.col("feed")).select("feed", F.col("_b").alias("_k"), "reason")
    distinct = feeds.select("feed", "tier").join(equal.filter("reason = 'content'").select("feed"), "feed", "left_anti")
    pairs = overlapping_feeds(stops.join(distinct.select("feed"), "feed", "left_semi"), share)
    a, b = distinct.select(F.col("feed").alias("small"), F.struct("tier", "feed").alias("_s")), distinct.select(F.col("feed").alias("large"), F.struct("tier", "feed").alias("_l"))
    near = pairs.join(a, "small").join(b, "large").select(F.greatest("_s", "_l")["feed"].alias("feed"), F.least("_s", "_l").alias("_k"), F.lit("overlap").alias("reason"))
    every = equal.unionByName(near)
    return every.groupBy("feed").agg(F.min(F.struct("_k", "reason")).alias("_m")).select("feed", F.col("_m._k.feed").alias("kept"), F.col("_m.reason").alias("reason"))


def keep_local_feeds(feeds: DataFrame, copies: DataFrame) -> DataFrame:
    """Feeds that copy no earlier one: the more local source wins."""
    return feeds.join(copies.select("feed"), "feed", "left_anti")


def feed_boxes(stops: DataFrame) -> DataFrame:
    return stops.groupBy("feed").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count("*").alias("stops")
    )


def trim_table(df: DataFrame) -> DataFrame:
    """Padded headers and fields without their blanks and byte-order mark."""
    cleaned = [F.trim(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿").strip()) for c in df.columns]
    return df.select(*cleaned)


def original_route(route: Column, file_id: Column) -> Column:
    """The feed's own id of a route renamed to ``<id>_file_<n>``."""
    return F.trim(F.regexp_replace(route, F.concat(F.lit("_file_"), file_id.cast("string"), F.lit("$")), F.lit("")))


def route_modes(routes: DataFrame, modes: DataFrame) -> DataFrame:
    """Mode of every loaded route by (own id, file, type), else by its type. ``modes``: (route, file_id, route_type, mode)."""
    keyed = routes.withColumn("_id", original_route(F.col("route"), F.col("file_id")))
    m = modes.groupBy(F.trim("route").alias("_id"), "file_id", "route_type").agg(F.min("mode").alias("_mode"))
    return keyed.join(m, ["_id", "file_id", "route_type"], "left").select(
        *routes.columns, F.coalesce("_mode", route_mode(F.col("route_type"))).alias("mode")
    )


def route_names(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Stops with their route ids turned to display names: the own feed's name, any feed's name, else the raw id; each name once, in order.

    ``routes`` has (feed, route, name); the items of one stop are regrouped from distinct (stop, name) pairs.
    """
    own = routes.groupBy("feed", "route").agg(F.min("name").alias("_own"))
    anywhere = routes.groupBy("route").agg(F.min_by("name", "feed").alias("_any"))
    items = stops.select("stop", "feed", F.posexplode(F.split("route_ids", ";")).alias("_p", "_raw"))
    items = items.withColumn("route", F.regexp_replace(F.trim("_raw"), r"_file_\d+$", "")).filter("route <> ''")
    named = skewed_join(skewed_join(items, own, ["feed", "route"]), anywhere, ["route"])
    named = named.withColumn("_name", F.coalesce("_own", "_any", "route"))
    once = named.groupBy("stop", "_name").agg(F.min("_p").alias("_p"))
    lists = once.groupBy("stop").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_name"))), lambda x: x["_name"]).alias("_l"))
    return stops.join(lists, "stop", "left").withColumn("labels", F.array_join("_l", ",")).drop("_l")


def repair_names(stations: DataFrame, names: DataFrame) -> DataFrame:
    """A station named like its id takes the name its feeds' stop tables give that id."""
    clean = F.regexp_replace(F.trim("station"), r"_file_\d+$", "")
    best = names.filter("name <> ''").groupBy(F.col("stop").alias("_id")).agg(F.min("name").alias("_new"))
    joined = stations.withColumn("_id", clean).join(best, "_id", "left")
    fixed = F.when(F.col("name") == F.col("station"), F.coalesce("_new", "name")).otherwise(F.col("name"))
    return joined.withColumn("name", fixed).drop("_id", "_new")

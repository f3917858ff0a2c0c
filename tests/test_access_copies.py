"""Far stations, caps, copies of feeds, boxes, clipped lines and audits against small hand-made cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.functions.curves import DEFAULT
from stopfield.operators import access, gtfs, match, spatial
from stopfield.plans.vehicle_km import vehicle_km
from tests.test_spatial import STAR, inside, metres, star


def test_far_items_and_the_default_detour(spark):
    cells = spark.createDataFrame([(1, 2.0, 41.0)], "cell int, lon double, lat double")
    stations = spark.createDataFrame([(10, 2.001, 41.0, 0.55), (11, 2.002, 41.0, 0.58), (12, 2.004, 41.0, 0.9), (13, 2.5, 41.0, 0.7), (14, 2.0, 41.0, 0.1)], "station int, lon double, lat double, score double")
    items = spark.createDataFrame([(1, 12, 400.0)], "cell int, station int, dist double")
    bands = [(0.5, 0.6), (0.6, 0.8), (0.8, 9.0)]
    assert access.detour_factor(items.limit(0), cells, stations) == 1.3
    walked = 400.0 / metres(2.0, 41.0, 2.004, 41.0)
    assert abs(access.detour_factor(items, cells, stations) - walked) < 1e-9
    got = access.far_items(cells, stations, items, "score", bands, 3000.0, detour=1.3).collect()
    assert [(r.cell, r.band, r.station) for r in got] == [(1, 0, 10)]  # the best band's station is the cell's own, the middle band's is too far
    assert abs(got[0].dist - 1.3 * metres(2.0, 41.0, 2.001, 41.0)) < 1e-6


def test_caps_in_one_fold_against_each_cap_alone(spark):
    rnd = random.Random(3)
    items = [(c, s, float(rnd.randint(0, 900))) for c in range(12) for s in rnd.sample(range(20), rnd.randint(1, 9))]
    patterns = [(s, rnd.choice(["bus", "tram", "rail"]), float(rnd.randint(2, 60)), float(rnd.randint(8, 50))) for s in range(20) for _ in range(3)]
    i, p = spark.createDataFrame(items, "cell int, station int, dist double"), spark.createDataFrame(patterns, "station int, mode string, h double, v double")
    sets = {"a": DEFAULT, "b": DEFAULT.with_(walk_power=3.0)}
    together = {r.cap: r for r in access.cell_cap_metrics(i, p, [1, 3, 100], sets, ["bus", "tram", "rail"]).collect()}
    for cap in together:
        assert access.cell_cap_metrics(i, p, [cap], sets, ["bus", "tram", "rail"]).collect() == [together[cap]]
    all_kept = together[100]
    assert (all_kept.cut_share, all_kept.winner_kept, all_kept.mean_error, all_kept.stations_kept) == (0, 1, 0, 1)
    assert together[1].mean_error >= together[3].mean_error > 0 and together[1].stations_kept < together[3].stations_kept
    counts = {c: len([x for x in items if x[0] == c]) for c in range(12)}
    assert abs(together[3].cut_share - sum(n > 3 for n in counts.values()) / 12) < 1e-12


def test_a_feed_with_one_changed_stop_is_a_copy(spark):
    stops = [("a", i) for i in range(40)] + [("b", i) for i in range(1, 41)] + [("c", i) for i in range(0, 80, 2)] + [("d", i) for i in range(5)] + [("e", i) for i in range(40)] + [("f", 900)]
    feeds = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 3), ("e", 3), ("f", 9), ("g", 9)], "feed string, tier int")
    routes = spark.createDataFrame([(f, "r") for f in "abcde"] + [("f", "q")], "feed string, route string")
    operators = spark.createDataFrame([("c", "x"), ("f", "x"), ("a", None), ("d", "y"), ("d", "x")], "feed string, operator string")
    s = spark.createDataFrame(stops, "feed string, stop int")
    got = {r.feed: (r.kept, r.reason) for r in gtfs.copied_feeds(feeds, s, routes, operators).collect()}
    assert got == {"a": ("b", "overlap"), "e": ("a", "content"), "d": ("a", "overlap"), "f": ("c", "operators")}
    assert {r.feed for r in gtfs.keep_local_feeds(feeds, gtfs.copied_feeds(feeds, s, routes, operators)).collect()} == {"b", "c", "g"}


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(5)
    sets = {f: set(rnd.sample(range(30), rnd.randint(3, 25))) for f in range(25)}
    for f in range(25, 40):
        base = set(sets[rnd.randrange(25)])
        base.discard(next(iter(base)))
        sets[f] = base | {rnd.randrange(30)}
    rows = spark.createDataFrame([(f, s) for f, ss in sets.items() for s in ss], "feed int, stop int")
    for share in (0.9, 0.6):
        got = {frozenset((r.small, r.large)): r.shared for r in gtfs.overlapping_feeds(rows, share).collect()}
        want = {frozenset((a, b)): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= share * min(len(sets[a]), len(sets[b])) - 1e-9}
        assert got == want


def test_feeds_that_share_few_rare_stops_are_not_counted(spark):
    rnd = random.Random(9)
    sets = {f: set(rnd.sample(range(600), 120)) for f in range(40)}
    sets[40] = set(list(sets[0])[:100])
    sets[41] = set(list(sets[1])[:108]) | set(range(700, 712))  # 108 of 120
    sets[42] = set(list(sets[2])[:107]) | set(range(720, 733))  # one stop too few
    stops = spark.createDataFrame([(f, s) for f, ss in sets.items() for s in ss], "feed int, stop int")
    found = gtfs.overlapping_feeds(stops)
    assert {(r.small, r.large, r.shared) for r in found.collect()} == {(40, 0, 100), (1, 41, 108)}
    assert "_met#" in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are cut before their stops are joined


def test_boxes_of_one_name_and_place_list_their_first_entries(spark):
    rnd = random.Random(11)
    places = spark.createDataFrame([(i, rnd.choice(["Red Line", "Blue Bus"]), rnd.uniform(0, 4), rnd.uniform(0, 4)) for i in range(40)], "place int, name string, lon double, lat double")
    rows = [(rnd.randrange(120), rnd.choice(["Red Line", "Blue", None]), *rnd.choice([(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 4.0, 4.0)])) for _ in range(300)]
    boxes = spark.createDataFrame(rows, "entry int, name string, west double, south double, east double, north double")
    every = {}
    for r in match.box_candidates(places, boxes).collect():
        every.setdefault(r.place, []).append((-round(r.similarity, 9), r.entry))
    want = {(p, e, n + 1) for p, found in every.items() for n, (_, e) in enumerate(sorted(found)[:3])}
    top = match.box_candidates(places, boxes, 3)
    assert {(r.place, r.entry, r["rank"]) for r in top.collect()} == want
    assert "_entries" in top._jdf.queryExecution().analyzed().toString()


def test_many_equal_feeds_make_no_pairs(spark):
    feeds = spark.range(300).select(F.col("id").alias("feed"), F.lit(1).alias("tier"))
    stops = feeds.select("feed", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("stop"))
    none = spark.createDataFrame([], "feed long, operator string")
    got = gtfs.copied_feeds(feeds, stops, feeds.select("feed", F.lit("r").alias("route")), none).collect()
    assert len(got) == 299 and {(r.kept, r.reason) for r in got} == {(0, "content")}


def test_boxes_of_all_sizes(spark):
    rnd = random.Random(7)
    places = [(i, f"City Bus {i}", rnd.uniform(-179, 179), rnd.uniform(-80, 80)) for i in range(120)] + [(500, None, 1.0, 1.0), (501, "x", None, 1.0)]
    boxes = []
    for k in range(200):
        w, s, d = rnd.uniform(-180, 170), rnd.uniform(-85, 70), rnd.choice([0.0, 0.01, 1.0, 30.0, 170.0])
        boxes.append((k % 150, f"City {k}", w, s, min(180.0, w + d), min(90.0, s + d / 2)))
    boxes += [(900, "world", -180.0, -90.0, 180.0, 90.0), (901, "turned", 5.0, 5.0, 1.0, 1.0), (902, None, 0.0, 0.0, 2.0, 2.0), (903, "point", 1.0, 1.0, 1.0, 1.0)]
    p, b = spark.createDataFrame(places, "place int, name string, lon double, lat double"), spark.createDataFrame(boxes, "entry int, name string, west double, south double, east double, north double")
    got = {(r.place, r.entry): r.similarity for r in match.box_candidates(p, b).collect()}
    want = {(i, e) for i, _, x, y in places if x is not None for e, _, w, s, ea, no in boxes if w <= x <= ea and s <= y <= no}
    assert set(got) == want and (500, 902) in want and got[500, 902] == 0
    top = match.box_candidates(p, b, 2).collect()
    for i in {k[0] for k in want}:
        best = sorted([(-round(v, 9), e) for (q, e), v in got.items() if q == i])[:2]
        assert [(-round(r.similarity, 9), r.entry) for r in sorted((r for r in top if r.place == i), key=lambda r: r["rank"])] == best


@pytest.mark.parametrize("res", [5, 9, 13])
def test_lines_are_cut_at_a_ragged_border(spark, res):
    rnd = random.Random(11)
    lines = [(i, rnd.uniform(1.7, 2.7), rnd.uniform(40.8, 41.7), rnd.uniform(1.7, 2.7), rnd.uniform(40.8, 41.7)) for i in range(25)]
    lines += [(100, 2.1, 41.1, 2.1, 41.1), (101, 2.2, 40.9, 2.2, 41.6), (102, 1.8, 41.15, 2.6, 41.15), (103, 9.0, 9.0, 9.1, 9.1)]
    got = {r.line: r.km for r in spatial.lines_inside(spark.createDataFrame(lines, "line int, x1 double, y1 double, x2 double, y2 double"), ["line"], star(spark), "area", res).collect()}
    n = 20_000
    for i, x1, y1, x2, y2 in lines:
        share = sum(inside(x1 + (x2 - x1) * (k + 0.5) / n, y1 + (y2 - y1) * (k + 0.5) / n) for k in range(n)) / n
        want = metres(x1, y1, x2, y2) / 1000 * share
        assert abs(got.get(i, 0.0) - want) < 0.02, (i, got.get(i), want)


def test_parts_of_neighbours_add_up(spark):
    ring = lambda w, e: F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(w, 40.0), (e, 40.0), (e, 43.0), (w, 43.0), (w, 40.0)]])
    areas = spark.range(2).select(F.col("id").alias("area"), F.when(F.col("id") == 0, ring(1.0, 2.13)).otherwise(ring(2.13, 4.0)).alias("ring"))
    line = spark.createDataFrame([(1, 1.5, 41.2, 3.7, 41.9)], "line int, x1 double, y1 double, x2 double, y2 double")
    got = {r.area: r.km for r in spatial.lines_inside(line, ["line"], areas, "area", 8).collect()}
    whole = metres(1.5, 41.2, 3.7, 41.9) / 1000
    assert abs(sum(got.values()) - whole) < 1e-9 and abs(got[0] / whole - 0.63 / 2.2) < 1e-9


def test_vehicle_km_follows_shapes_and_falls_back_to_stops(spark):
    trips = spark.createDataFrame([("t1", "f", "s", "a"), ("t2", "f", "s", "a"), ("t3", "f", "s", None), ("t4", "f", "s", "gone"), ("t5", "f", "off", "a")], "trip string, feed string, service string, shape string")
    calls = spark.createDataFrame([(t, i + 1, s) for t in ("t1", "t3", "t4") for i, s in enumerate("pq")], "trip string, seq int, stop string")
    stops = spark.createDataFrame([("p", 2.1, 41.1), ("q", 2.2, 41.1)], "stop string, lon double, lat double")
    shapes = spark.createDataFrame([("a", 1, 2.1, 41.1), ("a", 2, 2.1, 41.2), ("a", 3, 2.2, 41.2)], "shape string, seq int, lon double, lat double")
    frequency = spark.createDataFrame([("t2", 0, 3600, 600)], "trip string, start int, end int, headway int")
    days = ", ".join(f"{d} int" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    calendar = spark.createDataFrame([("f", "s", *[1] * 7, "2024-01-01", "2024-01-31")], f"feed string, service string, {days}, start_date string, end_date string").withColumn("start_date", F.col("start_date").cast("date")).withColumn("end_date", F.col("end_date").cast("date"))
    none = spark.createDataFrame([], "feed string, service string, date date, exception_type int")
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(1.0, 40.0), (2.15, 40.0), (2.15, 43.0), (1.0, 43.0), (1.0, 40.0)]])
    area = spark.range(1).select(F.lit("west").alias("area"), ring.alias("ring"))
    row = vehicle_km(trips, calls, stops, frequency, calendar, none, "2024-01-10", area, "area", 8, shapes).first()
    shape = metres(2.1, 41.1, 2.1, 41.2) / 1000 + metres(2.1, 41.2, 2.2, 41.2) / 2000
    straight = metres(2.1, 41.1, 2.2, 41.1) / 2000
    assert row.trips == 4 and abs(row.vehicle_km - (shape * 7 + straight * 2)) < 1e-6


def test_audit_names_all_seven_reasons(spark):
    counts = spark.createDataFrame([("a", "2024-01-10", 10), ("a", "2024-01-11", 100), ("b", "2024-01-10", 5)], "feed string, date string, trips int").withColumn("date", F.col("date").cast("date"))
    picked = spark.createDataFrame([("a", "2024-01-10"), ("b", "2024-03-02")], "feed string, date string").withColumn("date", F.col("date").cast("date"))
    served = spark.createDataFrame([("a", 4, 0)], "feed string, stops int, served int")
    got = {r.feed: r.verdict.split("; ") for r in gtfs.feed_audit(counts, picked, "2026-01-01", served).collect()}
    assert got["a"] == ["service over since 2024-01-11", "10% of the trips of the busiest working day", "no stop served between 06:00 and 22:00", "calendar of another period"]
    assert got["b"] == ["weekend date", "no working-day service on the date", "service over since 2024-01-10", "date not within the calendar", "0% of the trips of the busiest working day", "calendar of another period"]


def test_nearest_cell_of_the_last_level(spark):
    cells = spark.createDataFrame([(2.0, 41.0, 5.0), (2.01, 41.0, 7.0), (30.0, 10.0, 50.0)], "lon double, lat double, population double").select(grid.cell(F.col("lon"), F.col("lat"), 16).alias("cell"), "population")
    units = spark.createDataFrame([(1, 2.0, 41.0), (2, 3.0, 42.0), (3, 29.0, 11.0)], "id int, lon double, lat double")
    got = {r.id: r.population for r in spatial.fill_from_levels(units, "id", cells, "population", [16, 12], 16, 9).collect()}
    assert got == {1: 5.0, 2: 6.0, 3: 50.0} and math.isclose(got[2], 6.0) and len(STAR) == 7

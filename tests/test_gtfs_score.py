import itertools
import random

import pytest
from pyspark.sql import functions as F

from stopfield.functions.curves import DEFAULT
from stopfield.operators import gtfs, match, score, timetable


def calendar(spark):
    return spark.createDataFrame([("f", "wd", 1, 1, 1, 1, 1, 0, 0, "2026-10-01", "2026-10-15"), ("f", "sa", 0, 0, 0, 0, 0, 1, 0, "2026-10-01", "2026-10-15")],
                                 "feed string, service string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, s string, e string").select(
        "*", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))


def test_calendar_exceptions(spark):
    ex = spark.createDataFrame([("f", "wd", "2026-10-07", 2), ("f", "wd", "2026-10-10", 1), ("f", "new", "2026-11-01", 1)], "feed string, service string, d string, exception_type int").select("feed", "service", F.to_date("d").alias("date"), "exception_type")
    got = {(r["service"], str(r["date"])) for r in gtfs.active_services(calendar(spark), ex).collect()}
    assert ("wd", "2026-10-07") not in got and ("wd", "2026-10-10") in got and ("new", "2026-11-01") in got and ("sa", "2026-10-10") in got
    assert ("wd", "2026-10-08") in got and ("wd", "2026-10-11") not in got
    one = gtfs.active_services(calendar(spark), ex, "2026-10-10", "2026-10-10").collect()
    assert {r["service"] for r in one} == {"wd", "sa"}


def test_one_service_id_in_two_feeds(spark):
    flags = "monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int"
    cal = spark.createDataFrame([("a", "WK", *[1] * 7, "2026-01-01", "2026-01-05"), ("b", "WK", *[1] * 7, "2026-02-05", "2026-02-06")], f"feed string, service string, {flags}, s string, e string")
    cal = cal.select("*", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    ex = spark.createDataFrame([("a", "WK", "2026-01-03", 2)], "feed string, service string, d string, exception_type int").select("feed", "service", F.to_date("d").alias("date"), "exception_type")
    active = gtfs.active_services(cal, ex)
    got = {(r["feed"], str(r["date"])) for r in active.collect()}
    assert got == {("a", f"2026-01-0{i}") for i in (1, 2, 4, 5)} | {("b", "2026-02-05"), ("b", "2026-02-06")}
    trips = spark.createDataFrame([("a", "WK", 1), ("a", "WK", 2), ("b", "WK", 1)], "feed string, service string, trip int")
    counts = {(r["feed"], str(r["date"])): r["trips"] for r in gtfs.trips_per_day(active, trips).collect()}
    assert counts[("a", "2026-01-01")] == 2 and counts[("b", "2026-02-05")] == 1 and len(counts) == 6
    assert {r["trip"] for r in gtfs.qualified(trips, "trip").collect()} == {"a:1", "a:2", "b:1"}


def test_hourly_trips_have_their_headway(spark):
    secs = [8 * 3600 + i * 3600 for i in range(8)]
    df = spark.createDataFrame([("a", s) for s in secs + secs], "stop string, sec int")   # published twice: counts once
    h = gtfs.headways(df, ["stop"]).first()
    night = 16 * 3600 - 7 * 3600
    assert abs(h["headway"] - (7 * 3600**2 + night**2) / (16 * 3600) / 60) < 1e-9 and h["departures"] == 8


def test_frequencies_repeat_the_trip(spark):
    f = spark.createDataFrame([("t", 0, 3600, 600)], "trip string, start int, end int, headway int")
    calls = spark.createDataFrame([("t", 1, "a", 100), ("t", 2, "b", 400)], "trip string, seq int, stop string, sec int")
    got = gtfs.departures(f, calls).filter("stop = 'b'").orderBy("sec").collect()
    assert [r["sec"] for r in got] == [300 + 600 * i for i in range(6)]


def test_same_id_in_two_feeds_keeps_its_own_mode(spark):
    loaded = spark.createDataFrame([("1_file_0", 0, "3"), ("1_file_1", 1, "2"), ("C1  ", 1, "2"), ("zz", 0, "702")], "route string, file_id int, route_type string")
    modes = spark.createDataFrame([("1", 0, "3", "bus"), ("1", 1, "2", "rail"), ("C1", 1, "2", "rail")], "route string, file_id int, route_type string, mode string")
    assert {r["route"]: r["mode"] for r in gtfs.route_modes(loaded, modes).collect()} == {"1_file_0": "bus", "1_file_1": "rail", "C1  ": "rail", "zz": "tram"}


def test_a_ferry_feed_cannot_stand_for_heavy_rail(spark):
    routes = spark.createDataFrame([("f", "4"), ("g", "1")], "feed string, route_type string")
    agencies = spark.createDataFrame([("f", "A", "Heavy Rail"), ("g", "A", "Heavy Rail"), ("h", "B", "Bus")], "feed string, agency string, mode_name string")
    problems = {r["feed"]: r["problem"] for r in gtfs.feed_problems(routes, agencies).collect()}
    assert "ferry" in problems["f"] and problems["g"] is None and problems["h"] == "feed has no usable routes"


def test_no_two_stops_of_a_group_are_far_apart(spark):
    rnd = random.Random(1)
    pts = [(i, 2 + rnd.random() * 0.02, 41 + rnd.random() * 0.02) for i in range(300)]
    got = gtfs.stop_groups(spark.createDataFrame(pts, "id int, lon double, lat double")).collect()
    from stopfield.functions.grid import METRES_PER_DEGREE
    import math

    for _, members in itertools.groupby(sorted(got, key=lambda r: r["group"]), key=lambda r: r["group"]):
        for a, b in itertools.combinations(list(members), 2):
            dx = (a["lon"] - b["lon"]) * METRES_PER_DEGREE * math.cos(math.radians(41.01))
            assert math.hypot(dx, (a["lat"] - b["lat"]) * METRES_PER_DEGREE) <= 150.5


def test_fingerprints_ignore_order_but_not_content(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0, 5.0), ("x", 3.0, 4.0, 6.0)], "area string, lat double, lon double, score double")
    same, other = gtfs.area_fingerprints(a.orderBy(F.desc("lat")), "area"), gtfs.area_fingerprints(a.withColumn("score", F.col("score") + 1), "area")
    now = gtfs.area_fingerprints(a, "area")
    assert gtfs.changed_areas(now, same, "area").count() == 0 and gtfs.changed_areas(now, other, "area").count() == 1


def brute(headways, speeds):
    tiers = [("bus", {"bus", "tram", "rail"}), ("tram", {"tram", "rail"}), ("rail", {"rail"})]
    lin = lambda x, xs, ys: ys[0] if x <= xs[0] else ys[-1] if x >= xs[-1] else next(y0 + (x - x0) * (y1 - y0) / (x1 - x0) for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]) if x <= x1)
    best = None
    for name, modes in tiers:
        rows = [s for s in speeds if s[1] in modes]
        kmh = {s[0]: None if s[2] is None else s[2] / 1000 / (s[3] / 3600) for s in rows}
        cuts = sorted({int(v // 2) * 2 for v in kmh.values() if v is not None}) or ([0] if rows else [])
        for cut in cuts:
            kept = {r for r, v in kmh.items() if v is None or v >= cut}
            known = [s for s in rows if s[0] in kept and s[2] is not None]
            per = {}
            for r, d, h in headways:
                if r in kept:
                    per.setdefault(d, []).append(1 / h)
            if not known or not per:
                continue
            speed = sum(s[2] for s in known) / 1000 / (sum(s[3] for s in known) / 3600)
            headway = min(1 / sum(v) for v in per.values())
            value = DEFAULT.mode[name] * lin(headway, *DEFAULT.headway) * lin(speed, *DEFAULT.speed)
            if best is None or value > best[0] + 1e-12:
                best = (value, name, cut, frozenset(kept))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_best_subset_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    speeds, heads = [], []
    for st in range(6):
        for r in range(rnd.randint(1, 7)):
            speeds.append((st, r, rnd.choice(["bus", "tram", "rail"]), None if rnd.random() < 0.2 else rnd.uniform(2000, 40000), 3600.0))
            heads += [(st, r, d, float(rnd.randint(3, 60))) for d in range(rnd.randint(1, 2))]
    got = score.best_subset(spark.createDataFrame(heads, "station int, route int, direction int, headway double"), spark.createDataFrame(speeds, "station int, route int, mode string, distance double, time double"))
    got = {r["station"]: (round(r["score"], 9), r["tier"], int(r["min_speed"]), frozenset(int(x) for x in r["route_ids"])) for r in got.collect()}
    want = {}
    for st in range(6):
        b = brute([h[1:] for h in heads if h[0] == st], [s[1:] for s in speeds if s[0] == st])
        if b:
            want[st] = (round(b[0], 9), *b[1:])
    assert got == want


def test_best_subset_deals_services_out_once(spark):
    rnd = random.Random(7)
    services, speeds = [], []
    for st in range(8):
        for r in range(rnd.randint(1, 7)):
            mode, d = rnd.choice(["bus", "tram", "rail", None]), None if rnd.random() < 0.2 else rnd.uniform(2000, 40000)
            ways = range(rnd.randint(1, 2))
            speeds.append((st, r, mode, d, 3600.0 * len(ways)))
            services += [(st, r, i, float(rnd.choice([0, *range(3, 60)])), mode, None if d is None else d / len(ways), 3600.0) for i in ways]
    services += [(None, 1, 0, 5.0, "rail", 30000.0, 3600.0), (1, None, 0, 5.0, "rail", 50000.0, 3600.0)]
    speeds += [(None, 1, "rail", 30000.0, 3600.0), (1, None, "rail", 50000.0, 3600.0)]
    one = spark.createDataFrame(services, "station int, route int, direction int, headway double, mode string, distance double, time double")
    two = one.select("station", "route", "direction", "headway"), spark.createDataFrame(speeds, "station int, route int, mode string, distance double, time double")
    plain = lambda df: sorted((r["station"], r["tier"], r["min_speed"], round(r["score"], 9), tuple(r["route_ids"])) for r in df.collect())
    best = score.best_subset(one)
    assert plain(best) == plain(score.best_subset(*two)) and len(plain(best)) == 7  # a station has no valid combination
    assert best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_acronyms_and_veto(spark):
    s = lambda a, b: spark.range(1).select(match.match_score(F.lit(a), F.lit(b))).first()[0]
    assert s("Southeastern Pennsylvania Transportation Authority", "SEPTA") == 0.9
    assert s("Massachusetts Bay Transportation Authority", "MBTA") == 0.9
    assert s("Massachusetts Bay Transportation Authority", "XBTA") == 0.0
    assert s("Research Triangle Regional Public Transportation", "GoTriangle") == 0.6
    assert s("Springfield Transit", "Springfield Airport Shuttle") == 0.0


def test_similar_pairs_finds_all(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    make = lambda n: [(i, rnd.sample(vocab, rnd.randint(1, 5))) for i in range(n)]
    a, b = make(40), make(50)
    for th in (0.5, 0.34, 0.8):
        got = {(r["l"], r["r"]) for r in match.similar_pairs(spark.createDataFrame(a, "l int, tk array<string>"), spark.createDataFrame(b, "r int, tk array<string>"), "l", "r", "tk", th).collect()}
        assert got == {(i, j) for i, x in a for j, y in b if len(set(x) & set(y)) / len(set(x) | set(y)) >= th - 1e-12}


def test_similar_counts_compare_each_set_of_words_once(spark, monkeypatch):
    rnd = random.Random(5)
    make = lambda n: [(i, rnd.sample(["a", "b", "c", "d"], rnd.randint(0, 3))) for i in range(n)]
    a, b = make(60), make(80)
    a.append((None, ["a"]))
    left, right = spark.createDataFrame(a + a[:4], "l int, tk array<string>"), spark.createDataFrame(b + b[:4], "r int, tk array<string>")
    seen, pairs = [], match.similar_pairs
    want = {r.l: (r.n, r.s) for r in pairs(left, right, "l", "r", "tk").groupBy("l").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()}
    monkeypatch.setattr(match, "similar_pairs", lambda l, r, *more: seen.append((l.count(), r.count())) or pairs(l, r, *more))
    out = match.similar_counts(left, right, "l", "r", "tk").collect()
    assert {r.l: r.pairs for r in out} == {i: n for i, (n, _) in want.items()} and all(abs(r.score - want[r.l][1]) < 1e-9 for r in out)
    assert len(out) > 40 and seen[0][0] <= 20 and seen[0][1] <= 20


def test_catalogue_totals_compare_classes(spark, monkeypatch):
    rnd = random.Random(6)
    names, states = ["red line", "blue line", "red valley line", "green", None], ["S1", "s1", "s2", None]
    box = lambda: rnd.choice([(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0), (8.0, 8.0, 9.0, 9.0)])
    feeds = [(i, rnd.choice(names), rnd.choice(states), *box()) for i in range(150)]
    entries = [(i, rnd.choice(names), rnd.choice(states), rnd.choice(["active", "inactive"]), *box()) for i in range(150)]
    b = spark.createDataFrame(feeds + feeds[:3], "feed long, name string, state string, west double, south double, east double, north double")
    c = spark.createDataFrame(entries + entries[:3], "entry long, provider string, state string, status string, west double, south double, east double, north double")
    o = spark.createDataFrame([(1, 5), (1, 6), (2, 999), (999, 5)], "feed long, entry long")
    pairs = match.catalogue_matches
    want = {r.feed: (r.n, r.ids, round(r.s, 6), r.f) for r in pairs(b, c, o).groupBy("feed").agg(F.count("*").alias("n"), F.sum("entry").alias("ids"), F.sum("score").alias("s"), F.bool_or("forced").alias("f")).collect()}
    seen = []
    monkeypatch.setattr(match, "catalogue_matches", lambda x, y: seen.append((x.count(), y.count())) or pairs(x, y))
    got = {r.feed: (r.entries, r.ids, round(r.score, 6), r.forced) for r in match.catalogue_totals(b, c, o).collect()}
    assert got == want and len(got) > 50
    assert seen[0][0] <= 60 and seen[0][1] <= 120


def test_windows_are_clipped(spark, rows):
    routes = spark.createDataFrame([("r", "a", 30, 100)], "route string, class string, open int, close int")
    out = timetable.frequency_windows(routes, ((0, 60, "x"), (60, 90, "y"), (90, 200, "z")), {"a": {"x": 10, "z": 20}})
    assert rows(out) == [("r", "x", 30, 60, 10.0), ("r", "z", 90, 100, 20.0)]


def test_fleet_headway_limits(spark):
    h = lambda f, km: spark.range(1).select(timetable.fleet_headway(F.lit(f), F.lit(km), F.lit(25.0))).first()[0]
    assert h(1, 500.0) == 60.0 and h(500, 10.0) == 2.0 and h(20, 50.0) == round(50 / 25 * 60 * 1.1 / (20 * 0.83))

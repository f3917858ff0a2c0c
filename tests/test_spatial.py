import math
import random

import pytest
from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators import lines, network, search, spatial
from stopfield.plans.street_grid import move_roadless

LAT0 = 41.0


def plane(lon, lat):
    return lon * grid.METRES_PER_DEGREE * math.cos(math.radians(LAT0)), lat * grid.METRES_PER_DEGREE


def crowd(seed, n, hot=True):
    """A third of the points share one tiny square, some share one position."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if hot and i % 3 == 0:
            out.append((i, 2.0 + rnd.randint(0, 3) * 1e-5, 41.0 + rnd.randint(0, 3) * 1e-5))
        else:
            out.append((i, rnd.uniform(1.9, 2.1), rnd.uniform(40.9, 41.1)))
    return out


def metres(x1, y1, x2, y2):
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * grid.EARTH_M * math.asin(math.sqrt(min(1.0, h)))


def wide(seed, n):
    """Places from 25 to 50 degrees north, a third of them in one small square."""
    rnd = random.Random(seed)
    return [(i, -80 + rnd.random() * 1e-3, 47.6 + rnd.random() * 1e-3) if i % 3 == 0 else (i, rnd.uniform(-125, -65), rnd.uniform(25, 50)) for i in range(n)]


@pytest.mark.parametrize("places,cap", [(crowd, 3000.0), (crowd, 40000.0), (crowd, None), (wide, 150_000.0), (wide, None)])
def test_nearest_against_brute_force(spark, places, cap):
    pts, feats = places(1, 150), places(2, 90)
    p = spark.createDataFrame([*pts, (999, None, 3.0)], "id int, lon double, lat double")
    f = spark.createDataFrame([*feats, (999, None, None)], "fid int, lon double, lat double")
    got = {r["id"]: (r["fid"], r["dist"]) for r in spatial.nearest(p, f, "id", "fid", cap).collect()}
    want = {}
    for i, x, y in pts:
        d, k = min((metres(x, y, a, b), k) for k, a, b in feats)
        if cap is None or d <= cap:
            want[i] = (k, d)
    assert set(got) == set(want) and all(abs(got[i][1] - want[i][1]) < 1e-5 for i in want)
    assert sum(got[i][0] == want[i][0] for i in want) >= len(want) - 1


def test_one_far_feature_is_found(spark):
    p = spark.createDataFrame(crowd(3, 10, False), "id int, lon double, lat double")
    f = spark.createDataFrame([(7, 12.0, 45.0)], "fid int, lon double, lat double")
    assert {r["fid"] for r in spatial.nearest(p, f, "id", "fid", 5_000_000.0).collect()} == {7}
    assert spatial.nearest(p, f.limit(0), "id", "fid", None).collect() == spatial.nearest(p.limit(0), f, "id", "fid", 9.0).collect() == []


@pytest.mark.parametrize("places,radius", [(crowd, 4000.0), (crowd, 30.0), (wide, 400_000.0)])
def test_radius_sums_against_brute_force(spark, places, radius):
    pts, feats = places(4, 120), places(5, 160)
    p = spark.createDataFrame(pts, "id int, lon double, lat double")
    f = spark.createDataFrame([(*t, float(t[0] % 5)) for t in feats], "fid int, lon double, lat double, v double")
    got = {r["id"]: r["v"] for r in spatial.radius_sums(p, f, "id", ["v"], radius).collect()}
    for i, x, y in pts:
        assert abs(got[i] - sum(k % 5 for k, a, b in feats if metres(x, y, a, b) <= radius)) < 1e-9


def test_a_crowded_square_costs_no_more_pairs_than_a_spread_set(spark):
    n = 20_000
    rnd = lambda s: F.rand(s)
    even = spark.range(n).select("id", (rnd(1) * 5 - 90).alias("lon"), (rnd(2) * 5 + 40).alias("lat")).cache()
    tight = spark.range(n).select("id", (rnd(1) * 1e-4 - 90).alias("lon"), (rnd(2) * 1e-4 + 40).alias("lat")).cache()
    lone = spark.createDataFrame([(-1, -88.0, 42.0)], "id long, lon double, lat double")

    def compared(df):
        where = search._placed(df, []).distinct()
        return sum(
            pairs.join(where.groupBy(search._cube(side).alias("p")).agg(F.count("*").alias("a")), "p").join(where.groupBy(search._cube(side).alias("f")).agg(F.count("*").alias("b")), "f").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
            for side, pairs in search.nearest_pairs(where, where, 50_000.0)
        )

    a, b = compared(even) / n, compared(tight.union(lone)) / n
    assert a < 400 and b < 400, (a, b)


@pytest.mark.parametrize("res,km,tile", [(14, [3.0, 9.0], 256), (14, [9.0], 2), (18, [1.0], 64)])
def test_neighbourhood_density_against_brute_force(spark, monkeypatch, res, km, tile):
    rnd = random.Random(6)
    base = grid.side_degrees(res)
    monkeypatch.setattr(spatial, "TILE", tile)
    rows = {(int((180 + 47.6) / base) + rnd.randint(0, 14), int((180 - 122) / base) + rnd.randint(0, 14)): float(rnd.randint(0, 9)) for _ in range(90)}
    cells = spark.createDataFrame([(a, b, v) for (a, b), v in rows.items()], "a long, b long, population double").select(grid.pack(res, F.col("a"), F.col("b")).alias("cell"), "population")
    got = {(r.a, r.b): r for r in spatial.neighbourhood_density(cells, res, km).select(grid.row(F.col("cell")).alias("a"), grid.col(F.col("cell")).alias("b"), "*").collect()}
    assert set(got) == set(rows)
    side = grid.side_metres(res)
    for (a, b) in rows:
        narrow = side * math.cos(math.radians((a + 0.5) * base - 180))
        for k in km:
            most = int(k * 1000 / narrow) + 2
            near = [(i, j) for i in range(-most, most + 1) for j in range(-most, most + 1) if (i * side) ** 2 + (j * narrow) ** 2 <= (k * 1000) ** 2]
            want = sum(rows.get((a + i, b + j), 0.0) for i, j in near) / (len(near) * side * narrow / 1e6)
            assert abs(got[a, b][f"density_{k:g}km"] - want) < 1e-9 * max(1, want)


def test_density_plan_does_not_grow_with_the_radius(spark):
    cells = spark.range(300).select(grid.cell(F.lit(2.0) + F.col("id") * 0.0004, F.lit(41.0), 20).alias("cell"), F.lit(1.0).alias("population"))
    plans = [len(spatial.neighbourhood_density(cells, 20, [k])._jdf.queryExecution().executedPlan().toString()) for k in (0.2, 5.0)]
    assert abs(plans[0] - plans[1]) < 200 and spatial.neighbourhood_density(cells, 20, [5.0]).count() == cells.distinct().count()


STAR = [(2.0, 41.0), (2.3, 41.05), (2.5, 41.4), (2.2, 41.2), (1.9, 41.5), (2.05, 41.2), (2.0, 41.0)]


def inside(x, y, ring=STAR):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def star(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in STAR])
    return spark.range(1).select(F.lit("s").alias("area"), ring.alias("ring"), F.lit(42.0).alias("amount"))


@pytest.mark.parametrize("res", [6, 9, 12])
def test_within_a_ragged_polygon(spark, res):
    rnd = random.Random(8)
    pts = [(i, rnd.uniform(1.8, 2.6), rnd.uniform(40.9, 41.6)) for i in range(400)]
    got = {r["id"] for r in spatial.within(spark.createDataFrame(pts, "id int, lon double, lat double"), star(spark), "area", res).collect()}
    assert got == {i for i, x, y in pts if inside(x, y)}


def test_polyfill_and_overlay_keep_the_amount(spark):
    filled = spatial.polyfill(star(spark), "area", 12).select(grid.centre_lon(F.col("cell"), 12).alias("x"), grid.centre_lat(F.col("cell"), 12).alias("y")).collect()
    assert filled and all(inside(r["x"], r["y"]) for r in filled)
    assert abs(spatial.overlay(star(spark), "area", ["amount"], 9, 4).agg(F.sum("amount")).first()[0] - 42.0) < 1e-9


def test_raster_keeps_its_mass(spark):
    px = spark.createDataFrame([(2.05, 41.05, 3.5), (2.15, 41.05, None), (2.15, 41.15, 7.0)], "lon double, lat double, value double")
    assert abs(spatial.raster_to_cells(px, "value", 0.1, 11).agg(F.sum("value")).first()[0] - 10.5) < 1e-9


def test_lines_to_cells_against_brute_force(spark):
    rnd = random.Random(9)
    edges = [(i, (x := rnd.uniform(2.0, 2.05)), (y := rnd.uniform(41.0, 41.05)), x + rnd.uniform(-0.02, 0.02), y + rnd.uniform(-0.02, 0.02), float(10 * (i + 1))) for i in range(12)]
    e = spark.createDataFrame(edges, "edge int, x1 double, y1 double, x2 double, y2 double, los double")
    res, reach, far = 17, 150.0, 600.0
    got = {r["cell"]: r["los"] for r in spatial.lines_to_cells(e, "los", res, reach, far).collect()}

    def distance(px, py, edge):
        ax, ay = plane(edge[1], edge[2])
        bx, by = plane(edge[3], edge[4])
        vx, vy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((px - ax) * vx + (py - ay) * vy) / (vx * vx + vy * vy)))
        return math.hypot(px - ax - t * vx, py - ay - t * vy)

    side = grid.side_degrees(res)
    want = {}
    for row in range(int((40.97 + 180) / side), int((41.08 + 180) / side)):
        for col in range(int((1.97 + 180) / side), int((2.08 + 180) / side)):
            px, py = plane((col + 0.5) * side - 180, (row + 0.5) * side - 180)
            d = [(distance(px, py, ed), -ed[5]) for ed in edges]
            near = [-v for dist, v in d if dist <= reach]
            if near:
                want[(res << 52) | (row << 26) | col] = max(near)
            elif min(d)[0] <= far:
                want[(res << 52) | (row << 26) | col] = -min(d)[1]
    assert got == want


def test_roadless_people_move_within_the_cap_only(spark, rows):
    side = grid.side_degrees(16)
    cell = lambda i: (16 << 52) | (40000 << 26) | (33000 + i)
    pop = spark.createDataFrame([(cell(0), 10.0), (cell(1), 20.0), (cell(2), 0.0), (cell(3), 5.0), (cell(40), 30.0)], "cell long, population double")
    street = spark.createDataFrame([(cell(0),), (cell(1),), (cell(1),)], "cell long").distinct()
    out = move_roadless(pop, street, ["population"], 16, 2.6 * side * grid.METRES_PER_DEGREE)
    assert rows(out) == sorted([(cell(0), 10.0), (cell(1), 25.0)], key=str)


def test_connected_cells_of_two_long_patches(spark):
    pack = lambda r, c: (12 << 52) | (r << 26) | c
    snake = [(10, c) for c in range(40)] + [(11, 39)] + [(12, c) for c in range(40)]
    other = [(20, c) for c in range(5)]
    df = spark.createDataFrame([(pack(*p),) for p in snake + other], "cell long")
    got = {r["label"]: r["n"] for r in network.connected_cells(df, 12).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {pack(10, 0): 81, pack(20, 0): 5}


def test_bounded_walk_against_dijkstra(spark):
    import heapq

    rnd = random.Random(4)
    edges = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randint(10, 90))) for _ in range(110)]
    both = edges + [(b, a, w) for a, b, w in edges]
    starts = [(1, 0, 5.0), (2, 17, 0.0)]
    got = {(r["station"], r["node"]): r["dist"] for r in network.bounded_walk(spark.createDataFrame(both, "src int, dst int, w double"), spark.createDataFrame(starts, "station int, node int, dist double"), 150.0).collect()}
    want = {}
    for s, node, d0 in starts:
        dist, heap = {}, [(d0, node)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in dist or d > 150:
                continue
            dist[n] = d
            for a, b, w in both:
                if a == n:
                    heapq.heappush(heap, (d + w, b))
        want |= {(s, n): d for n, d in dist.items()}
    assert got == want


def vectors(points):
    out = []
    for lon, lat in points:
        x, y = math.radians(lon), math.radians(lat)
        out.append((math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)))
    return out


def walked(line, stops, steps=4000):
    """Stops in order along a line that is cut into many points: the nearest point not before the last stop's."""
    pts, km, at = [], [], 0.0
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        (a, b) = vectors([(x1, y1), (x2, y2)])
        length = 2 * 6371.0 * math.asin(math.dist(a, b) / 2)
        for i in range(steps + 1):
            pts.append(tuple(p + (q - p) * i / steps for p, q in zip(a, b)))
            km.append(at + length * i / steps)
        at += length
    first, out, unsure = 0, [], False
    for s in vectors(stops):
        dist = [6371.0 * math.dist(p, s) for p in pts]
        first = min(range(first, len(pts)), key=lambda i: (round(dist[i], 9), i))
        out.append(km[first])
        least = min(dist)
        unsure = unsure or any(d <= least + 0.5 * lines.NEAR_KM and abs(k - km[first]) > 2 * lines.AMBIGUOUS_KM for d, k in zip(dist, km))
    return out, unsure


def test_stops_keep_their_order_along_lines(spark):
    at = lambda p: F.struct(F.lit(p[0]).alias("lon"), F.lit(p[1]).alias("lat"))
    cases = [
        ([(0.0, 0.0), (0.1, 0.0), (0.2, 0.0), (0.1, 0.0), (0.0, 0.0)], [(0.05, 0.001), (0.15, 0.001), (0.15, 0.001), (0.02, 0.001)]),
        ([(0.0, 47.0), (0.1, 47.0), (0.2, 47.05)], [(0.0, 47.0), (0.11, 47.0), (0.2, 47.06)]),
        ([(5.0, 60.0), (5.0, 60.1), (5.2, 60.1), (5.2, 60.0)], [(5.01, 60.05), (5.1, 60.09), (5.19, 60.05), (5.3, 59.9)]),
    ]
    for line, stops in cases:
        df = spark.range(1).select(F.lit(1).alias("route"), F.array(*map(at, line)).alias("line"), F.array(*map(at, stops)).alias("stops"))
        out = lines.stop_positions(df).first()
        want, unsure = walked(line, stops)
        assert all(abs(k - w) < 0.01 for k, w in zip(out["km"], want)) and len(out["km"]) == len(want)
        assert out["ambiguous"] == unsure


def test_a_long_path_is_walked_to_its_end(spark):
    n = 45
    edges = spark.createDataFrame([(i, i + 1, 5.0) for i in range(n)], "src int, dst int, w double")
    starts = spark.createDataFrame([(1, 0, 0.0)], "station int, node int, dist double")
    got = {r["node"]: r["dist"] for r in network.bounded_walk(edges, starts, 5.0 * n).collect()}
    assert got == {i: 5.0 * i for i in range(n + 1)}
    with pytest.raises(ValueError):
        network.bounded_walk(edges.selectExpr("src", "dst", "-w AS w"), starts, 10.0)


def test_cell_walk_goes_by_the_nearer_end(spark):
    x1, x2, y = 2.0, 2.01, 41.0
    length = (x2 - x1) * grid.METRES_PER_DEGREE * math.cos(math.radians(LAT0))
    street = spark.createDataFrame([(1, 10, 20, length, x1, y, x2, y)], "edge int, u int, v int, w double, x1 double, y1 double, x2 double, y2 double")
    walks = spark.createDataFrame([(7, 10, 100.0), (7, 20, 50.0), (8, 20, 9e9)], "station int, node int, dist double")
    cell = spark.range(1).select(grid.cell(F.lit(2.0025), F.lit(41.0005), 20).alias("cell"))
    at = cell.select(grid.centre_lon(F.col("cell"), 20).alias("x"), grid.centre_lat(F.col("cell"), 20).alias("y")).first()
    px, py = plane(at["x"], at["y"])
    off, along = abs(py - plane(x1, y)[1]), px - plane(x1, y)[0]
    got = network.cell_walks(cell, street, walks, 20, 2000.0).collect()
    assert len(got) == 1 and got[0]["station"] == 7
    assert abs(got[0]["dist"] - (off + min(along + 100, length - along + 50))) < 1e-3


def test_stops_along_lines_are_never_broadcast(spark):
    at = lambda x: F.struct(x.cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    routes = spark.range(20).select(F.col("id").alias("route"), F.array(at(F.lit(0)), at(F.lit(1))).alias("line"), F.array(at(F.lit(0.5))).alias("stops"))
    out = lines.stop_positions(routes)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20 and abs(out.first().km[0] - 55.6) < 0.1


def test_lines_send_one_row_a_cell_where_cells_are_as_high_as_the_reach(spark):
    rnd = random.Random(4)
    rows = [(i if i % 9 else None, x := rnd.uniform(1.9, 2.1), y := rnd.uniform(40.9, 41.1), x + rnd.uniform(-0.05, 0.05), y + rnd.uniform(-0.05, 0.05)) for i in range(40)]
    rows += rows[:3] + [(50, None, 41.0, 2.0, 41.0), (51, *rows[7][1:]), (52, 2.0, 41.0, 2.0, 41.0)]
    edges = spark.createDataFrame(rows, "edge long, x1 double, y1 double, x2 double, y2 double")
    for res, reach in ((14, 2000.0), (14, 300.0), (17, 2000.0)):
        points = spark.createDataFrame([(rnd.uniform(1.8, 2.2), rnd.uniform(40.8, 41.2)) for _ in range(200)], "lon double, lat double")
        cells = points.select(grid.cell(F.col("lon"), F.col("lat"), res).alias("cell")).union(spark.sql("SELECT CAST(NULL AS LONG)"))
        at = cells.select("cell", grid.centre_lon(F.col("cell"), res).alias("lon"), grid.centre_lat(F.col("cell"), res).alias("lat"))
        want = spatial.snap_to_lines(at, edges, "cell", "edge", reach)
        got = spatial.snap_cells_to_lines(cells, edges, "edge", res, reach)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
    streets = edges.selectExpr("*", "edge AS u", "edge + 1 AS v", "1D AS w")
    plan = network.cell_walks(cells, streets, spark.createDataFrame([(1, 1, 0.0)], "station long, node long, dist double"), 14, 2000.0)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("explode(_rs")[0].splitlines()[:-1]
    assert "Aggregate" in [line for line in above if any(n in line for n in ("Aggregate", "Exchange", "Join"))][-1] and "Broadcast" not in plan.split("explode(_rs")[0]

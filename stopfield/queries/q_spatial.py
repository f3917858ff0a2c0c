"""Queries on spatial joins and grid geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import geo, grid
from stopfield.operators import access as A
from stopfield.operators import spatial as X
from stopfield.operators.skew import median
from stopfield.queries.registry import query
from stopfield.queries.views import FINE, METRE, sql_cell, sql_centre, sql_col, sql_haversine, sql_parent, sql_plane, sql_row

LAT0 = 37.5
COS0 = f"cos(radians({LAT0}))"
BASE = 8  # cover resolution of the two-degree test areas


def r(c, digits=6):
    return F.round(c, digits)


def px(c):
    return f"(({c})*{METRE}::DOUBLE*{COS0})"


def py(c):
    return f"(({c})*{METRE}::DOUBLE)"


def arc(x1, y1, x2, y2):
    """Great-circle metres, as SQL."""
    return f"({sql_haversine(x1, y1, x2, y2)}*1000)"


def along(lon, lat, x1="x1", y1="y1", x2="x2", y2="y2"):
    """Where along a segment (0 to 1) a point is nearest, on the plane about the segment's middle latitude, as SQL."""
    px = lambda c: f"(({c})*{METRE}::DOUBLE*cos(radians((({y1})+({y2}))/2)))"
    vx, vy = f"({px(x2)}-{px(x1)})", f"({py(y2)}-{py(y1)})"
    return f"greatest(0.0, least(1.0, coalesce((({px(lon)}-{px(x1)})*{vx}+({py(lat)}-{py(y1)})*{vy})/nullif({vx}*{vx}+{vy}*{vy},0),0)))"


def segment(lon, lat, x1="x1", y1="y1", x2="x2", y2="y2"):
    """Point to segment in metres on the same plane, as SQL."""
    px = lambda c: f"(({c})*{METRE}::DOUBLE*cos(radians((({y1})+({y2}))/2)))"
    vx, vy, tt = f"({px(x2)}-{px(x1)})", f"({py(y2)}-{py(y1)})", along(lon, lat, x1, y1, x2, y2)
    return f"sqrt(pow({px(lon)}-({px(x1)}+{tt}*{vx}),2)+pow({py(lat)}-({py(y1)}+{tt}*{vy}),2))"


# half-open sides as the crossing-number test sees them: west edge in, east edge out; south in, north out
IN_AREA = "lon >= west AND lon < east AND lat >= south AND lat < north"


@query("point_in_polygon", "J5 G7", f"SELECT id, min(area) AS area FROM v_place JOIN v_area ON {IN_AREA} GROUP BY 1")
def _(t):
    return X.assign(t.place, t.area, "id", "area", BASE)


@query("all_containing_polygons", "J5 A4", f"SELECT area, count(*) AS places, round(sum(population),3) AS population FROM v_unit JOIN v_area ON {IN_AREA} GROUP BY 1")
def _(t):
    return X.within(t.unit, t.area, "area", BASE).groupBy("area").agg(F.count("*").alias("places"), r(F.sum("population"), 3).alias("population"))


@query("representative_point_assignment", "J6 G6", """
    WITH b AS (SELECT c_custkey AS id, -100 + ((c_custkey*7919)%20000)/1000.0::DOUBLE + 0.03 AS lon, 30 + ((c_custkey*104729)%15000)/1000.0::DOUBLE + 0.02 AS lat FROM customer)
    SELECT id, min(area) AS area FROM b JOIN v_area ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY 1""")
def _(t):
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(corner(0, 0), corner(0.06, 0), corner(0.06, 0.04), corner(0, 0.04), corner(0, 0))
    blocks = t.place.select("id", ring.alias("ring"))
    return X.assign(X.representative_points(blocks, "id"), t.area, "id", "area", BASE)


def nearest_sql(cap, where="", by=""):
    return f"""WITH d AS (SELECT p.id, s.station, {by + ',' if by else ''} {arc('p.lon','p.lat','s.lon','s.lat')} AS dist FROM v_place p JOIN v_station s ON {arc('p.lon','p.lat','s.lon','s.lat') + f' <= {cap}' if cap else 'true'} {where})
    SELECT id, {by + ',' if by else ''} arg_min(station, row(dist, station)) AS station, round(min(dist),3) AS dist FROM d GROUP BY id {',' + by if by else ''}"""


@query("nearest_station_capped", "J7 O4", nearest_sql(60000))
def _(t):
    return X.nearest(t.place, t.station, "id", "station", 60000.0).withColumn("dist", r(F.col("dist"), 3))


@query("nearest_station_uncapped", "J8", nearest_sql(None))
def _(t):
    return X.nearest(t.place, t.station, "id", "station", None).withColumn("dist", r(F.col("dist"), 3))


@query("nearest_station_per_mode", "J9", f"""
    WITH n AS ({nearest_sql(None, by='mode')}), own AS (SELECT DISTINCT h AS id, w AS station FROM v_flow), k AS (SELECT median(net/straight) AS detour FROM (
      SELECT ((h*13+w*7)%2500)::DOUBLE*90 AS net, {arc('p.lon','p.lat','s.lon','s.lat')} AS straight FROM v_flow JOIN v_place p ON h = p.id JOIN v_station s ON w = s.station) WHERE net > 100 AND straight > 50)
    SELECT n.id, n.mode, n.station, round(dist*detour, 2) AS dist FROM n CROSS JOIN k WHERE (n.id, n.station) NOT IN (SELECT (id, station) FROM own)""".replace("round(min(dist),3)", "min(dist)"))
def _(t):
    near = X.nearest(t.place, t.station, "id", "station", None, by=["mode"])
    own = t.flow.select(F.col("h").alias("id"), F.col("w").alias("station"))
    p = t.place.select(F.col("id").alias("h"), F.col("lon").alias("a"), F.col("lat").alias("b"))
    s = t.station.select(F.col("station").alias("w"), F.col("lon").alias("c"), F.col("lat").alias("d"))
    pairs = t.flow.join(p, "h").join(s, "w").select(
        ((F.col("h") * 13 + F.col("w") * 7) % 2500 * 90.0).alias("net"), (geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")) * 1000).alias("straight"))
    detour = median(pairs.filter("net > 100 and straight > 50").select(F.try_divide("net", "straight").alias("k")), [], "k", "detour")
    fresh = near.join(own, ["id", "station"], "left_anti").crossJoin(F.broadcast(detour))
    return fresh.select("id", "mode", "station", r(F.col("dist") * F.col("detour"), 2).alias("dist"))


BANDS = [(20.0, 40.0), (40.0, 50.0), (50.0, 1000.0)]


@query("far_stations_per_band", "J9", f"""
    WITH g AS (SELECT station, 60 - min(headway) AS score FROM v_route_service GROUP BY 1), k AS (SELECT coalesce(median(dist/{arc('p.lon','p.lat','s.lon','s.lat')}), 1.3) AS detour FROM v_item i JOIN v_place p ON p.id = cell JOIN v_station s ON s.station = i.station
      WHERE dist > 100 AND {arc('p.lon','p.lat','s.lon','s.lat')} > 50),
    b AS (SELECT s.*, CASE WHEN score >= 20 AND score < 40 THEN 0 WHEN score >= 40 AND score < 50 THEN 1 WHEN score >= 50 AND score < 1000 THEN 2 END AS band FROM v_station s JOIN g USING (station)),
    d AS (SELECT p.id AS cell, band, b.station, {arc('p.lon','p.lat','b.lon','b.lat')} AS dist FROM v_place p, b WHERE band IS NOT NULL),
    n AS (SELECT cell, band, arg_min(station, row(dist, station)) AS station, min(dist) AS dist FROM d GROUP BY 1,2)
    SELECT n.cell, band, n.station, round(dist*detour, 2) AS dist FROM n, k WHERE dist*detour <= 3000 AND (n.cell, n.station) NOT IN (SELECT (cell, station) FROM v_item)""")
def _(t):
    score = t.route_service.groupBy("station").agg((60 - F.min("headway")).alias("score"))
    cells = t.place.select(F.col("id").alias("cell"), "lon", "lat")
    return A.far_items(cells, t.station.join(score, "station"), t.item, "score", BANDS, 3000.0).withColumn("dist", r(F.col("dist"), 2))


@query("jobs_within_radius", "J10", f"""
    SELECT a.id, round(sum(b.jobs),5) AS jobs FROM v_unit a JOIN v_unit b ON {arc('a.lon','a.lat','b.lon','b.lat')} <= 80000 GROUP BY 1""")
def _(t):
    return X.radius_sums(t.unit, t.unit, "id", ["jobs"], 80_000.0).select("id", r(F.col("jobs"), 5).alias("jobs"))


@query("stops_as_evidence", "J11", f"""
    SELECT n.area, count(c.id) AS within_far, count(c.id) FILTER (WHERE {arc('(n.west+1)','(n.south+1)','c.lon','c.lat')} <= 50000) AS within_near,
           count(c.id) FILTER (WHERE c.segment LIKE '%B%') AS name_hits FROM v_area n LEFT JOIN v_place c ON {arc('(n.west+1)','(n.south+1)','c.lon','c.lat')} <= 150000 GROUP BY 1""")
def _(t):
    centres = t.area.select("area", (F.col("west") + 1).alias("lon"), (F.col("south") + 1).alias("lat"))
    stops = t.place.select("lon", "lat", F.lit(1).alias("n"), F.col("segment").contains("B").cast("int").alias("hit"))
    far = X.radius_sums(centres, stops, "area", ["n", "hit"], 150_000.0)
    near = X.radius_sums(centres, stops, "area", ["n"], 50_000.0)
    return far.select("area", F.col("n").alias("within_far"), F.col("hit").alias("name_hits")).join(near.select("area", F.col("n").alias("within_near")), "area")


LINE_CELLS = f"""
    o AS (SELECT i, j FROM range(-3,4) a(i), range(-5,6) b(j)), s AS (SELECT *, unnest(range(0, 6)) AS k FROM v_edge),
    v AS (SELECT DISTINCT edge, los, x1, y1, x2, y2, {sql_cell('(x1+(x2-x1)*k/5.0)', '(y1+(y2-y1)*k/5.0)', FINE)} AS c FROM s),
    c AS (SELECT DISTINCT edge, los, x1, y1, x2, y2, (({FINE}::BIGINT)<<52) | (({sql_row('c')}+i)<<26) | ({sql_col('c')}+j) AS cell FROM v, o),
    n AS (SELECT edge, los, cell, {segment(*sql_centre('cell', FINE))} AS dist FROM c)"""


@query("street_cells", "J12 G8", f"WITH {LINE_CELLS} SELECT DISTINCT cell FROM n WHERE dist <= 8000")
def _(t):
    return X.street_cells(t.edge, FINE, 8000.0)


@query("line_values_to_cells", "J13 U1 A18", f"""
    WITH {LINE_CELLS} SELECT cell, round(coalesce(max(los) FILTER (WHERE dist <= 5000), -min(row(dist, -los))[2]),6) AS los FROM n WHERE dist <= 9000 GROUP BY 1""")
def _(t):
    return X.lines_to_cells(t.edge, "los", FINE, 5000.0, 9000.0).withColumn("los", r(F.col("los")))


@query("line_means_to_cells", "U1 J13", f"""
    WITH {LINE_CELLS} SELECT cell, round(coalesce(avg(los) FILTER (WHERE dist <= 5000), -min(row(dist, -los))[2]),6) AS los FROM n WHERE dist <= 9000 GROUP BY 1""")
def _(t):
    return X.lines_to_cells(t.edge, "los", FINE, 5000.0, 9000.0, agg=F.avg).withColumn("los", r(F.col("los")))


SIDE8, SIDE12 = repr(360 / 2**8), repr(360 / 2**12)


@query("polygon_cells", "G7", f"""
    WITH g AS (SELECT area, (({11}::BIGINT)<<52) | (rw<<26) | cl AS cell FROM v_area, range(1190,1285) a(rw), range(450,575) b(cl)
      WHERE (cl+0.5)*{repr(360/2**11)}-180 >= west AND (cl+0.5)*{repr(360/2**11)}-180 < east AND (rw+0.5)*{repr(360/2**11)}-180 >= south AND (rw+0.5)*{repr(360/2**11)}-180 < north)
    SELECT area, count(*) AS cells, min(cell) AS low, max(cell) AS high FROM g GROUP BY 1""")
def _(t):
    return X.polyfill(t.area, "area", 11).groupBy("area").agg(F.count("*").alias("cells"), F.min("cell").alias("low"), F.max("cell").alias("high"))


OVERLAY = f"""
    g AS (SELECT area, rw, cl FROM v_area, range(1190,1285) a(rw), range(450,575) b(cl)
      WHERE (cl+0.5)*{repr(360/2**11)}-180 >= west AND (cl+0.5)*{repr(360/2**11)}-180 < east AND (rw+0.5)*{repr(360/2**11)}-180 >= south AND (rw+0.5)*{repr(360/2**11)}-180 < north),
    h AS (SELECT area, (8::BIGINT<<52) | ((rw>>3)<<26) | (cl>>3) AS cell, count(*) AS n FROM g GROUP BY 1,2)"""


@query("area_weighted_overlay", "J14 Q6", f"""
    WITH {OVERLAY}, w AS (SELECT area, cell, n/sum(n) OVER (PARTITION BY area) AS share FROM h), v AS (SELECT c_nationkey AS area, sum(c_acctbal) AS amount FROM customer GROUP BY 1)
    SELECT cell, round(sum(amount*share),4) AS amount FROM w JOIN v USING (area) GROUP BY 1""")
def _(t):
    v = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.sum("c_acctbal").alias("amount"))
    out = X.overlay(t.area.select("area", "ring").join(v, "area"), "area", ["amount"], 8, 3)
    return out.select("cell", r(F.col("amount"), 4).alias("amount"))


@query("overlay_covered_shares", "J14", f"""
    WITH {OVERLAY}, k AS (SELECT DISTINCT {sql_cell('lon', 'lat', 8)} AS cell FROM v_place)
    SELECT area, h.cell, round(n/sum(n) OVER (PARTITION BY area),9) AS share FROM h JOIN k ON h.cell = k.cell""")
def _(t):
    cells = t.place.select(grid.cell(F.col("lon"), F.col("lat"), 8).alias("cell")).distinct()
    out = X.overlay_shares(t.area, "area", 8, 3, grid_cells=cells, covered=True)
    return out.select("area", "cell", r(F.col("share"), 9).alias("share"))


@query("raster_to_cells", "J15 S10", f"""
    WITH p AS (SELECT o_orderkey, -100 + ((o_orderkey*13)%200)*0.1::DOUBLE + 0.05 AS lon, 30 + ((o_orderkey*7)%150)*0.1::DOUBLE + 0.05 AS lat, o_totalprice AS value FROM orders),
    s AS (SELECT value, lon + ((i+0.5)/4-0.5)*0.1 AS x, lat + ((j+0.5)/4-0.5)*0.1 AS y FROM p, range(0,4) a(i), range(0,4) b(j))
    SELECT {sql_cell('x', 'y', 11)} AS cell, round(sum(value)/16, 6) AS value FROM s GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey")
    pixels = t.orders.select((F.lit(-100) + k * 13 % 200 * 0.1 + 0.05).alias("lon"), (F.lit(30) + k * 7 % 150 * 0.1 + 0.05).alias("lat"), F.col("o_totalprice").alias("value"))
    return X.raster_to_cells(pixels, "value", 0.1, 11, 4).select("cell", r(F.col("value"), 6).alias("value"))


@query("polygons_without_points", "J16", f"""
    WITH {OVERLAY.split(', h AS')[0].split('    h AS')[0].rstrip().rstrip(',')},
    lone AS (SELECT area FROM v_area WHERE area%3 = 0), u AS (SELECT area AS unit, (1 + area%7)::DOUBLE AS people FROM v_area WHERE area%3 <> 0),
    z AS (SELECT unit, count(*) AS size FROM u JOIN g ON g.area = unit GROUP BY 1),
    s AS (SELECT a.area, b.area AS unit, count(*) AS n FROM g a JOIN lone ON lone.area = a.area JOIN g b ON a.rw = b.rw AND a.cl = b.cl JOIN u ON u.unit = b.area GROUP BY 1,2),
    w AS (SELECT s.area, s.unit, people*n/size AS w FROM s JOIN z ON z.unit = s.unit JOIN u ON u.unit = s.unit)
    SELECT area, unit, round(w/sum(w) OVER (PARTITION BY area),9) AS share FROM w""")
def _(t):
    lone = t.area.filter("area % 3 = 0").select("area", "ring")
    units = t.area.filter("area % 3 <> 0").select(F.col("area").alias("unit"), "ring", (F.lit(1) + F.col("area") % 7).cast("double").alias("people"))
    return X.overlap_weights(lone, "area", units, "unit", "people", 11).select("area", "unit", r(F.col("share"), 9).alias("share"))


@query("edges_inside_areas", "J17", """
    WITH m AS (SELECT edge, los, (x1+x2)/2 AS lon, (y1+y2)/2 AS lat FROM v_edge) SELECT area, count(*) AS edges, sum(los) AS los FROM m JOIN v_area ON """ + IN_AREA + " GROUP BY 1")
def _(t):
    mid = t.edge.select("edge", "los", ((F.col("x1") + F.col("x2")) / 2).alias("lon"), ((F.col("y1") + F.col("y2")) / 2).alias("lat"))
    return X.within(mid, t.area, "area", BASE).groupBy("area").agg(F.count("*").alias("edges"), F.sum("los").alias("los"))


@query("stops_within_buffer", "J17", f"""
    SELECT area, id FROM v_area JOIN v_place ON ({IN_AREA}) OR least({segment('lon','lat','west','south','east','south')}, {segment('lon','lat','east','south','east','north')},
      {segment('lon','lat','east','north','west','north')}, {segment('lon','lat','west','north','west','south')}) <= 20000""")
def _(t):
    return X.within_buffer(t.place, t.area, "id", "area", 20_000.0, BASE).select("area", "id")


C9X, C9Y = sql_centre("cell", 9)


@query("density_across_levels", "J25", f"""
    WITH c AS (SELECT {sql_cell('lon', 'lat', FINE)} AS cell, max(county)::DOUBLE AS population FROM v_station GROUP BY 1), a AS (SELECT cell AS k, avg(population) AS v FROM c GROUP BY 1), b AS (SELECT {sql_parent('cell', FINE, 10)} AS k, avg(population) AS v FROM c GROUP BY 1),
    d AS (SELECT {sql_parent('cell', FINE, 8)} AS k, avg(population) AS v FROM c GROUP BY 1), e AS (SELECT {sql_parent('cell', FINE, 9)} AS cell, avg(population) AS v FROM c GROUP BY 1), p AS (SELECT id, lon, lat, {sql_cell('lon', 'lat', FINE)} AS cell FROM v_place),
    f AS (SELECT p.id, coalesce(a.v, b.v, d.v) AS v, lon, lat FROM p LEFT JOIN a ON a.k = cell LEFT JOIN b ON b.k = {sql_parent('cell', FINE, 10)} LEFT JOIN d ON d.k = {sql_parent('cell', FINE, 8)}),
    n AS (SELECT f.id, arg_min(e.v, row({arc('lon','lat',C9X,C9Y)}, cell)) AS far FROM f, e WHERE f.v IS NULL GROUP BY 1)
    SELECT f.id, round(coalesce(f.v, far), 6) AS population FROM f LEFT JOIN n USING (id)""")
def _(t):
    cells = t.station.groupBy(grid.cell(F.col("lon"), F.col("lat"), FINE).alias("cell")).agg(F.max("county").cast("double").alias("population"))
    return X.fill_from_levels(t.place.select("id", "lon", "lat"), "id", cells, "population", [FINE, 10, 8], FINE, 9).withColumn("population", r(F.col("population")))


CX, CY = sql_centre("cell", FINE)


@query("zero_score_polygons_filled", "J26", f"""
    WITH c AS (SELECT cell, los, {CX} AS lon, {CY} AS lat FROM v_fine_cell WHERE los > 0), a AS (SELECT *, CASE WHEN area%2 = 0 THEN 0.0 ELSE 5.0 END AS los0 FROM v_area),
    i AS (SELECT area, avg(los) AS v FROM a JOIN c ON los0 = 0 AND {IN_AREA} GROUP BY 1),
    f AS (SELECT a.area, arg_min(los, row({arc('(west+1)','(south+1)','lon','lat')}, cell)) AS v FROM a JOIN c ON los0 = 0 AND {arc('(west+1)','(south+1)','lon','lat')} <= 200000 WHERE a.area NOT IN (SELECT area FROM i) GROUP BY 1)
    SELECT area, round(coalesce(nullif(los0,0), i.v, f.v, los0),6) AS los FROM a LEFT JOIN i USING (area) LEFT JOIN f USING (area)""")
def _(t):
    areas = t.area.select("area", "ring", F.when(F.col("area") % 2 == 0, 0.0).otherwise(5.0).alias("los"))
    out = X.fill_zero(areas, "area", t.fine_cell, BASE, FINE, 200_000.0)
    return out.select("area", r(F.col("los")).alias("los"))


@query("neighbouring_regions", "J29", """
    SELECT a.area AS a, b.area AS b FROM v_area a JOIN v_area b ON a.area <> b.area AND greatest(a.west-b.east, b.west-a.east) < 0.05 AND greatest(a.south-b.north, b.south-a.north) < 0.05
      AND sqrt(pow(greatest(a.west-b.east, b.west-a.east, 0),2)+pow(greatest(a.south-b.north, b.south-a.north, 0),2)) < 0.05
      AND NOT (a.west > b.west AND a.east < b.east AND a.south > b.south AND a.north < b.north)""")
def _(t):
    return X.neighbours(t.area, "area", 0.05, BASE)


@query("neighbour_feeds_inside", "J29 J30", f"""
    SELECT area, c.county AS feed, count(*) AS stops FROM v_area a JOIN v_place c ON {IN_AREA} WHERE c.county <> area GROUP BY 1,2 HAVING count(*) >= 2""")
def _(t):
    inside = X.within(t.place.select("county", "lon", "lat"), t.area, "area", BASE).filter("county <> area")
    return inside.groupBy("area", F.col("county").alias("feed")).agg(F.count("*").alias("stops")).filter("stops >= 2")


@query("feeds_touching_area", "J30", f"SELECT DISTINCT area, county AS feed FROM v_area JOIN v_place ON {IN_AREA}")
def _(t):
    # stops meet areas on cells, which prunes as boxes of feeds and areas would
    return X.within(t.place.select("county", "lon", "lat"), t.area.select("area", "ring"), "area", BASE).select("area", F.col("county").alias("feed")).distinct()


@query("block_cells_matched", "J33 C13", f"""
    WITH c AS (SELECT cell FROM v_fine_cell WHERE county%2 = 0), b AS (SELECT id, population, {sql_cell('lon', 'lat', FINE)} AS cell FROM v_unit)
    SELECT id, coalesce(c.cell, -1) AS cell, population FROM b LEFT JOIN c ON b.cell = c.cell""")
def _(t):
    stored = t.fine_cell.filter("county % 2 = 0").select("cell", F.col("cell").alias("stored"))
    b = t.unit.select("id", "population", grid.cell(F.col("lon"), F.col("lat"), FINE).alias("cell"))
    return b.join(stored, "cell", "left").select("id", F.coalesce("stored", F.lit(-1)).alias("cell"), "population")


@query("coarse_cells_scaled_to_blocks", "J33", f"""
    WITH raw AS (SELECT {sql_parent('cell', FINE, 8)} AS cell, sum(population) AS raw FROM v_fine_cell GROUP BY 1),
    b AS (SELECT {sql_cell('lon', 'lat', 8)} AS cell, county, sum(population) AS p FROM v_unit GROUP BY 1,2)
    SELECT cell, county, round(CASE WHEN raw > 0 THEN p*(raw*1.1)/raw ELSE 0 END, 6) AS population FROM b JOIN raw USING (cell)""")
def _(t):
    stored = t.fine_cell.groupBy(grid.parent(F.col("cell"), FINE, 8).alias("cell")).agg((F.sum("population") * 1.1).alias("stored"))
    pieces = t.unit.groupBy(grid.cell(F.col("lon"), F.col("lat"), 8).alias("cell"), "county").agg(F.sum("population").alias("p"))
    raw = pieces.groupBy("cell").agg(F.sum("p").alias("raw"))
    scaled = F.when(F.col("raw") > 0, F.col("p") * F.col("stored") / F.col("raw")).otherwise(0.0)
    return pieces.join(raw, "cell").join(stored, "cell").select("cell", "county", r(scaled).alias("population"))


@query("metro_job_centres", "A33", f"""
    WITH j AS (SELECT a.id, a.county, a.lon, a.lat, sum(b.jobs) AS near FROM v_unit a JOIN v_unit b ON {arc('a.lon','a.lat','b.lon','b.lat')} <= 40000 GROUP BY 1,2,3,4),
    c AS (SELECT county, arg_max(lon, row(round(near,4), -id)) AS clon, arg_max(lat, row(round(near,4), -id)) AS clat FROM j GROUP BY 1)
    SELECT id, round({sql_haversine('j.lon','j.lat','clon','clat')},4) AS km FROM j JOIN c USING (county)""")
def _(t):
    near = X.radius_sums(t.unit, t.unit, "id", ["jobs"], 40_000.0).select("id", r(F.col("jobs"), 4).alias("near"))
    u = t.unit.select("id", "county", "lon", "lat").join(near, "id")
    c = X.job_centres(u, "county", "near").select("county", F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    return u.join(c, "county").select("id", r(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")), 4).alias("km"))


_S = repr(grid.side_metres(FINE))
_NARROW = f"({_S}*cos(radians({CY})))"
_OFF = lambda km: f"sqrt(pow(i*{_S}::DOUBLE,2)+pow(j*narrow,2)) <= {km * 1000}"


@query("neighbourhood_density", "A35 G3", f"""
    WITH c AS (SELECT cell, {sql_row('cell')} AS rw, {sql_col('cell')} AS cl, {_NARROW} AS narrow FROM v_fine_cell), o AS (SELECT i, j FROM range(-10,11) a(i), range(-12,13) b(j)),
    s AS (SELECT cell, i, j, narrow, (({FINE}::BIGINT)<<52) | ((rw+i)<<26) | (cl+j) AS other FROM c, o WHERE {_OFF(60)})
    SELECT s.cell, round(coalesce(sum(population) FILTER (WHERE {_OFF(20)}),0)/(count(*) FILTER (WHERE {_OFF(20)})*({_S}*max(narrow)/1e6)),9) AS density_20km, round(coalesce(sum(population),0)/(count(*)*({_S}*max(narrow)/1e6)),9) AS density_60km
    FROM s LEFT JOIN v_fine_cell f ON f.cell = s.other GROUP BY 1""")
def _(t):
    out = X.neighbourhood_density(t.fine_cell, FINE, [20.0, 60.0])
    return out.select("cell", r(F.col("density_20km"), 9).alias("density_20km"), r(F.col("density_60km"), 9).alias("density_60km"))


@query("unit_density_from_cells", "A34 G3", f"""
    WITH k AS (SELECT cell, county, population, (county%4=0) AS coarse FROM v_fine_cell), x AS (SELECT county, population/16 AS w, population/16*100 AS d, i FROM k, range(0,16) a(i) WHERE coarse),
    y AS (SELECT county, w, d FROM x UNION ALL SELECT county, population, population*10 FROM k WHERE NOT coarse)
    SELECT county, round(sum(w*d)/sum(w),6) AS density, count(*) AS cells FROM y WHERE w > 0 GROUP BY 1""")
def _(t):
    c = t.fine_cell.select("cell", "county", "population")
    spread = c.filter("county % 4 = 0").select("county", (F.col("population") / 16).alias("w"), F.explode(grid.children(F.col("cell"), FINE, FINE + 2)).alias("cell"))
    fine = spread.select("county", "w", (F.col("w") * 100).alias("d")).unionByName(c.filter("county % 4 <> 0").select("county", F.col("population").alias("w"), (F.col("population") * 10).alias("d")))
    return fine.filter("w > 0").groupBy("county").agg(r(F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("density"), F.count("*").alias("cells"))


@query("area_modal_split", "A27 J6", f"""
    WITH j AS (SELECT area, population, dem, rep FROM v_area JOIN v_unit ON {IN_AREA}) SELECT area, round(sum(dem)/nullif(sum(population),0),6) AS a_share, round(sum(rep)/nullif(sum(population),0),6) AS b_share FROM j GROUP BY 1""")
def _(t):
    j = X.within(t.unit.select("population", "dem", "rep", "lon", "lat"), t.area, "area", BASE)
    p = F.sum("population")
    share = lambda c: r(F.sum(c) / F.when(p > 0, p))
    return j.groupBy("area").agg(share("dem").alias("a_share"), share("rep").alias("b_share"))


@query("mixed_area_share", "A28", f"""
    WITH j AS (SELECT area, population, county < 12 AS muni FROM v_area JOIN v_unit ON {IN_AREA})
    SELECT area, round(coalesce(sum(CASE WHEN muni THEN population END),0)/nullif(sum(population),0)*40 + (1-coalesce(sum(CASE WHEN muni THEN population END),0)/nullif(sum(population),0))*15,6) AS share FROM j GROUP BY 1""")
def _(t):
    j = X.within(t.unit.select("population", "county", "lon", "lat"), t.area, "area", BASE)
    p = F.sum("population")
    mix = F.sum(F.when(F.col("county") < 12, F.col("population")).otherwise(0.0)) / F.when(p > 0, p)
    return j.groupBy("area").agg(r(mix * 40 + (1 - mix) * 15).alias("share"))


@query("grid_cells_and_centres", "G1 G2 G4 G5", f"""
    SELECT id, {sql_cell('lon','lat',FINE)} AS cell, {sql_parent(sql_cell('lon','lat',FINE), FINE, 5)} AS up, round({sql_centre(sql_cell('lon','lat',FINE), FINE)[0]},9) AS x, round({sql_centre(sql_cell('lon','lat',FINE), FINE)[1]},9) AS y,
      round({sql_col(sql_cell('lon','lat',FINE))}*{SIDE12}-180,9) AS west, round(({sql_row(sql_cell('lon','lat',FINE))}+1)*{SIDE12}-180,9) AS north FROM v_place""")
def _(t):
    c = F.col("cell")
    ring = grid.boundary(c, FINE)
    p = t.place.withColumn("cell", grid.cell(F.col("lon"), F.col("lat"), FINE))
    return p.select("id", "cell", grid.parent(c, FINE, 5).alias("up"), r(grid.centre_lon(c, FINE), 9).alias("x"), r(grid.centre_lat(c, FINE), 9).alias("y"),
                    r(ring[0]["lon"], 9).alias("west"), r(ring[2]["lat"], 9).alias("north"))


@query("h3_id_parents", "G2", """
    SELECT c_custkey AS id, ((((617700169958293503 + c_custkey*262144) & ~(15::BIGINT<<52)) | (8::BIGINT<<52)) | 2097151) AS parent FROM customer""")
def _(t):
    cell = F.lit(617700169958293503) + F.col("c_custkey") * 262144
    return t.customer.select(F.col("c_custkey").alias("id"), grid.h3_parent(cell, 8).alias("parent"))


@query("cell_children_and_disks", "G3", f"""
    SELECT cell, 16 AS children, (14::BIGINT<<52)|(({sql_row('cell')}<<2)<<26)|({sql_col('cell')}<<2) AS first_child, 25 AS disk, (({FINE}::BIGINT)<<52)|(({sql_row('cell')}-2)<<26)|({sql_col('cell')}-2) AS corner FROM v_fine_cell""")
def _(t):
    kids, disk = grid.children(F.col("cell"), FINE, FINE + 2), grid.disk(F.col("cell"), FINE, 2)
    return t.fine_cell.select("cell", F.size(F.array_distinct(kids)).alias("children"), F.array_min(kids).alias("first_child"), F.size(F.array_distinct(disk)).alias("disk"), F.array_min(disk).alias("corner"))


@query("ring_measures", "G6", f"""
    SELECT area, round(4*{METRE}::DOUBLE/1000*{METRE}::DOUBLE/1000*cos(radians((south+north)/2)),4) AS km2, round(west+1,6) AS x, round(south+1,6) AS y, west, north FROM v_area""")
def _(t):
    c, b = geo.ring_centroid(F.col("ring")), geo.ring_box(F.col("ring"))
    return t.area.select("area", r(geo.ring_area_km2(F.col("ring")), 4).alias("km2"), r(c["lon"]).alias("x"), r(c["lat"]).alias("y"), b["west"].alias("west"), b["north"].alias("north"))


@query("dense_stop_squares", "G11", f"""
    WITH s AS (SELECT floor({px('lon')}/40000)::BIGINT AS i, floor({py('lat')}/40000)::BIGINT AS j, count(*) AS n FROM v_place GROUP BY 1,2), m AS (SELECT i+a AS i, j+b AS j, sum(n)::BIGINT AS smooth FROM s, range(-1,2) x(a), range(-1,2) y(b) GROUP BY 1,2)
    SELECT i, j, smooth FROM m WHERE smooth >= (SELECT quantile_cont(smooth, 0.75) FROM m)""")
def _(t):
    from stopfield.operators.skew import exact_quantiles

    sq = X.dense_squares(t.place, 40_000.0, LAT0)
    cut = exact_quantiles(sq, [], "smooth", [0.75]).select(F.col("value").alias("cut"))
    return sq.crossJoin(F.broadcast(cut)).filter("smooth >= cut").select("i", "j", "smooth")


@query("sample_points_in_areas", "G12", """
    SELECT area, count(*) AS points FROM v_area, range(-400,-300) a(i), range(120,190) b(j) WHERE i*0.25 >= west AND i*0.25 < east AND j*0.25 >= south AND j*0.25 < north GROUP BY 1""")
def _(t):
    return X.sample_points(t.area, "area", BASE, 0.25).groupBy("area").agg(F.count("*").alias("points"))


@query("densified_edges", "G8", f"""
    WITH d AS (SELECT edge, greatest(1, ceil({sql_plane('x1','y1','x2','y2')}/5000))::INT AS n, x1, y1, x2, y2 FROM v_edge)
    SELECT edge, n + 1 AS points, round(x1+(x2-x1)*1/n,9) AS second_lon, round(y1+(y2-y1)*1/n,9) AS second_lat FROM d""")
def _(t):
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    e = t.edge.select("edge", geo.densify(at("x1", "y1"), at("x2", "y2"), 5000.0).alias("p"))
    return e.select("edge", F.size("p").alias("points"), r(F.col("p")[1]["lon"], 9).alias("second_lon"), r(F.col("p")[1]["lat"], 9).alias("second_lat"))


def _clip(a, b, low, high, end):
    """Where a segment from a to b enters (end least) or leaves (end greatest) the strip between low and high, as SQL; outside a strip it runs along: never."""
    at = f"{end}(({low}-{a})/({b}-{a}), ({high}-{a})/({b}-{a}))"
    beside = ("2.0", "-1.0") if end == "least" else ("-1.0", "2.0")
    return f"CASE WHEN {a} = {b} THEN CASE WHEN {a} >= {low} AND {a} < {high} THEN {beside[1]} ELSE {beside[0]} END ELSE {at} END"


@query("vehicle_km_by_area", "A29 W6", f"""
    WITH a AS (SELECT feed, service FROM v_active WHERE date = DATE '2024-01-10'), t AS (SELECT trip, o_custkey AS shape, coalesce(n,1) AS runs FROM v_trip JOIN orders ON o_orderkey = trip JOIN a USING (feed, service) LEFT JOIN (SELECT trip, sum(("end"-start)//headway) AS n FROM v_frequency GROUP BY 1) USING (trip)),
    h AS (SELECT id AS shape, seq, lon + [0.0,0.7,1.9,1.1][seq] AS lon, lat + [0.0,0.2,-0.4,0.9][seq] AS lat FROM v_place, range(1,5) x(seq)),
    l AS (SELECT trip, trip%3 <> 0 AND shape IN (SELECT id FROM v_place) AS drawn, shape FROM t), pt AS (SELECT trip, seq, lon, lat FROM l JOIN h USING (shape) WHERE drawn UNION ALL SELECT trip, seq, lon, lat FROM l JOIN v_stop_time USING (trip) JOIN v_station ON stop = station WHERE NOT drawn),
    s AS (SELECT trip, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM pt WINDOW w AS (PARTITION BY trip ORDER BY seq)),
    m AS (SELECT trip, area, {sql_haversine('x1','y1','x2','y2')} * greatest(0.0, least(1.0, {_clip('x1','x2','west','east','greatest')}, {_clip('y1','y2','south','north','greatest')})
       - greatest(0.0, {_clip('x1','x2','west','east','least')}, {_clip('y1','y2','south','north','least')})) AS km FROM s, v_area WHERE x2 IS NOT NULL),
    k AS (SELECT trip, area, sum(km) AS km FROM m GROUP BY 1,2 HAVING sum(km) > 1e-9)
    SELECT area, round(sum(km*runs),2) AS vehicle_km, count(*) AS trips FROM k JOIN t USING (trip) GROUP BY 1""")
def _(t):
    from stopfield.plans.vehicle_km import vehicle_km

    trips = t.trip.join(t.orders.select(F.col("o_orderkey").alias("trip"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("shape")), "trip")
    bend = F.inline(F.array(*[F.struct(F.lit(i + 1).alias("seq"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(0.0, 0.0), (0.7, 0.2), (1.9, -0.4), (1.1, 0.9)])]))
    shapes = t.place.select(F.col("id").alias("shape"), "lon", "lat", bend).select("shape", "seq", (F.col("lon") + F.col("a")).alias("lon"), (F.col("lat") + F.col("b")).alias("lat"))
    out = vehicle_km(trips, t.stop_time, t.station.withColumnRenamed("station", "stop"), t.frequency, t.calendar, t.exception, "2024-01-10", t.area, "area", BASE, shapes)
    return out.withColumn("vehicle_km", r(F.col("vehicle_km"), 2))

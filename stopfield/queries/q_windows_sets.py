"""Queries on windows, top-K lists, places and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.functions.hashing import digest
from stopfield.operators import windows as Wn
from stopfield.operators.skew import global_ids, running_sum, with_totals
from stopfield.queries.registry import query
from stopfield.queries.views import FINE, sql_cell, sql_parent


def r(c, digits=6):
    return F.round(c, digits)


@query("merge_stops_by_location", "W1 F10", """
    WITH s AS (SELECT l_orderkey*8+l_linenumber AS row_id, (l_suppkey%40)/10.0 AS lat, (l_suppkey%7)/10.0 AS lon, CASE WHEN l_quantity > 5 THEN l_quantity END AS score, [l_partkey%50, l_partkey%13] AS routes FROM lineitem),
    u AS (SELECT lat, lon, row_id, coalesce(-score, 'infinity'::DOUBLE) AS k, unnest([1,2]) AS p, unnest(routes) AS route FROM s),
    b AS (SELECT lat, lon, min_by(row_id, row(coalesce(-score,'infinity'::DOUBLE), row_id)) AS row_id, max(score) AS score FROM s GROUP BY 1,2),
    d AS (SELECT lat, lon, route, min(row(k, row_id, p)) AS at FROM u GROUP BY 1,2,3)
    SELECT b.row_id, b.lat, b.lon, b.score, string_agg(d.route::VARCHAR, ';' ORDER BY d.at) AS routes FROM b JOIN d USING (lat, lon) GROUP BY 1,2,3,4""")
def _(t):
    s = t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), (F.col("l_suppkey") % 40 / 10.0).alias("lat"), (F.col("l_suppkey") % 7 / 10.0).alias("lon"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("score"), F.array(F.col("l_partkey") % 50, F.col("l_partkey") % 13).alias("routes"))
    return Wn.merge_by_location(s, "row_id", "score", "routes").withColumn("routes", F.array_join("routes", ";"))


@query("far_station_slots", "W2 O4", """
    WITH c AS (SELECT h AS cell, w AS station, w%2 AS g, (w%5) AS rank, ((h*13+w*7)%9000)::DOUBLE AS dist FROM v_flow UNION ALL SELECT h, w, w%2, (w%3), ((h*17+w*5)%9000)::DOUBLE FROM v_flow),
    s AS (SELECT cell, station, g, min(row(dist, rank)) AS m FROM c GROUP BY 1,2,3),
    n AS (SELECT cell, station, g AS "group", m[2] AS rank, m[1] AS dist, row_number() OVER (PARTITION BY cell ORDER BY m[2], m[1], station, g) - 1 AS slot FROM s)
    SELECT cell, station, "group", rank, dist, slot FROM n WHERE slot < 15""")
def _(t):
    h, w = F.col("h"), F.col("w")
    one = t.flow.select(h.alias("cell"), w.alias("station"), (w % 2).alias("group"), (w % 5).alias("rank"), ((h * 13 + w * 7) % 9000).cast("double").alias("dist"))
    two = t.flow.select(h.alias("cell"), w.alias("station"), (w % 2).alias("group"), (w % 3).alias("rank"), ((h * 17 + w * 5) % 9000).cast("double").alias("dist"))
    return Wn.far_slots(one.unionByName(two), 15)


@query("first_and_last_per_key", "W3 W7", """
    SELECT o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def _(t):
    first = Wn.keep_first(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = Wn.keep_first(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [-F.unix_date(F.to_date("o_orderdate")), -F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query("group_totals_on_rows", "W4", """
    SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) OVER g, 2) AS total, count(*) OVER g AS size FROM lineitem WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    out = with_totals(rows, ["l_returnflag", "l_linestatus"], {"total": F.sum("l_extendedprice"), "size": F.count("*")})
    return out.select("l_orderkey", "l_linenumber", r(F.col("total"), 2).alias("total"), "size")


@query("running_weight_by_group", "W5 W9", """
    SELECT id, round(sum(jobs) OVER (ORDER BY state, county, income, md5(id::VARCHAR) ROWS UNBOUNDED PRECEDING), 5) AS cumulative FROM v_unit""")
def _(t):
    return running_sum(t.unit, ["state", "county"], "income", "id", "jobs", "cumulative").select("id", r(F.col("cumulative"), 5).alias("cumulative"))


@query("random_rows_per_unit", "W10", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7:' || o_orderkey::VARCHAR)) AS k FROM orders) WHERE k <= 4""")
def _(t):
    return Wn.top_k(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [digest(F.col("o_orderkey"), 7)], 4)


@query("extreme_rows_kept", "W11", """
    WITH e AS (SELECT arg_min(id, row(los, id)) AS a, arg_max(id, row(los, -id)) AS b, arg_min(id, row(income, id)) AS c, arg_max(id, row(income, -id)) AS d FROM v_unit)
    SELECT id, los, income FROM v_unit, e WHERE id IN (a, b, c, d) OR id % 97 = 0""")
def _(t):
    rows = t.unit.select("id", "los", "income")
    return Wn.cells_either(rows.filter("id % 97 = 0"), Wn.extremes(rows, ["los", "income"], "id"))


@query("best_pattern_per_group", "W12 J32", """
    SELECT station, g, arg_max(route, row(60/headway, -route, direction)) AS route, max(60/headway) AS per_hour FROM (SELECT *, (route%3=0)::INT AS g FROM v_route_service) GROUP BY 1,2""")
def _(t):
    s = t.route_service.withColumn("g", (F.col("route") % 3 == 0).cast("int")).withColumn("per_hour", 60 / F.col("headway"))
    best = Wn.keep_first(s.select("station", "g", "route", "direction", "per_hour"), ["station", "g"], [-F.col("per_hour"), F.col("route"), -F.col("direction")])
    return best.select("station", "g", "route", "per_hour")


@query("places_ranked", "W13", """
    SELECT id, rank() OVER (PARTITION BY state ORDER BY v DESC NULLS LAST) AS place FROM (SELECT id, state, CASE WHEN los > 10 THEN los END AS v FROM v_place)""")
def _(t):
    v = F.when(F.col("los") > 10, F.col("los"))
    return Wn.place_of(t.place.select("id", "state", v.alias("v")), ["state"], "v").select("id", "place")


@query("percentile_of_value", "W14", "SELECT id, round(percent_rank() OVER (PARTITION BY state ORDER BY income), 6) AS percentile FROM v_place")
def _(t):
    return Wn.percentile_of(t.place.select("id", "state", "income"), ["state"], "income").select("id", r(F.col("percentile")).alias("percentile"))


@query("percentile_from_table", "W14 A25", """
    WITH a AS (SELECT list_sort(list(income)) AS v FROM v_place),
    p AS (SELECT k.q AS k, v[floor(k.q/100.0::DOUBLE*(len(v)-1))::INT+1] + (v[ceil(k.q/100.0::DOUBLE*(len(v)-1))::INT+1]-v[floor(k.q/100.0::DOUBLE*(len(v)-1))::INT+1])*(k.q/100.0::DOUBLE*(len(v)-1)-floor(k.q/100.0::DOUBLE*(len(v)-1))) AS x
          FROM a, range(0,101) k(q))
    SELECT id, coalesce(max(k) FILTER (WHERE x <= income), 0)::DOUBLE AS percentile FROM v_place, p GROUP BY 1""")
def _(t):
    from stopfield.operators.skew import exact_quantiles

    table = exact_quantiles(t.place, [], "income", [i / 100 for i in range(101)])
    return Wn.percentile_from_table(t.place.select("id", "income"), table, "income").select("id", "percentile")


@query("running_ids", "W15", """
    SELECT id, row_number() OVER (ORDER BY county, substr(md5(id::VARCHAR),1,3), id) - 1 AS number FROM v_place""")
def _(t):
    return global_ids(t.place.select("id", "county"), "county", "id", "number").select("id", "number")


@query("spatially_sorted_edges", "O1", f"SELECT edge, {sql_cell('x1', 'y1', FINE)} AS cell FROM v_edge")
def _(t):
    return Wn.spatial_order(t.edge.select("edge", grid.cell(F.col("x1"), F.col("y1"), FINE).alias("cell")), "cell")


@query("top_customers", "O2 O3 A41", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 40")
def _(t):
    sums = t.orders.groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("total"))
    return Wn.top_n(sums, [F.col("total").desc(), F.col("o_custkey")], 40)


@query("union_of_ragged_frames", "O5", """
    SELECT 'c' AS kind, id, lon, lat, income, NULL AS mode FROM v_place UNION ALL SELECT 's', station, lon, lat, NULL, mode FROM v_station""")
def _(t):
    a = t.place.select(F.lit("c").alias("kind"), "id", "lon", "lat", "income")
    b = t.station.select(F.lit("s").alias("kind"), F.col("station").alias("id"), "lon", "lat", "mode")
    return Wn.union_all([a, b])


@query("cell_set_operations", "O6 O7", f"""
    WITH a AS (SELECT DISTINCT {sql_cell('lon', 'lat', 9)} AS cell FROM v_place WHERE county < 15), b AS (SELECT DISTINCT {sql_cell('x1', 'y1', 9)} AS cell FROM v_edge WHERE los < 40)
    SELECT 'either' AS op, cell FROM (SELECT cell FROM a UNION SELECT cell FROM b) UNION ALL SELECT 'both', cell FROM (SELECT cell FROM a INTERSECT SELECT cell FROM b)
    UNION ALL SELECT 'only', cell FROM (SELECT cell FROM a EXCEPT SELECT cell FROM b)""")
def _(t):
    a = t.place.filter("county < 15").select(grid.cell(F.col("lon"), F.col("lat"), 9).alias("cell")).distinct()
    b = t.edge.filter("los < 40").select(grid.cell(F.col("x1"), F.col("y1"), 9).alias("cell")).distinct()
    parts = [f.select(F.lit(n).alias("op"), "cell") for n, f in (("either", Wn.cells_either(a, b)), ("both", Wn.cells_both(a, b)), ("only", Wn.cells_only(a, b)))]
    return Wn.union_all(parts)


@query("semi_anti_split", "J3", f"""
    WITH c AS (SELECT DISTINCT {sql_cell('x1', 'y1', FINE)} AS cell FROM v_edge WHERE los > 60)
    SELECT cell, population, cell IN (SELECT cell FROM c) AS on_street FROM v_fine_cell WHERE cell IN (SELECT cell FROM c) OR population > 0""")
def _(t):
    street = t.edge.filter("los > 60").select(grid.cell(F.col("x1"), F.col("y1"), FINE).alias("cell"))
    c = t.fine_cell.select("cell", "population")
    on, off = c.join(street, "cell", "left_semi"), c.join(street, "cell", "left_anti").filter("population > 0")
    return on.withColumn("on_street", F.lit(True)).unionByName(off.withColumn("on_street", F.lit(False)))


@query("coarse_cells_not_covered", "J4", f"""
    SELECT DISTINCT {sql_cell('x1', 'y1', 8)} AS cell FROM v_edge WHERE {sql_cell('x1', 'y1', 8)} NOT IN (SELECT {sql_parent('cell', FINE, 8)} FROM v_fine_cell)""")
def _(t):
    covered = t.fine_cell.select(grid.parent(F.col("cell"), FINE, 8).alias("cell"))
    coarse = t.edge.select(grid.cell(F.col("x1"), F.col("y1"), 8).alias("cell")).distinct()
    return coarse.join(covered, "cell", "left_anti")

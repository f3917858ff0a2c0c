"""Queries on service calendars, departures, headways and feed identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.operators import gtfs as G
from stopfield.queries.registry import query
from stopfield.queries.views import sql_haversine


def r(c, digits=6):
    return F.round(c, digits)


def _counts(t):
    return G.trips_per_day(G.active_services(t.calendar, t.exception), t.trip)


@query("active_services", "C1", "SELECT feed, service, date FROM v_active")
def _(t):
    return G.active_services(t.calendar, t.exception)


@query("trips_per_day", "C2", "SELECT feed, date, trips FROM v_day_count")
def _(t):
    return _counts(t)


@query("day_volume_ratio", "C3", """
    WITH u AS (SELECT feed, isodow(date) AS d, quantile_cont(trips, 0.5) AS usual FROM v_day_count GROUP BY 1,2)
    SELECT c.feed, date, trips, round(trips/usual, 6) AS ratio, trips/usual BETWEEN 0.8 AND 1.25 AS normal FROM v_day_count c JOIN u ON c.feed = u.feed AND isodow(date) = d""")
def _(t):
    v = G.day_volume(_counts(t))
    return v.withColumn("ratio", r(F.col("ratio")))


@query("representative_days", "C4", """
    WITH k AS (SELECT *, CASE isodow(date) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS type FROM v_day_count),
    p AS (SELECT feed, type, date, trips, row_number() OVER (PARTITION BY feed, type ORDER BY trips DESC, date) AS n FROM k)
    SELECT feed, type, CASE WHEN feed = 3 AND type = 'weekday' THEN DATE '2024-01-09' ELSE date END AS date,
       CASE WHEN feed = 3 AND type = 'weekday' AND date <> DATE '2024-01-09' THEN NULL ELSE trips END AS trips FROM p WHERE n = 1""")
def _(t):
    counts = _counts(t)
    pinned = t.trip.filter("feed = 3").select("feed").distinct().withColumn("date", F.lit("2024-01-09").cast("date"))
    parts = [G.representative_day(counts, d, pinned if d == "weekday" else None).withColumn("type", F.lit(d)) for d in ("weekday", "saturday", "sunday")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DAYS = """
    WITH u AS (SELECT feed, isodow(date) AS d, quantile_cont(trips, 0.5) AS usual FROM v_day_count GROUP BY 1,2),
    okay AS (SELECT c.feed FROM v_day_count c JOIN u ON c.feed = u.feed AND isodow(date) = d WHERE date = DATE '2024-01-10' AND trips/usual BETWEEN 0.8 AND 1.25),
    own AS (SELECT feed, date, row_number() OVER (PARTITION BY feed ORDER BY trips DESC, date) AS n FROM v_day_count WHERE isodow(date) < 6),
    days AS (SELECT own.feed, CASE WHEN okay.feed IS NULL THEN date ELSE DATE '2024-01-10' END AS day, okay.feed IS NULL AS fallback FROM own LEFT JOIN okay ON own.feed = okay.feed WHERE n = 1)"""


@query("feeds_split_by_day", "C5", DAYS + """
    SELECT t.feed, day, fallback, count(*) AS trips, count(DISTINCT route) AS routes FROM v_trip t JOIN days ON t.feed = days.feed JOIN v_active a ON a.feed = t.feed AND a.service = t.service AND a.date = day GROUP BY 1,2,3""")
def _(t):
    active = G.active_services(t.calendar, t.exception)
    days = G.scoring_day(G.trips_per_day(active, t.trip), "2024-01-10")
    return G.trips_on_scoring_day(t.trip, active, days).groupBy("feed", "day", "fallback").agg(F.count("*").alias("trips"), F.count_distinct("route").alias("routes"))


@query("feed_day_audit", "C2", DAYS + """,
    w AS (SELECT * FROM v_day_count WHERE isodow(date) < 6), s AS (SELECT feed, max(trips) AS busiest, list_sort(list(trips)) AS v FROM w GROUP BY 1), l AS (SELECT feed, min(date) AS first, max(date) AS last FROM v_day_count GROUP BY 1),
    pk AS (SELECT feed, CASE WHEN feed%4 = 1 THEN day + 40 ELSE day END AS day FROM days),
    c AS (SELECT t.feed, count(DISTINCT stop) AS stops, count(DISTINCT CASE WHEN sec >= 64800 + t.feed*1000 AND sec < 79200 AND t.feed%3 <> 0 THEN stop END) AS served FROM v_trip t JOIN v_active a ON a.feed = t.feed AND a.service = t.service JOIN pk ON pk.feed = t.feed AND a.date = pk.day JOIN v_stop_time k ON k.trip = t.trip GROUP BY 1),
    x AS (SELECT pk.feed, pk.day AS picked, coalesce(w.trips, 0) AS trips_on_date, busiest, v[len(v)//2+1] AS median, coalesce(w.trips,0)/busiest AS ratio, first, last, w.trips IS NULL AS missing, stops, served
          FROM pk LEFT JOIN s USING (feed) LEFT JOIN l USING (feed) LEFT JOIN w ON w.feed = pk.feed AND w.date = pk.day LEFT JOIN c ON c.feed = pk.feed)
    SELECT feed, picked, trips_on_date, busiest, median, round(ratio, 3) AS ratio_to_busiest, coalesce(nullif(concat_ws('; ', CASE WHEN isodow(picked) > 5 THEN 'weekend date' END, CASE WHEN missing THEN 'no working-day service on the date' END,
      CASE WHEN last < DATE '2024-01-31' THEN 'service over since ' || last::VARCHAR END, CASE WHEN picked < first OR picked > last THEN 'date not within the calendar' END, CASE WHEN ratio < 0.8 THEN round(100*ratio,0)::INT::VARCHAR || '% of the trips of the busiest working day' END,
      CASE WHEN stops > 0 AND served = 0 THEN 'no stop served between 06:00 and 22:00' END, CASE WHEN last < DATE '2024-01-31' - 1 OR first > DATE '2024-01-31' + 1 THEN 'calendar of another period' END), ''), 'OK') AS verdict FROM x""")
def _(t):
    # some feeds are audited on a date long after their service, some have only calls outside the window
    active = G.active_services(t.calendar, t.exception)
    counts = G.trips_per_day(active, t.trip)
    day = F.when(F.col("feed") % 4 == 1, F.date_add("day", 40)).otherwise(F.col("day"))
    picked = G.scoring_day(counts, "2024-01-10").select("feed", day.alias("date"))
    running = t.trip.join(picked.join(active, ["feed", "date"]).select("feed", "service"), ["feed", "service"], "left_semi")
    calls = t.stop_time.join(t.trip.select("trip", F.col("feed").alias("f")), "trip")
    calls = calls.select("trip", "stop", F.when((F.col("f") % 3 != 0) & (F.col("sec") >= 64800 + F.col("f") * 1000), F.col("sec")).otherwise(-1).alias("sec"))
    return G.feed_audit(counts, picked, "2024-01-31", G.stops_served(running, calls), horizon=1)


@query("frequency_departures", "C10", """
    WITH g AS (SELECT trip, unnest(range(start, "end", headway)) AS go FROM v_frequency), f AS (SELECT trip, min(sec) AS first FROM v_stop_time GROUP BY 1)
    SELECT stop, count(*) AS departures, sum(go + sec - first)::BIGINT AS total, min(go + sec - first) AS earliest FROM g JOIN v_stop_time USING (trip) JOIN f USING (trip) GROUP BY 1""")
def _(t):
    d = G.departures(t.frequency, t.stop_time)
    return d.groupBy("stop").agg(F.count("*").alias("departures"), F.sum("sec").alias("total"), F.min("sec").alias("earliest"))


@query("runs_per_trip", "A29 C10", """
    SELECT feed, sum(coalesce(n, 1))::BIGINT AS runs FROM v_trip LEFT JOIN (SELECT trip, sum(("end"-start)//headway) AS n FROM v_frequency GROUP BY 1) USING (trip) GROUP BY 1""")
def _(t):
    return G.runs_per_trip(t.trip, t.frequency).groupBy("feed").agg(F.sum("runs").alias("runs"))


@query("headways_by_stop_direction", "W8 K1", """
    WITH d AS (SELECT DISTINCT stop, direction, sec FROM v_departure WHERE sec >= 21600 AND sec < 79200),
    g AS (SELECT stop, direction, sec, (lead(sec) OVER (PARTITION BY stop, direction ORDER BY sec) - sec)::DOUBLE AS gap FROM d)
    SELECT stop, direction, round((coalesce(sum(gap*gap),0) + pow(57600-(max(sec)-min(sec)),2))/57600/60, 6) AS headway, count(*) AS departures FROM g GROUP BY 1,2""")
def _(t):
    h = G.headways(t.departure, ["stop", "direction"])
    return h.withColumn("headway", r(F.col("headway")))


@query("distance_and_time_along_trip", "W6", f"""
    WITH x AS (SELECT trip, seq, sec, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(sec) OVER w AS psec FROM v_stop_time JOIN v_station ON stop = station WINDOW w AS (PARTITION BY trip ORDER BY seq))
    SELECT trip, seq, round(sum(coalesce({sql_haversine('plon', 'plat', 'lon', 'lat')}*1000, 0)) OVER r, 2) AS metres, (sum(coalesce(sec-psec, 0)) OVER r)::BIGINT AS seconds FROM x
    WINDOW r AS (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def _(t):
    out = G.along_trip(t.stop_time, t.station.withColumnRenamed("station", "stop"))
    return out.select("trip", "seq", r(F.col("metres"), 2).alias("metres"), "seconds")


@query("trip_durations", "W7", "SELECT trip, arg_max(sec, seq) - arg_min(sec, seq) AS duration FROM v_stop_time GROUP BY 1")
def _(t):
    return G.trip_durations(t.stop_time)


@query("duplicate_trips_removed", "T7", """
    WITH c AS (SELECT trip%5000 AS k, seq, stop%3 AS stop, (sec//36000)*36000 AS sec, trip FROM v_stop_time),
    s AS (SELECT trip, string_agg(seq::VARCHAR || '@' || stop::VARCHAR || '@' || sec::VARCHAR, ',' ORDER BY seq) AS mark FROM c GROUP BY 1)
    SELECT feed, count(*) AS kept, sum(trip)::BIGINT AS ids FROM (SELECT feed, direction, mark, min(trip) AS trip FROM v_trip JOIN s USING (trip) GROUP BY 1,2,3) GROUP BY 1""")
def _(t):
    calls = t.stop_time.select("trip", "seq", (F.col("stop") % 3).alias("stop"), (F.floor(F.col("sec") / 36000) * 36000).alias("sec"))
    kept = G.dedupe_trips(t.trip, calls, ["feed", "direction"])
    return kept.groupBy("feed").agg(F.count("*").alias("kept"), F.sum("trip").alias("ids"))


ROUTE_TYPES = "[3,3,2,0,1,4,702,11]"


def _routes(t):
    k = F.col("p_partkey")
    types = F.array(*[F.lit(x) for x in (3, 3, 2, 0, 1, 4, 702, 11)])
    ty = F.when(k % 40 < 12, 3).otherwise(F.element_at(types, (k % 8 + 1).cast("int")))
    return t.part.select((k % 40).alias("feed"), k.alias("route"), ty.cast("string").alias("route_type"))


def _agencies(t):
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(x) for x in ("Bus", "Heavy Rail", "Ferryboat", "Light Rail", "Vanpool")])
    return t.supplier.select((k % 40).alias("feed"), (k % 30).alias("agency"), F.element_at(names, ((k + F.floor(k / 40)) % 5 + 1).cast("int")).alias("mode_name"))


ROUTES_SQL = f"SELECT p_partkey%40 AS feed, p_partkey AS route, CASE WHEN p_partkey%40 < 12 THEN 3 ELSE {ROUTE_TYPES}[(p_partkey%8+1)::INT] END AS ty FROM part"
AGENCY_SQL = "SELECT s_suppkey%40 AS feed, s_suppkey%30 AS agency, ['Bus','Heavy Rail','Ferryboat','Light Rail','Vanpool'][((s_suppkey+s_suppkey//40)%5+1)::INT] AS mode_name FROM supplier"


@query("route_scoring_modes", "C6", f"""
    WITH rt AS ({ROUTES_SQL}), ag AS ({AGENCY_SQL}), ty AS (SELECT feed, count(DISTINCT ty) AS n FROM rt GROUP BY 1),
    md AS (SELECT feed, count(DISTINCT mode_name) AS m, max(mode_name) AS name FROM ag GROUP BY 1),
    d AS (SELECT rt.*, n, CASE WHEN m = 1 THEN CASE name WHEN 'Bus' THEN 'bus' WHEN 'Heavy Rail' THEN 'rail' WHEN 'Ferryboat' THEN 'bus' WHEN 'Light Rail' THEN 'tram' END END AS dm,
       CASE WHEN rt.ty IN (702, 0) THEN 'tram' WHEN rt.ty IN (1, 2) THEN 'rail' ELSE 'bus' END AS own FROM rt JOIN ty USING (feed) LEFT JOIN md USING (feed))
    SELECT route, feed, CASE WHEN ty = 702 THEN 'tram' WHEN dm IS NULL OR n > 1 THEN own ELSE dm END AS mode, coalesce(n > 1 AND dm IS NOT NULL, false) AS contradiction FROM d""")
def _(t):
    return G.scoring_modes(_routes(t), _agencies(t)).select("route", "feed", "mode", "contradiction")


PROBLEMS = f"""
    rt AS ({ROUTES_SQL}), ag AS ({AGENCY_SQL}),
    k AS (SELECT feed, CASE WHEN ty IN (0,1,2,11) THEN 'rail' END AS a, CASE WHEN ty IN (3,11,702) THEN 'bus' END AS b, CASE WHEN ty = 4 THEN 'ferry' END AS c FROM rt),
    have AS (SELECT feed, list_sort(list(DISTINCT x)) AS have FROM (SELECT feed, unnest([a,b,c]) AS x FROM k) WHERE x IS NOT NULL GROUP BY 1),
    need AS (SELECT feed, list_sort(list(DISTINCT CASE mode_name WHEN 'Bus' THEN 'bus' WHEN 'Ferryboat' THEN 'ferry' ELSE 'rail' END)) AS need FROM ag WHERE mode_name <> 'Vanpool' GROUP BY 1),
    pr AS (SELECT f.feed, CASE WHEN need IS NULL THEN NULL WHEN have IS NULL THEN 'feed has no usable routes' WHEN NOT list_has_any(need, have) THEN 'needs ' || array_to_string(need,'/') || ' but has only ' || array_to_string(have,'/') END AS problem
      FROM (SELECT DISTINCT feed FROM ag) f LEFT JOIN need USING (feed) LEFT JOIN have USING (feed))"""


@query("rejected_feeds", "C7", f"WITH {PROBLEMS} SELECT feed, problem FROM pr")
def _(t):
    return G.feed_problems(_routes(t), _agencies(t))


@query("agency_modes_without_feed", "C8", f"""
    WITH {PROBLEMS} SELECT DISTINCT agency, mode_name FROM ag WHERE (agency, mode_name) NOT IN (SELECT (agency, mode_name) FROM ag JOIN pr USING (feed) WHERE problem IS NULL)""")
def _(t):
    a = _agencies(t)
    return G.unserved_modes(a, G.feed_problems(_routes(t), a))


@query("feed_resolution_report", "C9", """
    WITH b AS (SELECT s_suppkey AS id, s_suppkey%37 AS agency FROM supplier),
    l AS (SELECT id, CASE WHEN agency IN (SELECT c_custkey%37 FROM customer WHERE c_custkey%5=0 AND c_custkey%37 < 12) THEN 'catalogue' WHEN agency IN (SELECT p_partkey%37 FROM part WHERE p_partkey%37 BETWEEN 10 AND 20) THEN 'second_source'
       WHEN agency IN (SELECT c_custkey%37 FROM customer WHERE c_custkey%37 > 30) THEN 'covered_by_working_feed' ELSE 'unresolved' END AS resolution FROM b)
    SELECT resolution, count(*) AS feeds FROM l GROUP BY 1""")
def _(t):
    broken = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 37).alias("agency"))
    c, p = t.customer.select((F.col("c_custkey") % 37).alias("agency"), (F.col("c_custkey") % 5).alias("m")), t.part.select((F.col("p_partkey") % 37).alias("agency"))
    out = G.feed_resolutions(broken, [("catalogue", c.filter("m = 0 and agency < 12")), ("second_source", p.filter("agency between 10 and 20")), ("covered_by_working_feed", c.filter("agency > 30"))])
    return out.groupBy("resolution").agg(F.count("*").alias("feeds"))


@query("dropped_copies_bookkeeping", "A56", """
    SELECT kept AS feed, count(DISTINCT route) AS routes FROM (SELECT CASE WHEN f%8 >= 5 THEN f%8 - 5 ELSE f%8 END AS kept, route FROM (SELECT feed AS f, route FROM v_trip)) GROUP BY 1""")
def _(t):
    dropped = t.trip.filter("feed >= 5").select(F.col("feed").alias("dropped"), (F.col("feed") - 5).alias("kept")).distinct()
    return G.kept_feed_rows(t.trip.select("feed", "route"), dropped).groupBy("feed").agg(F.count("*").alias("routes"))


@query("stop_groups_150m", "C11", """
    WITH s AS (SELECT 30 + ((p_partkey*104729)%400)/10000.0::DOUBLE AS lat, -100 + ((p_partkey*7919)%400)/10000.0::DOUBLE AS lon FROM part),
    k AS (SELECT *, {m}::DOUBLE AS m, 150/sqrt(2.0) AS side FROM s), w AS (SELECT *, floor(lat*(m/side)) AS row FROM k),
    c AS (SELECT row, floor(lon*(m/side)*greatest(cos(radians(row*(side/m))), cos(radians(row*(side/m)+(side/m))))) AS col FROM w)
    SELECT row::BIGINT::VARCHAR || '_' || col::BIGINT::VARCHAR AS "group", count(*) AS stops FROM c GROUP BY 1""".replace("{m}", repr(__import__("stopfield.functions.grid", fromlist=["x"]).METRES_PER_DEGREE)))
def _(t):
    k = F.col("p_partkey")
    s = t.part.select((F.lit(30) + k * 104729 % 400 / 10000.0).alias("lat"), (F.lit(-100) + k * 7919 % 400 / 10000.0).alias("lon"))
    return G.stop_groups(s).groupBy("group").agg(F.count("*").alias("stops"))


def _scored(t):
    return t.place.select("county", "lon", "lat", F.col("los").alias("score"))


@query("changed_areas", "C12", "SELECT n_nationkey AS county FROM nation WHERE n_nationkey%4 = 1 AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def _(t):
    now = G.area_fingerprints(_scored(t), "county")
    moved = _scored(t).withColumn("score", F.when(F.col("county") % 4 == 1, F.col("score") + 0.001).otherwise(F.col("score")))
    return G.changed_areas(now, G.area_fingerprints(moved, "county"), "county")


@query("stop_table_by_id", "C13", """
    SELECT c.id AS stop, c.county AS station, s.score, n.routes FROM v_place c LEFT JOIN (SELECT station, max(headway) AS score FROM v_route_service GROUP BY 1) s ON c.county = s.station
    LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS routes FROM orders GROUP BY 1) n ON c.id = o_custkey""")
def _(t):
    stops = t.place.select(F.col("id").alias("stop"), F.col("county").cast("long").alias("station"), "lon", "lat")
    stations = t.route_service.groupBy("station").agg(F.max("headway").alias("score"))
    routes = t.orders.select(F.col("o_custkey").alias("stop"), F.col("o_orderstatus").alias("route"))
    return G.stop_table(stops, stations, routes).select("stop", "station", "score", F.array_join("routes", ";").alias("routes"))


@query("feed_tiers", "C14 J31", """
    WITH f AS (SELECT s_suppkey AS feed, (s_suppkey*7)%5 AS tier, s_suppkey%30 AS content FROM supplier)
    SELECT feed, tier FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY tier, feed) AS n FROM f) WHERE n = 1""")
def _(t):
    k = F.col("s_suppkey")
    feeds = t.supplier.select(k.alias("feed"), (k * 7 % 5).alias("tier"))
    stops = t.supplier.select(k.alias("feed"), F.explode(F.sequence(k % 30, k % 30 + 3)).alias("stop"))
    routes = t.supplier.select(k.alias("feed"), (k % 30).alias("route"))
    return G.keep_first_tier(feeds, G.feed_marks(stops, routes))


_FEED_BASE = "CASE s_suppkey%10 WHEN 1 THEN s_suppkey-1 WHEN 2 THEN s_suppkey-2 ELSE s_suppkey END"


@query("copied_feeds", "J31", f"""
    WITH f AS (SELECT s_suppkey AS feed, (s_suppkey*7)%5 AS tier, {_FEED_BASE} AS base, CASE WHEN s_suppkey%10 = 2 THEN s_suppkey-2 ELSE s_suppkey END AS route, CASE WHEN s_suppkey%10 = 3 THEN s_suppkey-3 WHEN s_suppkey%10 > 5 THEN NULL ELSE s_suppkey END AS op FROM supplier),
    p AS (SELECT l_suppkey AS b, l_partkey AS stop, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
    s AS (SELECT feed, stop FROM f JOIN p ON b = base WHERE NOT (feed%10 = 1 AND n = 1)), z AS (SELECT feed, count(*) AS n, list(stop ORDER BY stop) AS l FROM s GROUP BY 1),
    k AS (SELECT f.feed, tier, coalesce(l::VARCHAR,'') || '/' || route::VARCHAR AS mark, op FROM f LEFT JOIN z USING (feed)), rep AS (SELECT feed, tier FROM (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY tier, feed) AS n FROM k) WHERE n = 1),
    o AS (SELECT a.feed AS x, b.feed AS y, count(*) AS shared FROM s a JOIN s b ON a.stop = b.stop AND a.feed < b.feed WHERE a.feed IN (SELECT feed FROM rep) AND b.feed IN (SELECT feed FROM rep) GROUP BY 1,2),
    e AS (SELECT x, y FROM o JOIN z zx ON zx.feed = x JOIN z zy ON zy.feed = y WHERE shared >= 0.9*least(zx.n, zy.n) - 1e-9),
    c AS (SELECT k.feed, row(m.tier, m.feed) AS b, 'content' AS reason FROM k JOIN (SELECT mark, min(row(tier, feed)) AS q FROM k GROUP BY 1) USING (mark) JOIN k m ON row(m.tier, m.feed) = q WHERE m.feed <> k.feed
      UNION ALL SELECT k.feed, row(m.tier, m.feed), 'operators' FROM k JOIN (SELECT op, min(row(tier, feed)) AS q FROM k WHERE op IS NOT NULL GROUP BY 1) USING (op) JOIN k m ON row(m.tier, m.feed) = q WHERE m.feed <> k.feed
      UNION ALL SELECT CASE WHEN row(ra.tier, x) < row(rb.tier, y) THEN y ELSE x END, least(row(ra.tier, x), row(rb.tier, y)), 'overlap' FROM e JOIN rep ra ON ra.feed = x JOIN rep rb ON rb.feed = y)
    SELECT feed, arg_min(b, row(b, reason))[2] AS kept, arg_min(reason, row(b, reason)) AS reason FROM c GROUP BY 1""")
def _(t):
    # feeds of one supplier's parts as stops; some are copies with a stop less, some whole ones, some of the same operator
    k = F.col("s_suppkey")
    f = t.supplier.select(k.alias("feed"), (k * 7 % 5).alias("tier"), F.expr(_FEED_BASE).alias("base"))
    parts = t.lineitem.select(F.col("l_suppkey").alias("base"), F.col("l_partkey").alias("stop")).distinct()
    least = parts.groupBy("base").agg(F.min("stop").alias("least"))
    stops = f.join(parts, "base").join(least, "base").filter((F.col("feed") % 10 != 1) | (F.col("stop") != F.col("least"))).select("feed", "stop")
    routes = t.supplier.select(k.alias("feed"), F.when(k % 10 == 2, k - 2).otherwise(k).alias("route"))
    operators = t.supplier.select(k.alias("feed"), F.when(k % 10 == 3, k - 3).when(k % 10 <= 5, k).alias("operator"))
    return G.copied_feeds(f.select("feed", "tier"), stops, routes, operators)


@query("feed_boxes_and_status", "A51", """
    SELECT county AS feed, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS stops, CASE WHEN count(*) > 60 THEN 'full' ELSE 'partial' END AS status FROM v_place GROUP BY 1""")
def _(t):
    out = G.feed_boxes(t.place.withColumnRenamed("county", "feed"))
    return out.withColumn("status", F.when(F.col("stops") > 60, "full").otherwise("partial"))


@query("renamed_route_modes", "J18", """
    SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey%3 <> 1 AND p_partkey%4 <> 3 THEN CASE WHEN p_partkey%2=0 THEN 'rail' ELSE 'bus' END END, CASE WHEN p_partkey%4 IN (0) THEN 'tram' WHEN p_partkey%4 IN (1,2) THEN 'rail' ELSE 'bus' END) AS mode FROM part""")
def _(t):
    k = F.col("p_partkey")
    own = F.concat(F.lit("R"), k.cast("string"))
    loaded = t.part.select(k.alias("id"), (k % 3).alias("file_id"), F.when(k % 5 == 0, F.concat(own, F.lit("_file_"), (k % 3).cast("string"))).otherwise(F.concat(F.lit(" "), own, F.lit(" "))).alias("route"), (k % 4).cast("string").alias("route_type"))
    table = t.part.filter("p_partkey % 3 <> 1 and p_partkey % 4 <> 3").select(own.alias("route"), (k % 3).alias("file_id"), (k % 4).cast("string").alias("route_type"), F.when(k % 2 == 0, "rail").otherwise("bus").alias("mode"))
    return G.route_modes(loaded, table).select("id", "mode")


@query("route_display_names", "J35", """
    WITH s AS (SELECT o_orderkey AS stop, o_custkey%8 AS feed, [o_orderkey%11, o_orderkey%7, o_orderkey%11, 20 + o_orderkey%3] AS ids FROM orders),
    i AS (SELECT stop, feed, unnest([1,2,3,4]) AS p, unnest(ids) AS route FROM s),
    n AS (SELECT stop, p, CASE WHEN route > 20 THEN route::VARCHAR WHEN route%8 <> 0 OR feed = 0 THEN 'L' || (route%4)::VARCHAR || CASE WHEN route%2 = feed%2 THEN 'a' ELSE 'x' END ELSE 'x' END AS name, feed, route FROM i),
    o AS (SELECT s.stop, s.p, coalesce(CASE WHEN (route + feed)%2 = 0 AND route <= 20 THEN 'L' || route::VARCHAR || '-' || feed::VARCHAR END, CASE WHEN route <= 20 THEN 'L' || route::VARCHAR || '-' || (route%2)::VARCHAR END, route::VARCHAR) AS name FROM n s),
    u AS (SELECT stop, name, min(p) AS p FROM o GROUP BY 1,2)
    SELECT stop, string_agg(name, ',' ORDER BY p) AS labels FROM u GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey")
    ids = F.concat_ws(";", (k % 11).cast("string"), F.concat((k % 7).cast("string"), F.lit("_file_2")), (k % 11).cast("string"), (F.lit(20) + k % 3).cast("string"))
    stops = t.orders.select(k.alias("stop"), (F.col("o_custkey") % 8).alias("feed"), ids.alias("route_ids"))
    pairs = t.orders.select((F.col("o_custkey") % 8).alias("feed")).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(20)))).filter("(r + feed) % 2 = 0")
    routes = pairs.select("feed", F.col("r").cast("string").alias("route"), F.concat(F.lit("L"), F.col("r").cast("string"), F.lit("-"), F.col("feed").cast("string")).alias("name"))
    return G.route_names(stops, routes).select("stop", "labels")


@query("station_names_repaired", "J36", """
    SELECT s_suppkey AS id, CASE WHEN s_suppkey%3=0 AND s_suppkey%2=0 THEN s_name WHEN s_suppkey%3=0 THEN 'S' || s_suppkey::VARCHAR || '_file_1' ELSE 'Own ' || s_suppkey::VARCHAR END AS name FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    station = F.concat(F.lit("S"), k.cast("string"), F.lit("_file_1"))
    stations = t.supplier.select(k.alias("id"), station.alias("station"), F.when(k % 3 == 0, station).otherwise(F.concat(F.lit("Own "), k.cast("string"))).alias("name"))
    names = t.supplier.select(F.concat(F.lit("S"), k.cast("string")).alias("stop"), F.when(k % 2 == 0, F.col("s_name")).otherwise("").alias("name"))
    return G.repair_names(stations, names).select("id", "name")


@query("stops_to_stations_by_place", "J34", """
    SELECT c.id, s.station FROM (SELECT c_custkey AS id, 30 + (c_custkey%50)/7.0::DOUBLE AS lat, -100 + (c_custkey%50)/3.0::DOUBLE AS lon FROM customer) c
    LEFT JOIN (SELECT s_suppkey AS station, 30 + s_suppkey/7.0::DOUBLE AS lat, -100 + s_suppkey/3.0::DOUBLE AS lon FROM supplier) s ON round(c.lat,6) = round(s.lat,6) AND round(c.lon,6) = round(s.lon,6)""")
def _(t):
    k, m = F.col("c_custkey") % 50, F.col("s_suppkey")
    at = lambda la, lo: [F.round(la, 6).alias("_la"), F.round(lo, 6).alias("_lo")]
    c = t.customer.select(F.col("c_custkey").alias("id"), *at(F.lit(30) + k / 7.0, F.lit(-100) + k / 3.0))
    s = t.supplier.select(m.alias("station"), *at(F.lit(30) + m / 7.0, F.lit(-100) + m / 3.0))
    return c.join(s, ["_la", "_lo"], "left").select("id", "station")

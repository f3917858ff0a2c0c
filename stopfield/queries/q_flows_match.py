"""Queries on flows, matching and timetable building."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions.clock import in_peak
from stopfield.functions.text import tokens
from stopfield.operators import flows as W
from stopfield.operators import match as M
from stopfield.operators import timetable as T
from stopfield.queries.registry import query
from stopfield.queries.views import sql_haversine


def r(c, digits=6):
    return F.round(c, digits)


BINS = [f"b{i}" for i in range(12)]
MID = [2.5, 7.0, 12.0, 17.0, 22.0, 27.0, 32.0, 37.0, 42.0, 52.0, 74.5, 105.0]
GROUPS = "SELECT substr(geoid,1,12) AS geoid, " + ", ".join(f"count(*) FILTER (WHERE (o_orderkey*7+id)%12 = {i})::DOUBLE AS b{i}" for i in range(12)) + ", count(*)::DOUBLE AS total FROM orders JOIN v_place ON o_custkey = id GROUP BY 1"
_N, _M = "+".join(BINS), "+".join(f"{b}*{m}" for b, m in zip(BINS, MID))


@query("commute_minutes_from_bins", "A30 J24", f"""
    WITH g AS ({GROUPS}), b AS (SELECT *, substr(geoid,1,11) AS tract, ({_M})/({_N}) AS m, {_N} AS n FROM g), t AS (SELECT substr(geoid,1,11) AS tract, avg(los)*0.8 AS tract_mean FROM v_place GROUP BY 1),
    k AS (SELECT tract, tract_mean/(sum(m*n)/sum(total)) AS f FROM b JOIN t USING (tract) GROUP BY tract, tract_mean)
    SELECT geoid, round(m*CASE WHEN f > 0.5 AND f < 2 THEN f ELSE 1 END, 6) AS minutes FROM b JOIN k USING (tract)""")
def _(t):
    rows = t.orders.join(t.place.select("id", "geoid"), F.col("o_custkey") == F.col("id"))
    slot = (F.col("o_orderkey") * 7 + F.col("id")) % 12
    g = rows.groupBy(F.substring("geoid", 1, 12).alias("geoid")).agg(*[F.count_if(slot == i).cast("double").alias(f"b{i}") for i in range(12)], F.count("*").cast("double").alias("total"))
    tracts = t.place.groupBy(F.substring("geoid", 1, 11).alias("tract")).agg((F.avg("los") * 0.8).alias("tract_mean"))
    return W.commute_minutes(g, tracts, BINS, "total").select("geoid", r(F.col("minutes")).alias("minutes"))


TIMES = f"""
    f AS (SELECT h, w, n, a.los AS res, {sql_haversine('a.lon','a.lat','b.lon','b.lat')} AS km FROM v_flow JOIN v_place a ON h = a.id JOIN v_place b ON w = b.id),
    g AS (SELECT h, w, n, res, greatest(km, 0.5) AS km, 8.0+greatest(km,0.5)/0.5 AS g FROM f WHERE km <= 900), t AS (SELECT h, w, n, km, res*g/(sum(g*n) OVER (PARTITION BY h)/sum(n) OVER (PARTITION BY h)) AS t FROM g)"""


def _times(t):
    return W.flow_times(t.flow, t.place.select("id", "lon", "lat", F.col("los").alias("minutes")), 900.0)


@query("flow_times_at_work", "A31 J23", f"WITH {TIMES} SELECT w, sum(n)::BIGINT AS workers, round(sum(t*n)/sum(n),6) AS minutes, round(sum(km*n)/sum(n),4) AS km FROM t GROUP BY 1")
def _(t):
    return W.flow_summary(_times(t), "w").select("w", "workers", r(F.col("minutes")).alias("minutes"), r(F.col("km"), 4).alias("km"))


@query("flow_times_at_home", "A31 J23", f"WITH {TIMES} SELECT h, sum(n)::BIGINT AS workers, round(sum(t*n)/sum(n),6) AS minutes, round(sum(km*n)/sum(n),4) AS km FROM t GROUP BY 1")
def _(t):
    return W.flow_summary(_times(t), "h").select("h", "workers", r(F.col("minutes")).alias("minutes"), r(F.col("km"), 4).alias("km"))


ENDS = """
    v AS (SELECT id, CASE WHEN los >= 5 THEN los END AS los FROM v_place), a AS (SELECT h AS id, sum(n*los)/sum(n) AS at_work, sum(n)::BIGINT AS at_work_n FROM v_flow JOIN v ON w = v.id WHERE los IS NOT NULL GROUP BY 1),
    b AS (SELECT w AS id, sum(n*los)/sum(n) AS at_home, sum(n)::BIGINT AS at_home_n FROM v_flow JOIN v ON h = v.id WHERE los IS NOT NULL GROUP BY 1), e AS (SELECT * FROM a FULL JOIN b USING (id))"""


def _ends(t):
    return W.other_end(t.flow, t.place.select("id", F.when(F.col("los") >= 5, F.col("los")).alias("los")), "id", "los")


@query("los_at_other_end", "A32 J23", f"WITH {ENDS} SELECT id, round(at_work,6) AS at_work, at_work_n, round(at_home,6) AS at_home, at_home_n FROM e")
def _(t):
    return _ends(t).select("id", r(F.col("at_work")).alias("at_work"), "at_work_n", r(F.col("at_home")).alias("at_home"), "at_home_n")


@query("los_at_other_end_by_county", "A32 A6 J24", f"""
    WITH {ENDS} SELECT substr(geoid,1,5) AS level, round(sum(at_work*at_work_n)/sum(CASE WHEN at_work IS NOT NULL THEN at_work_n END),6) AS at_work, round(sum(at_home*at_home_n)/sum(CASE WHEN at_home IS NOT NULL THEN at_home_n END),6) AS at_home
    FROM e JOIN v_place USING (id) GROUP BY 1""")
def _(t):
    e = _ends(t).join(t.place.select("id", "geoid"), "id")
    out = W.by_level(e, F.substring("geoid", 1, 5), [("at_work", "at_work_n"), ("at_home", "at_home_n")])
    return out.select("level", r(F.col("at_work")).alias("at_work"), r(F.col("at_home")).alias("at_home"))


@query("tract_figure_recovered", "A36 W4", "SELECT id, round(sum(CASE WHEN id%5 > 0 THEN income END) OVER (PARTITION BY substr(geoid,1,11)),2) AS gini FROM v_place")
def _(t):
    df = t.place.select("id", "geoid", F.when(F.col("id") % 5 > 0, F.col("income")).alias("part"))
    return W.tract_sum(df, "geoid", "part", "gini").select("id", r(F.col("gini"), 2).alias("gini"))


@query("car_speed_by_tract", "A37", """
    SELECT substr(geoid,1,11) AS tract, round((sum(income*population)/sum(population))/nullif(sum(los/60*population)/sum(population),0),4) AS kmh FROM v_unit GROUP BY 1 HAVING sum(los*population) > 0""")
def _(t):
    u = t.unit.withColumn("tract", F.substring("geoid", 1, 11))
    out = W.group_speed(u, "tract", "income", F.col("los") / 60, "population").filter("kmh is not null")
    return out.select("tract", r(F.col("kmh"), 4).alias("kmh"))


@query("flows_of_counties", "J23 S5", """
    SELECT c_nationkey AS h, s_nationkey AS w, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1,2""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("h_id"), F.col("c_nationkey").alias("h"))
    s = t.supplier.select(F.col("s_suppkey").alias("w_id"), F.col("s_nationkey").alias("w"))
    # place pairs are summed first, so a busy place reaches the lookups once per partner
    f = t.flow.select(F.col("h").alias("h_id"), F.col("w").alias("w_id"), "n")
    return f.join(c, "h_id").join(s, "w_id").groupBy("h", "w").agg(F.sum("n").alias("n"))


# --- matching -------------------------------------------------------------------------------------------------------------------------------

WORDS = "['red','blue','green','small','large','metro','valley','river','north','coast','line','ring','express','harbor','hill']"


def _named(k, salt):
    words = F.array(*[F.lit(w) for w in ("red", "blue", "green", "small", "large", "metro", "valley", "river", "north", "coast", "line", "ring", "express", "harbor", "hill")])
    pick = lambda m: F.element_at(words, (k * m % 15 + 1).cast("int"))
    return F.concat_ws(" ", pick(7 + salt), pick(11 + salt), F.lit("Transit Authority"), pick(4 + salt))


def _named_sql(k, salt):
    p = lambda m: f"{WORDS}[(({k}*{m})%15+1)::INT]"
    return f"concat_ws(' ', {p(7 + salt)}, {p(11 + salt)}, 'Transit Authority', {p(4 + salt)})"


TOKENS = "list_distinct(list_filter(string_split(lower({n}), ' '), lambda w: length(w) > 1 AND w NOT IN ('transit','authority','metro')))"
JACCARD = "len(list_intersect({a},{b}))::DOUBLE/nullif(len({a})+len({b})-len(list_intersect({a},{b})),0)"


@query("similar_name_pairs", "F7 J21", f"""
    WITH a AS (SELECT s_suppkey AS l, {TOKENS.format(n=_named_sql('s_suppkey', 0))} AS t FROM supplier), b AS (SELECT p_partkey AS r, {TOKENS.format(n=_named_sql('p_partkey', 2))} AS t FROM part),
    j AS (SELECT l, r, {JACCARD.format(a='a.t', b='b.t')} AS score FROM a, b) SELECT l, count(*) AS pairs, round(sum(score),6) AS score FROM j WHERE score >= 0.5 GROUP BY 1""")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("l"), tokens(_named(F.col("s_suppkey"), 0)).alias("tk"))
    b = t.part.select(F.col("p_partkey").alias("r"), tokens(_named(F.col("p_partkey"), 2)).alias("tk"))
    return M.similar_counts(a, b, "l", "r", "tk").withColumn("score", r(F.col("score")))


def _broken(t):
    k = F.col("s_suppkey")
    west, south = F.lit(-100.0) + k % 20, F.lit(30.0) + k % 15
    return t.supplier.select(k.alias("feed"), _named(k, 0).alias("name"), F.concat(F.lit("S"), (k % 10).cast("string")).alias("state"),
                             west.alias("west"), south.alias("south"), (west + 2).alias("east"), (south + 2).alias("north"))


def _catalogue(t):
    k = F.col("p_partkey")
    west, south = F.lit(-100.0) + k * 3 % 20, F.lit(30.0) + k * 5 % 15
    return t.part.select(k.alias("entry"), _named(k, 2).alias("provider"), F.concat(F.lit("s"), (k % 10).cast("string")).alias("state"), F.when(k % 4 == 0, "inactive").otherwise("active").alias("status"),
                         west.alias("west"), south.alias("south"), (west + 3).alias("east"), (south + 3).alias("north"))


@query("catalogue_matches", "J19", f"""
    WITH a AS (SELECT s_suppkey AS feed, s_suppkey%10 AS st, -100.0+s_suppkey%20 AS w, 30.0+s_suppkey%15 AS s, {TOKENS.format(n=_named_sql('s_suppkey', 0))} AS t FROM supplier),
    b AS (SELECT p_partkey AS entry, p_partkey%10 AS st, -100.0+p_partkey*3%20 AS w, 30.0+p_partkey*5%15 AS s, {TOKENS.format(n=_named_sql('p_partkey', 2))} AS t FROM part WHERE p_partkey%4 <> 0),
    j AS (SELECT feed, entry, {JACCARD.format(a='a.t', b='b.t')} AS score FROM a, b WHERE a.st = b.st OR (b.w+3 >= a.w AND b.w <= a.w+2 AND b.s+3 >= a.s AND b.s <= a.s+2)),
    m AS (SELECT *, max(score) OVER (PARTITION BY feed) AS best FROM j WHERE score >= 0.5), k AS (SELECT feed, entry, score, false AS forced FROM m WHERE score >= greatest(0.5, best-0.1) AND feed%9 <> 0
      UNION ALL SELECT s_suppkey, s_suppkey*2, 1.0, true FROM supplier WHERE s_suppkey%9 = 0 AND s_suppkey*2 IN (SELECT p_partkey FROM part))
    SELECT feed, count(*) AS entries, sum(entry)::BIGINT AS ids, round(sum(score),6) AS score, bool_or(forced) AS forced FROM k GROUP BY 1""")
def _(t):
    forced = t.supplier.filter("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("feed"), (F.col("s_suppkey") * 2).alias("entry"))
    return M.catalogue_totals(_broken(t), _catalogue(t), forced).withColumn("score", r(F.col("score")))


@query("agency_match_scores", "J20 F8", f"""
    WITH p AS (SELECT p_partkey AS id, {_named_sql('p_partkey', 0)} AS a, CASE p_partkey%4 WHEN 0 THEN {_named_sql('p_partkey', 2)} WHEN 1 THEN {WORDS}[((p_partkey*7)%15+1)::INT] || 'x' WHEN 2 THEN {_named_sql('p_partkey', 0)} || ' Airport'
        ELSE upper(substr({WORDS}[((p_partkey*7)%15+1)::INT],1,2) || substr({WORDS}[((p_partkey*11)%15+1)::INT],1,1) || 'ta' || substr({WORDS}[((p_partkey*4)%15+1)::INT],1,1)) END AS b FROM part),
    q AS (SELECT id, a, b, {TOKENS.format(n='a')} AS ta, {TOKENS.format(n='b')} AS tb FROM p),
    s AS (SELECT id, CASE WHEN id%4 = 2 THEN 0 ELSE greatest(coalesce(CASE WHEN len(ta)>0 AND len(tb)>0 THEN {JACCARD.format(a='ta', b='tb')} END,0), CASE WHEN id%4 = 3 THEN 0.9 ELSE 0 END,
        CASE WHEN len(list_filter(ta, lambda w: length(w) >= 6 AND length(regexp_replace(lower(b),'[^a-z0-9]','','g')) >= 6 AND (contains(regexp_replace(lower(b),'[^a-z0-9]','','g'), w) OR contains(w, regexp_replace(lower(b),'[^a-z0-9]','','g'))))) > 0 THEN 0.6 ELSE 0 END) END AS score FROM q)
    SELECT id, round(score,6)::DOUBLE AS score FROM s""")
def _(t):
    k = F.col("p_partkey")
    words = F.array(*[F.lit(w) for w in ("red", "blue", "green", "small", "large", "metro", "valley", "river", "north", "coast", "line", "ring", "express", "harbor", "hill")])
    pick = lambda m: F.element_at(words, (k * m % 15 + 1).cast("int"))
    acr = F.upper(F.concat(F.substring(pick(7), 1, 2), F.substring(pick(11), 1, 1), F.lit("ta"), F.substring(pick(4), 1, 1)))
    other = F.when(k % 4 == 0, _named(k, 2)).when(k % 4 == 1, F.concat(pick(7), F.lit("x"))).when(k % 4 == 2, F.concat(_named(k, 0), F.lit(" Airport"))).otherwise(acr)
    return t.part.select(k.alias("id"), r(M.match_score(_named(k, 0), other)).alias("score"))


@query("fuzzy_similarity", "J21", f"""
    WITH p AS (SELECT p_partkey AS id, {_named_sql('p_partkey', 0)} AS a, {_named_sql('p_partkey', 2)} AS b FROM part), q AS (SELECT *, {TOKENS.format(n='a')} AS ta, {TOKENS.format(n='b')} AS tb FROM p),
    s AS (SELECT id, greatest(coalesce({JACCARD.format(a='ta', b='tb')},0), 0.8*(1-levenshtein(lower(a),lower(b))::DOUBLE/greatest(length(a),length(b)))) AS s FROM q)
    SELECT id, round(s,6) AS similarity, s >= 0.45 AND id%3 > 0 AND id%11 >= 3 AND (id%2 > 0 OR id%7 >= 3) AS verified FROM s""")
def _(t):
    k = F.col("p_partkey")
    p = t.part.select(k.alias("id"), M.similarity(_named(k, 0), _named(k, 2)).alias("s"))
    i = F.col("id")
    return p.select("id", r(F.col("s")).alias("similarity"), M.verified(F.col("s"), i % 3, i % 11, i % 7, i % 2).alias("verified"))


@query("feed_candidates_in_boxes", "J21", f"""
    WITH a AS (SELECT id AS place, {_named_sql('id', 0)} AS a, lon, lat FROM v_place), b AS (SELECT p_partkey AS entry, {_named_sql('p_partkey', 2)} AS b, -100.0+p_partkey*3%20 AS w, 30.0+p_partkey*5%15 AS s, CASE WHEN p_partkey%50 = 0 THEN 9.0 ELSE 0.25 + p_partkey%3 END AS d FROM part),
    q AS (SELECT place, entry, a, b, {TOKENS.format(n='a')} AS ta, {TOKENS.format(n='b')} AS tb FROM a JOIN b ON lon BETWEEN w AND w+d AND lat BETWEEN s AND s+d),
    z AS (SELECT place, entry, greatest(coalesce({JACCARD.format(a='ta', b='tb')},0), 0.8*(1-levenshtein(lower(a),lower(b))::DOUBLE/greatest(length(a),length(b)))) AS similarity FROM q),
    k AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(similarity,9) DESC, entry) AS rank FROM z) SELECT place, entry, round(similarity,6) AS similarity, rank::INT AS rank FROM k WHERE rank <= 3""")
def _(t):
    places = t.place.select(F.col("id").alias("place"), _named(F.col("id"), 0).alias("name"), "lon", "lat")
    k = F.col("p_partkey")
    west, south, side = F.lit(-100.0) + k * 3 % 20, F.lit(30.0) + k * 5 % 15, F.when(k % 50 == 0, 9.0).otherwise(F.lit(0.25) + k % 3)
    boxes = t.part.select(k.alias("entry"), _named(k, 2).alias("name"), west.alias("west"), south.alias("south"), (west + side).alias("east"), (south + side).alias("north"))
    return M.box_candidates(places, boxes, 3).withColumn("similarity", r(F.col("similarity")))


@query("survey_names_to_codes", "J22 F6", """
    WITH s AS (SELECT DISTINCT CASE p_partkey%4 WHEN 0 THEN 'Pláce ' || p_partkey::VARCHAR WHEN 1 THEN 'Nowhere/Place ' || p_partkey::VARCHAR WHEN 2 THEN 'Old Town' ELSE 'Ghost ' || p_partkey::VARCHAR END AS name FROM part),
    k AS (SELECT 'place ' || id::VARCHAR AS k, arg_max(id, row(population, -id)) AS code FROM v_unit GROUP BY 1),
    m AS (SELECT name, CASE WHEN name = 'Old Town' THEN 'place 1' WHEN name LIKE 'Nowhere%' THEN lower(string_split(name,'/')[2]) ELSE replace(lower(name),'á','a') END AS k FROM s) SELECT name, code FROM m LEFT JOIN k USING (k)""")
def _(t):
    k = F.col("p_partkey")
    no = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("Pláce "), no)).when(k % 4 == 1, F.concat(F.lit("Nowhere/Place "), no)).when(k % 4 == 2, "Old Town").otherwise(F.concat(F.lit("Ghost "), no))
    places = t.unit.select(F.col("id").alias("code"), F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name"), "population")
    return M.survey_codes(t.part.select(name.alias("name")).distinct(), places, {"old town": "place 1"}).select("name", "code")


# --- timetables -----------------------------------------------------------------------------------------------------------------------------


def _route_stops(t):
    s = t.stop_time.join(t.station.select(F.col("station").alias("stop"), "lon", "lat"), "stop")
    # consecutive numbers of a trip's calls: a trip is a short sequence
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("trip").orderBy("seq"))
    return s.select(F.col("trip").alias("route"), n.alias("seq"), "stop", "lon", "lat", (F.lit(15.0) + F.col("trip") % 30).alias("kmh"))


@query("trips_from_stop_lists", "T1 W6 F3 S11", f"""
    WITH s AS (SELECT trip AS route, row_number() OVER (PARTITION BY trip ORDER BY seq) AS seq, stop, lon, lat, 15.0+trip%30 AS kmh FROM v_stop_time JOIN v_station ON stop = station),
    n AS (SELECT *, max(seq) OVER (PARTITION BY route) AS n FROM s), b AS (SELECT route, 0 AS d, seq, stop, lon, lat, kmh FROM n UNION ALL SELECT route, 1, n-seq+1, stop, lon, lat, kmh FROM n),
    x AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM b WINDOW w AS (PARTITION BY route, d ORDER BY seq)),
    y AS (SELECT route, d, seq, stop, round_even(sum(coalesce({sql_haversine('px','py','lon','lat')}*1000,0)) OVER (PARTITION BY route, d ORDER BY seq)/(kmh/3.6),0)::BIGINT AS sec FROM x)
    SELECT route::VARCHAR || '_' || d::VARCHAR AS trip, count(*) AS calls, max(sec) AS duration, arg_max(stop, seq) AS last_stop FROM y GROUP BY 1""")
def _(t):
    trips, calls = T.trips_from_stops(_route_stops(t), "kmh")
    return calls.join(trips, "trip").groupBy("trip").agg(F.count("*").alias("calls"), F.max("sec").alias("duration"), F.max_by("stop", "seq").alias("last_stop"))


BANDS = ((0, 420, "early"), (420, 570, "am"), (570, 1020, "midday"), (1020, 1170, "pm"), (1170, 1260, "evening"), (1260, 1800, "late"))
PROFILES = {"ECONOMY": {"early": 20, "am": 8.5, "midday": 12.5, "pm": 8.5, "evening": 12.5, "late": 20}, "STANDARD": {"am": 30, "pm": 30}, "PROMO": {"am": 16, "midday": 21, "pm": 16, "evening": 21}}
_BV = ", ".join(f"({a},{b},'{n}')" for a, b, n in BANDS)
_PV = ", ".join(f"('{c}','{b}',{m}::DOUBLE)" for c, p in PROFILES.items() for b, m in p.items())


def _windows(t):
    k = F.col("p_partkey")
    routes = t.part.select(k.alias("route"), F.col("p_type").alias("class"), (F.lit(240) + k % 300).alias("open"), (F.lit(1000) + k % 600).alias("close"))
    return T.frequency_windows(routes, BANDS, PROFILES)


WINDOWS = f"""
    w AS (SELECT p_partkey AS route, b.band, greatest(b.s, 240+p_partkey%300) AS start, least(b.e, 1000+p_partkey%600) AS "end", h AS headway FROM part, (VALUES {_BV}) b(s,e,band), (VALUES {_PV}) q(c,band,h)
      WHERE q.c = p_type AND q.band = b.band AND greatest(b.s, 240+p_partkey%300) < least(b.e, 1000+p_partkey%600))"""


@query("frequency_windows", "T2 J27", f'WITH {WINDOWS} SELECT route, band, start, "end", headway FROM w')
def _(t):
    return _windows(t)


@query("windows_active_at_0830", "J28", f'WITH {WINDOWS} SELECT route, band, headway FROM w WHERE start <= 510 AND "end" > 510')
def _(t):
    return T.active_at(_windows(t), 510).select("route", "band", "headway")


@query("fleet_headways", "T3 F17", """
    WITH b AS (SELECT l_partkey%50 AS corridor, sum(l_quantity)/10 AS km FROM lineitem GROUP BY 1), l AS (SELECT s_suppkey%50 AS corridor, s_suppkey AS line, 20+s_suppkey%70 AS fleet, 15.0+s_suppkey%15 AS kmh FROM supplier)
    SELECT corridor, line, greatest(2.0, least(60.0, round_even(km/kmh*60*(1+0.1)/(fleet*(1-0.08-0.09)),0))) AS headway FROM l JOIN b USING (corridor)""")
def _(t):
    b = t.lineitem.select((F.col("l_partkey") % 50).alias("corridor"), (F.col("l_quantity") / 10).alias("km"))
    s = F.col("s_suppkey")
    lines = t.supplier.select((s % 50).alias("corridor"), s.alias("line"), (F.lit(20) + s % 70).alias("fleet"), (F.lit(15.0) + s % 15).alias("kmh"))
    return T.fleet_lines(b, lines).select("corridor", "line", "headway")


def _segments(t):
    km = F.col("l_quantity") / 30
    return t.lineitem.select(F.col("l_linestatus").alias("zone"), km.alias("km"), T.shape_speed(km, F.col("l_returnflag") == "R").alias("kmh"))


SEGMENTS = """SELECT l_linestatus AS zone, l_quantity/30 AS km, (10.0+greatest(0.0,least(1.0,(l_quantity/30*1000-300.0)/700.0))*10.0)*CASE WHEN l_returnflag='R' THEN 0.7 ELSE 1 END AS kmh FROM lineitem"""


@query("segment_speeds", "F18", f"""
    SELECT zone, round(km,6) AS km, round(avg(kmh),6) AS kmh, round(avg(least(CASE WHEN c <= 5 THEN 20.0 WHEN c <= 12 THEN 24.0 WHEN c <= 25 THEN 32.0 ELSE 45.0 END, CASE WHEN c <= 12 THEN 1.0 WHEN c <= 25 THEN 1.1 ELSE 1.2 END
      * CASE WHEN km <= 0.4 THEN 14.0 WHEN km <= 1 THEN 20.0 WHEN km <= 2 THEN 28.0 WHEN km <= 4 THEN 34.0 ELSE 40.0 END)),6) AS other FROM (SELECT *, km*20 AS c FROM ({SEGMENTS})) GROUP BY zone, km""")
def _(t):
    s = _segments(t).withColumn("other", T.spacing_speed(F.col("km"), F.col("km") * 20))
    return s.groupBy("zone", "km").agg(r(F.avg("kmh")).alias("kmh"), r(F.avg("other")).alias("other")).withColumn("km", r(F.col("km")))


def _bisect(rounds=24):
    parts = [f"x AS ({SEGMENTS})", "k0 AS (SELECT zone, 0.1::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM x GROUP BY 1)"]
    for i in range(rounds):
        parts.append(f"k{i+1} AS (SELECT zone, CASE WHEN m < g THEN mid ELSE lo END AS lo, CASE WHEN m < g THEN hi ELSE mid END AS hi FROM (SELECT x.zone, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo+hi)/2) AS mid,"
                     f" sum(km)/sum(km/greatest(7.0,least(30.0,kmh*(lo+hi)/2))) AS m, CASE x.zone WHEN 'O' THEN 16.0 ELSE 21.0 END AS g FROM x JOIN k{i} ON x.zone = k{i}.zone GROUP BY x.zone))")
    return "WITH " + ", ".join(parts) + f" SELECT zone, round((lo+hi)/2,3) AS k FROM k{rounds}"


@query("speed_calibration", "T4", _bisect())
def _(t):
    return T.calibrate_speeds(_segments(t), {"O": 16.0, "F": 21.0}).select("zone", r(F.col("k"), 3).alias("k"))


def _city_windows(t):
    q = F.col("l_partkey")
    start = F.col("l_linenumber") * 7200
    rows = t.lineitem.groupBy(F.expr("l_partkey div 40").alias("city"), q.alias("route"), start.alias("start")).agg(F.min("l_quantity").alias("lq"), F.max("l_extendedprice").alias("lp"))
    km = (F.col("route") % 40).cast("double")
    return rows.select("city", "route", "start", (F.col("start") + 7200).alias("end"), (F.lit(300.0) + F.col("lq") * 30).alias("headway"), (F.lit(1200.0) + F.floor(F.col("lp") / 40)).alias("duration"),
                       T.step_table(km, T.CENTRE_TIERS).alias("weight"), F.lit(240.0).alias("least"), ((km <= 25) & (F.col("route") % 13 > 0)).alias("free"))


def _calibrated(rounds=8):
    base = """w AS (SELECT l_partkey//40 AS city, l_partkey AS route, l_linenumber*7200 AS start, l_linenumber*7200+7200 AS "end", 300.0+min(l_quantity)*30 AS headway, 1200.0+floor(max(l_extendedprice)/40) AS duration,
        CASE WHEN l_partkey%40 <= 3 THEN 0.55 WHEN l_partkey%40 <= 5 THEN 0.7 WHEN l_partkey%40 <= 12 THEN 1.0 ELSE 1.4 END::DOUBLE AS weight, (l_partkey%40 <= 25 AND l_partkey%13 > 0) AS free FROM lineitem GROUP BY 1,2,3,4,7,8),
      a AS (SELECT * FROM w WHERE start <= 30600 AND "end" > 30600), f AS (SELECT city, sum(CASE WHEN free THEN duration*1.15/(headway*weight) ELSE 0 END) AS base, sum(CASE WHEN free THEN 0 ELSE duration*1.15/headway END) AS fixed FROM a GROUP BY 1),
      k0 AS (SELECT city, greatest(80.0+city%10*10-fixed, 0.15*(80.0+city%10*10)) AS need, base/greatest(80.0+city%10*10-fixed, 0.15*(80.0+city%10*10)) AS k FROM f)"""
    parts = [base]
    for i in range(rounds):
        parts.append(f"k{i+1} AS (SELECT a.city, any_value(need) AS need, any_value(greatest(k,0.5))*sum(duration*1.15/least(greatest(headway*weight*greatest(k,0.5),240.0),5400.0))/any_value(need) AS k FROM a JOIN k{i} ON a.city = k{i}.city WHERE free GROUP BY a.city)")
    return "WITH " + ", ".join(parts) + f""" SELECT w.city, round(any_value(k),6) AS k, sum(round_even(CASE WHEN free THEN least(greatest(headway*weight*k,240.0),5400.0) ELSE headway END,0))::BIGINT AS headways, count(*) AS windows FROM w JOIN k{rounds} ON w.city = k{rounds}.city GROUP BY w.city"""


@query("headway_calibration", "T5 A47", _calibrated())
def _(t):
    w = _city_windows(t)
    fleets = w.select("city").distinct().withColumn("target", F.lit(80.0) + F.col("city") % 10 * 10)
    out = T.calibrate_headways(w, fleets)
    return out.groupBy("city").agg(r(F.max("k")).alias("k"), F.sum("new_headway").alias("headways"), F.count("*").alias("windows"))


@query("route_distance_medians", "A47", f"""
    SELECT route, round(median(km),4) AS km FROM (SELECT DISTINCT l_partkey AS route, l_suppkey, {sql_haversine('lon','lat','-90','37')} AS km FROM lineitem JOIN v_station ON l_suppkey = station) GROUP BY 1""")
def _(t):
    from stopfield.functions.geo import haversine_km
    from stopfield.operators.skew import median

    pairs = t.lineitem.select(F.col("l_partkey").alias("route"), F.col("l_suppkey").alias("station")).distinct().join(t.station.select("station", "lon", "lat"), "station")
    km = pairs.select("route", haversine_km(F.col("lon"), F.col("lat"), F.lit(-90.0), F.lit(37.0)).alias("km"))
    return median(km, ["route"], "km", "km").select("route", r(F.col("km"), 4).alias("km"))


@query("rural_headway_floors", "T5 F5", """
    SELECT o_orderkey, CASE WHEN km > 25 THEN greatest(h, CASE WHEN v THEN CASE WHEN p THEN 3600 ELSE 5400 END ELSE CASE WHEN p THEN 2400 ELSE 3600 END END) ELSE h END AS headway FROM (
      SELECT o_orderkey, (o_custkey%60)::DOUBLE AS km, (600+o_orderkey%5000)::DOUBLE AS h, o_custkey%3=0 AS v, (m >= 25200 AND m < 32400) OR (m >= 59400 AND m < 68400) AS p FROM (SELECT *, o_orderkey%24*3600+1800 AS m FROM orders))""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    peak = in_peak(k % 24 * 3600, k % 24 * 3600 + 3600)
    return t.orders.select("o_orderkey", T.rural_floor((F.lit(600) + k % 5000).cast("double"), (c % 60).cast("double"), peak, c % 3 == 0).alias("headway"))


@query("staggered_window_starts", "T6", """
    SELECT trip, least(start + floor(('0x' || substr(md5('0:' || (trip//40)::VARCHAR),1,13))::BIGINT::DOUBLE/4503599627370496.0*headway)::BIGINT, "end") AS start, "end" FROM v_frequency""")
def _(t):
    return T.stagger(t.frequency.withColumn("line", F.expr("trip div 40")), "line").select("trip", "start", "end")


@query("route_lines", "T8", """
    WITH s AS (SELECT o_custkey%8 AS feed, l_orderkey//30 AS shape, l_linenumber AS seq, (l_orderkey//30)%90 AS content FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1,2,3,4),
    l AS (SELECT feed, shape, count(*) AS points, string_agg(seq::VARCHAR || '/' || content::VARCHAR, ',' ORDER BY seq) AS mark FROM s GROUP BY 1,2 HAVING count(*) > 1),
    u AS (SELECT DISTINCT o_custkey%8 AS feed, o_custkey AS route, o_orderkey//30 AS shape FROM orders), d AS (SELECT feed, route, mark, min(shape) AS shape, any_value(points) AS points FROM u JOIN l USING (feed, shape) GROUP BY 1,2,3)
    SELECT feed, route, count(*) AS lines, sum(shape)::BIGINT AS shapes, sum(points)::BIGINT AS points FROM d GROUP BY 1,2""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 8).alias("feed"))
    s = t.lineitem.join(o, "l_orderkey").groupBy("feed", F.expr("l_orderkey div 30").alias("shape"), F.col("l_linenumber").alias("seq")).agg(F.lit(1).alias("_"))
    shapes = s.select("feed", "shape", "seq", (F.col("shape") % 90 / 10.0).alias("lon"), (F.col("shape") % 90 / 20.0).alias("lat"))
    trips = t.orders.select((F.col("o_custkey") % 8).alias("feed"), F.col("o_custkey").alias("route"), F.expr("o_orderkey div 30").alias("shape"))
    routes = trips.select("feed", "route").distinct()
    return T.route_lines(routes, trips, shapes).groupBy("feed", "route").agg(F.count("*").alias("lines"), F.sum("shape").alias("shapes"), F.sum("points").alias("points"))

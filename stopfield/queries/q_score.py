"""Queries on stop scores, cell scores and their uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions.curves import DEFAULT
from stopfield.operators import access as A
from stopfield.operators import score as K
from stopfield.operators import stats as S
from stopfield.operators.rollup import weighted_mean
from stopfield.queries.registry import query


def r(c, digits=6):
    return F.round(c, digits)


def _moded(rows):
    """Rows of routes with the route's mode; the distance of some routes is unknown."""
    mode = F.element_at(F.array(F.lit("bus"), F.lit("tram"), F.lit("rail")), (F.col("route") % 3 + 1).cast("int"))
    return rows.withColumn("mode", mode).withColumn("distance", F.when(F.col("route") % 11 > 0, F.col("distance")))


def _speeds(t):
    return _moded(t.route_service.groupBy("station", "route").agg(F.sum("distance").alias("distance"), F.sum("time").alias("time")))


def _items(t):
    return t.item


def _profiles(t):
    return K.pattern_slots(t.pattern, [F.col("h"), F.col("route"), F.col("direction")], 5)


def _values(t):
    return K.item_values(_items(t), _profiles(t))


SPEEDS = """SELECT station, route, ['bus','tram','rail'][(route%3+1)::INT] AS mode, CASE WHEN route%11 > 0 THEN sum(distance) END AS distance, sum(time) AS time FROM v_route_service GROUP BY 1,2"""
HEAD = "(CASE WHEN {h} <= 2 THEN 1.0 WHEN {h} <= 10 THEN 1.0+({h}-2)*(0.7-1.0)/8 WHEN {h} <= 30 THEN 0.7+({h}-10)*(0.3-0.7)/20 WHEN {h} <= 60 THEN 0.3+({h}-30)*(0.1-0.3)/30 ELSE 0.1 END)"
SPEED = "(CASE WHEN {v} <= 5 THEN 0.2 WHEN {v} <= 20 THEN 0.2+({v}-5)*(0.6-0.2)/15 WHEN {v} <= 50 THEN 0.6+({v}-20)*(1.0-0.6)/30 ELSE 1.0 END)"
MODE = "(CASE {m} WHEN 'bus' THEN 0.7 WHEN 'tram' THEN 0.85 ELSE 1.0 END)"


@query("combined_headways", "K1", """
    SELECT station, round(min(h), 6) AS headway FROM (SELECT station, direction, 1/sum(1/headway) AS h FROM v_route_service WHERE headway > 0 GROUP BY 1,2) GROUP BY 1""")
def _(t):
    return K.combined_headway(t.route_service, ["station"], "direction", "headway").select("station", r(F.col("headway")).alias("headway"))


@query("combined_speeds", "K2", f"""
    SELECT station, round((sum(distance)/1000)/(sum(time) FILTER (WHERE distance IS NOT NULL)/3600), 6) AS speed FROM ({SPEEDS}) GROUP BY 1""")
def _(t):
    return _speeds(t).groupBy("station").agg(r(K.combined_speed(F.col("distance"), F.col("time"))).alias("speed"))


@query("best_subset_scores", "K3 K4 P16", f"""
    WITH s AS (SELECT *, CASE WHEN distance IS NOT NULL THEN floor(((distance/1000.0)/(time/3600.0))/2)*2 END AS step FROM ({SPEEDS})),
    tr AS (SELECT s.*, ti, tier FROM s JOIN (VALUES (0,'bus',['bus','tram','rail']), (1,'tram',['tram','rail']), (2,'rail',['rail'])) k(ti, tier, ms) ON list_contains(ms, mode)),
    cu AS (SELECT DISTINCT station, ti, tier, step AS cutoff FROM tr WHERE step IS NOT NULL),
    kept AS (SELECT cu.station, cu.ti, cu.tier, cutoff, route, distance, time FROM cu JOIN tr ON cu.station = tr.station AND cu.ti = tr.ti AND (step IS NULL OR step >= cutoff)),
    sp AS (SELECT station, ti, tier, cutoff, (sum(distance)/1000)/(sum(time) FILTER (WHERE distance IS NOT NULL)/3600) AS speed FROM kept GROUP BY 1,2,3,4),
    hw AS (SELECT station, ti, cutoff, min(h) AS headway FROM (SELECT k.station, ti, cutoff, direction, 1/sum(1/headway) AS h FROM kept k JOIN v_route_service r ON r.station = k.station AND r.route = k.route GROUP BY 1,2,3,4) GROUP BY 1,2,3),
    sc AS (SELECT sp.*, headway, {MODE.format(m='tier')}*{HEAD.format(h='headway')}*{SPEED.format(v='speed')} AS score FROM sp JOIN hw USING (station, ti, cutoff)),
    b AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(score, 12) DESC, ti, cutoff) AS n FROM sc)
    SELECT b.station, b.tier, round(headway,6) AS headway, round(speed,6) AS speed, b.cutoff AS min_speed, round(score,6) AS score, count(*) AS routes FROM b JOIN kept k ON k.station = b.station AND k.ti = b.ti AND k.cutoff = b.cutoff
    WHERE n = 1 GROUP BY 1,2,3,4,5,6""")
def _(t):
    best = K.best_subset(_moded(t.route_service))
    return best.select("station", "tier", r(F.col("headway")).alias("headway"), r(F.col("speed")).alias("speed"), "min_speed", r(F.col("score")).alias("score"), F.size("route_ids").cast("long").alias("routes"))


@query("stop_scores_from_curves", "K4 U2", f"""
    SELECT station, route, direction, round(pow({MODE.format(m='mode')}, 0.5)*{HEAD.format(h='h')}*pow({SPEED.format(v='v')}, 2.0), 9) AS weighted, round({MODE.format(m='mode')}*{HEAD.format(h='h')}*{SPEED.format(v='v')}, 9) AS product FROM v_pattern""")
def _(t):
    m, h, v = F.col("mode"), F.col("h"), F.col("v")
    return t.pattern.select("station", "route", "direction", r(DEFAULT.with_(weights=(0.5, 1.0, 2.0)).stop_score(m, h, v), 9).alias("weighted"), r(DEFAULT.stop_score(m, h, v), 9).alias("product"))


@query("cell_items_with_patterns", "J32 W12", "SELECT cell, count(*) AS items, count(DISTINCT station) AS stations, round(sum(value), 6) AS value FROM v_scored_item GROUP BY 1")
def _(t):
    return _values(t).groupBy("cell").agg(F.count("*").alias("items"), F.count_distinct("station").alias("stations"), r(F.sum("value")).alias("value"))


@query("cell_level_of_service", "K5", """
    SELECT cell, round(100*max(value), 6) AS los, arg_max(station, row(value, -dist, -station, -slot)) AS station FROM v_scored_item GROUP BY 1""")
def _(t):
    return K.cell_scores(_values(t)).select("cell", r(F.col("los")).alias("los"), "station")


@query("cell_mode_sums", "K6 U1", "SELECT cell, mode, round(max(value),6) AS best, round(sum(value),6) AS sum, round(0.5*(sum(value)+max(value)),6) AS half_sum FROM v_scored_item GROUP BY 1,2")
def _(t):
    return K.mode_aggregates(_values(t)).select("cell", "mode", *[r(F.col(c)).alias(c) for c in ("best", "sum", "half_sum")])


MODES_SQL = """SELECT cell, county, population, jobs, max(value) AS "any", coalesce(max(value) FILTER (WHERE mode='bus'),0) AS bus, coalesce(max(value) FILTER (WHERE mode='tram'),0) AS tram,
    coalesce(max(value) FILTER (WHERE mode='rail'),0) AS rail FROM v_scored_item GROUP BY 1,2,3,4"""


@query("unit_access_by_mode", "K7 A39", f"""
    WITH c AS ({MODES_SQL}) SELECT county, round(sum(population*"any")/sum(population),6) AS "any", round(sum(population*bus)/sum(population),6) AS bus,
    round(sum(population*tram)/sum(population),6) AS tram, round(sum(population*rail)/sum(population),6) AS rail FROM c GROUP BY 1""")
def _(t):
    cells = K.mode_columns(_values(t), ["county", "population", "jobs"])
    out = K.unit_access(cells, "county", ["any", "bus", "tram", "rail"], "population")
    return out.select("county", *[r(F.col(c)).alias(c) for c in ("any", "bus", "tram", "rail")])


@query("unit_score_over_census", "A39", f"""
    WITH c AS (SELECT cell, county, population, 100*max(value) AS los FROM v_scored_item WHERE dist < 2000 GROUP BY 1,2,3), k AS (SELECT county, sum(population)*1.2 AS total FROM v_unit GROUP BY 1),
    s AS (SELECT county, sum(population*los) AS x FROM c GROUP BY 1) SELECT county, round(coalesce(x,0)/total,6) AS los FROM k LEFT JOIN s USING (county)""")
def _(t):
    cells = K.cell_scores(_values(t).filter("dist < 2000"), ["county", "population"])
    census = t.unit.groupBy("county").agg((F.sum("population") * 1.2).alias("total"))
    return K.unit_access(cells, "county", ["los"], "population", census).select("county", r(F.col("los")).alias("los"))


@query("destination_access", "K8 J23", """
    WITH c AS (SELECT cell, county, jobs, 100*max(value) AS los FROM v_scored_item GROUP BY 1,2,3), w AS (SELECT county AS w, sum(jobs*los)/sum(jobs) AS a FROM c GROUP BY 1)
    SELECT h, round(sum(n*a)/sum(n),6) AS destination FROM (SELECT h, w%25 AS w, sum(n) AS n FROM v_flow GROUP BY 1,2) JOIN w USING (w) GROUP BY 1""")
def _(t):
    cells = K.cell_scores(_values(t), ["county", "jobs"])
    flows = t.flow.groupBy("h", (F.col("w") % 25).cast("int").alias("w")).agg(F.sum("n").alias("n"))
    return K.destination_access(cells, flows, "county", "los").select("h", r(F.col("destination")).alias("destination"))


SCALED = """
    WITH c AS (SELECT cell, population, greatest(100*max(value)-3, 0) AS los FROM v_scored_item GROUP BY 1,2), q AS (SELECT los, sum(sum(population)) OVER (ORDER BY los) AS cum, sum(sum(population)) OVER () AS tot FROM c GROUP BY los),
    p AS (SELECT min(los) AS p FROM q WHERE cum >= 0.95*tot)"""


def _scaled(t):
    cells = K.cell_scores(_values(t), ["population"]).select("cell", "population", F.greatest(F.col("los") - 3, F.lit(0.0)).alias("los"))
    return K.scaled_scores(cells, "los", "population")


@query("scaled_scores", "K9 W5", SCALED + "SELECT cell, round(least(100*los/p, 100),6) AS scaled FROM c, p")
def _(t):
    return _scaled(t).select("cell", r(F.col("scaled")).alias("scaled"))


@query("scaled_score_summary", "K9", SCALED + "SELECT round(sum(least(100*los/p,100)*population)/sum(population),6) AS mean, round(sum(CASE WHEN los <= 0 THEN population ELSE 0 END)/sum(population),6) AS zero_share FROM c, p")
def _(t):
    return K.scaled_summary(_scaled(t), "los", "population").select(r(F.col("mean")).alias("mean"), r(F.col("zero_share")).alias("zero_share"))


SETS = {"default": DEFAULT, "mode_off": DEFAULT.with_(weights=(0.0, 1.0, 1.0)), "speed_off": DEFAULT.with_(weights=(1.0, 1.0, 0.0)), "headway_off": DEFAULT.with_(weights=(1.0, 0.0, 1.0)),
        "steep_walk": DEFAULT.with_(walk_power=3.0)}
_W = "pow(1 + dist/(CASE mode WHEN 'bus' THEN 500.0 WHEN 'tram' THEN 700.0 ELSE 900.0 END), {p})"
_SQL_SETS = {"default": "value", "mode_off": f"value/{MODE.format(m='mode')}", "speed_off": f"value/{SPEED.format(v='v')}", "headway_off": f"value/{HEAD.format(h='h')}",
             "steep_walk": f"value/{_W.format(p=-1.5)}*{_W.format(p=-3.0)}"}


@query("rescored_parameter_sets", "K12 A49", " UNION ALL ".join(f"SELECT cell, '{n}' AS \"set\", round(100*max({e}),6) AS los FROM v_scored_item GROUP BY 1" for n, e in _SQL_SETS.items()))
def _(t):
    return K.rescore(_items(t), _profiles(t), SETS).select("cell", "set", r(F.col("los")).alias("los"))


CAPS = [1, 2, 4, 8]
_CAP_SETS = ["default", "steep_walk"]
_CAP_FOLD = ", ".join(
    f"count(*) FILTER (WHERE {w}) AS n{t}, min(h) FILTER (WHERE {w}) AS h{t}, max(v) FILTER (WHERE {w}) AS v{t}, max(m) FILTER (WHERE {w}) AS m{t}, min(dist) FILTER (WHERE {w}) AS d{t}, count(DISTINCT m) FILTER (WHERE {w}) AS k{t}, max(s0) FILTER (WHERE {w}) AS s0{t}, max(s1) FILTER (WHERE {w}) AS s1{t}"
    for t, w in (("_all", "true"), ("", "k <= cap"))
)


@query("cell_cap_metrics", "A49", f"""
    WITH i AS (SELECT cell, station, min(dist) AS dist, min(h) AS h, max(v) AS v, max(CASE mode WHEN 'bus' THEN 0 WHEN 'tram' THEN 1 ELSE 2 END) AS m, max(100*{_SQL_SETS['default']}) AS s0, max(100*{_SQL_SETS['steep_walk']}) AS s1 FROM v_scored_item GROUP BY 1,2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dist, station) AS k FROM i), w AS (SELECT cap, cell, {_CAP_FOLD} FROM r, (SELECT unnest({CAPS}) AS cap) GROUP BY 1,2),
    x AS (SELECT *, n_all > n AS cut, s0_all - s0 AS l0, s1_all - s1 AS l1 FROM w)
    SELECT cap::INT AS cap, count(*) AS cells, round(avg(cut::INT),6) AS cut_share, round(coalesce(sum(n) FILTER (WHERE cut)/sum(n_all) FILTER (WHERE cut),1),6) AS stations_kept, round(sum(k)/sum(k_all),6) AS modes_kept,
      round(coalesce(avg((d <= greatest(1.15*d_all, d_all+50))::INT) FILTER (WHERE cut),1),6) AS nearest_close, round(coalesce(avg((h = h_all)::INT) FILTER (WHERE cut),1),6) AS headway_kept, round(coalesce(avg((h <= 1.15*h_all)::INT) FILTER (WHERE cut),1),6) AS headway_close,
      round(coalesce(avg((v = v_all)::INT) FILTER (WHERE cut),1),6) AS speed_kept, round(coalesce(avg((v >= 0.9*v_all)::INT) FILTER (WHERE cut),1),6) AS speed_close, round(coalesce(avg((m = m_all)::INT) FILTER (WHERE cut),1),6) AS best_mode_kept,
      round(avg(((l0 <= 0.01)::INT + (l1 <= 0.01)::INT)/2.0),6) AS winner_kept, round(avg(((l0 <= 1)::INT + (l1 <= 1)::INT)/2.0),6) AS within_one_point, round(avg((l0+l1)/2),6) AS mean_error FROM x GROUP BY 1""")
def _(t):
    out = A.cell_cap_metrics(t.item, _profiles(t), CAPS, {n: SETS[n] for n in _CAP_SETS}, ["bus", "tram", "rail"])
    return out.select("cap", "cells", *[r(F.col(c)).alias(c) for c in out.columns if c not in ("cap", "cells")])


FACTORS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def _demand(t):
    return K.predicted_at_factors(t.unit, F.col("population"), lambda f: F.lit(-3.0) + F.log1p(f * F.col("los") / 5), FACTORS)


DEMAND = " UNION ALL ".join(f"SELECT {f}::DOUBLE AS factor, sum(population/(1+exp(-(-3.0+ln(1+{f}*los/5)))))/max(w) AS demand FROM v_unit, (SELECT sum(population/(1+exp(-(-3.0+ln(1+los/5))))) AS w FROM v_unit)" for f in FACTORS)


@query("demand_at_factors", "K15", f"SELECT factor, round(demand,6) AS demand FROM ({DEMAND})")
def _(t):
    return _demand(t).withColumn("demand", r(F.col("demand")))


@query("loss_points", "K15 F19", f"""
    WITH d AS (SELECT 1-factor AS loss, demand FROM ({DEMAND})), w AS (SELECT *, lag(loss) OVER (ORDER BY loss) AS px, lag(demand) OVER (ORDER BY loss) AS py FROM d)
    SELECT l AS level, round((SELECT arg_min(CASE WHEN px IS NULL THEN loss ELSE px + (py-l)/(py-demand)*(loss-px) END, loss) FROM w WHERE demand <= l), 6) AS crossing FROM (VALUES (0.75::DOUBLE), (0.5::DOUBLE)) k(l)""")
def _(t):
    curve = _demand(t).withColumn("loss", 1 - F.col("factor"))
    parts = [K.first_crossing(curve, [], "loss", "demand", lv).select(F.lit(lv).alias("level"), r(F.col("crossing")).alias("crossing")) for lv in (0.75, 0.5)]
    return parts[0].unionByName(parts[1])


@query("station_catchments", "A38", """
    WITH w AS (SELECT cell, population, jobs, arg_max(station, row(value, -dist, -station, -slot)) AS station FROM v_scored_item GROUP BY 1,2,3)
    SELECT station, count(*) AS cells, sum(population) AS population, round(sum(jobs),5) AS jobs FROM w GROUP BY 1""")
def _(t):
    out = K.catchments(K.cell_scores(_values(t), ["population", "jobs"]), ["population", "jobs"])
    return out.select("station", "cells", "population", r(F.col("jobs"), 5).alias("jobs"))


CLASS = """
    b AS (SELECT cell, min(h) AS h FROM v_scored_item WHERE dist <= 400 GROUP BY 1),
    c AS (SELECT u.county*10 + u.id%10 AS unit, CASE WHEN h IS NULL THEN 0 WHEN h >= 60 THEN 1 WHEN h >= 30 THEN 2 WHEN h >= 15 THEN 3 ELSE 4 END AS class, sum(population) AS p FROM v_unit u LEFT JOIN b ON u.id = b.cell GROUP BY 1,2),
    k AS (SELECT unit, class FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p DESC, class) AS n FROM c) WHERE n = 1)"""


def _unit(t):
    return t.unit.select(F.col("id").alias("cell"), (F.col("county") * 10 + F.col("id") % 10).alias("unit"), "population", "dem", "los")


@query("service_class_of_units", "A40", f"WITH {CLASS} SELECT unit, class FROM k")
def _(t):
    return K.unit_classes(_values(t), _unit(t), "unit")


@query("calibration_by_class", "A43", f"""
    WITH {CLASS}, u AS (SELECT county*10+id%10 AS unit, sum(dem) AS y, sum(population) AS n, avg(los)/200 AS p FROM v_unit GROUP BY 1), j AS (SELECT * FROM u JOIN k USING (unit))
    SELECT class, round(sum(n)/(SELECT sum(n) FROM j),6) AS weight_share, round(sum(n*y/n)/sum(n),6) AS observed, round(sum(n*p)/sum(n),6) AS predicted, round(sum(n*(y>0)::INT)/sum(n),6) AS any_observed FROM j GROUP BY 1""")
def _(t):
    classes = K.unit_classes(_values(t), _unit(t), "unit")
    u = _unit(t).groupBy("unit").agg(F.sum("dem").alias("y"), F.sum("population").alias("n"), (F.avg("los") / 200).alias("p")).join(classes, "unit")
    out = K.calibration(u, "class", F.col("y"), F.col("n"), F.col("p"), F.col("n"))
    return out.select("class", *[r(F.col(c)).alias(c) for c in ("weight_share", "observed", "predicted", "any_observed")])


@query("score_table_agreement", "A48", """
    WITH a AS (SELECT cell, population, 100*max(value) AS los FROM v_scored_item GROUP BY 1,2), b AS (SELECT cell, 100*max(value) AS los FROM v_scored_item WHERE slot = 0 AND dist < 1500 GROUP BY 1)
    SELECT count(*) AS cells, round(avg((x=y)::INT),6) AS equal, round(avg((abs(x-y)<=10)::INT),6) AS close, round(avg(abs(x-y)),6) AS mean_difference, round(sum(x*population)/sum(population),6) AS mean_a,
      round(sum(y*population)/sum(population),6) AS mean_b, round(corr(x,y),6) AS correlation, count(*) FILTER (WHERE (x=0)<>(y=0)) AS zero_mismatches
    FROM (SELECT a.cell, population, coalesce(a.los,0) AS x, coalesce(b.los,0) AS y FROM a FULL JOIN b ON a.cell = b.cell)""")
def _(t):
    a = K.cell_scores(_values(t), ["population"])
    b = K.cell_scores(_values(t).filter("slot = 0 and dist < 1500"))
    out = K.agreement(a, b, "population")
    return out.select("cells", *[r(F.col(c)).alias(c) for c in ("equal", "close", "mean_difference", "mean_a", "mean_b", "correlation")], "zero_mismatches")


@query("pattern_cap_effect", "A49", """
    WITH s AS (SELECT station, count(*) AS n, min(h) AS h, max(v) AS v FROM v_pattern GROUP BY 1), k AS (SELECT station, min(h) AS kh, max(v) AS kv FROM v_profile GROUP BY 1)
    SELECT count(*) AS stations, round(avg((n>5)::INT),6) AS cut_share, sum(greatest(n-5,0))::BIGINT AS patterns_lost, round(avg((h=kh)::INT),6) AS best_headway_kept, round(avg((v=kv)::INT),6) AS best_speed_kept FROM s JOIN k USING (station)""")
def _(t):
    out = K.cap_effect(t.pattern, [F.col("h"), F.col("route"), F.col("direction")], 5)
    return out.select("stations", r(F.col("cut_share")).alias("cut_share"), "patterns_lost", r(F.col("best_headway_kept")).alias("best_headway_kept"), r(F.col("best_speed_kept")).alias("best_speed_kept"))


@query("tempered_weights", "I10", """
    WITH a AS (SELECT *, population*pow(sum(population) OVER (PARTITION BY county), -0.5) AS w0 FROM v_unit WHERE population > 0), b AS (SELECT *, w0/sum(w0) OVER () AS w1 FROM a),
    c AS (SELECT *, w1*pow(greatest(sum(w1) OVER (PARTITION BY segment), 1e-9), -0.5) AS w2 FROM b) SELECT id, round(w1,9) AS metro_weight, round(w2/sum(w2) OVER (),9) AS balanced_weight FROM c""")
def _(t):
    u = t.unit.filter("population > 0").select("id", "county", "segment", "population")
    a = K.level_weights(u, "county", "population", 0.5).select("id", r(F.col("w"), 9).alias("metro_weight"))
    b = K.level_weights(u, "county", "population", 0.5, by="segment").select("id", r(F.col("w"), 9).alias("balanced_weight"))
    return a.join(b, "id")


@query("score_fit_by_level", "A42 M6", """
    WITH b AS (SELECT 'bg' AS level, substr(geoid,1,12) AS code, los*population AS fp, population AS p, dem AS y FROM v_unit WHERE population > 0 UNION ALL SELECT 'tract', substr(geoid,1,11), los*population, population, dem FROM v_unit WHERE population > 0
      UNION ALL SELECT 'county', substr(geoid,1,5), los*population, population, dem FROM v_unit WHERE population > 0 UNION ALL SELECT 'score', CASE WHEN los <= 10 THEN '1' ELSE ceil(los/10)::INT::VARCHAR END, los*population, population, dem FROM v_unit WHERE population > 0),
    g AS (SELECT level, code, sum(fp)/sum(p) AS x, sum(y)/sum(p) AS y, sum(p) AS w FROM b GROUP BY 1,2),
    m AS (SELECT *, sum(w*x) OVER l/sum(w) OVER l AS mx, sum(w*y) OVER l/sum(w) OVER l AS my FROM g WINDOW l AS (PARTITION BY level))
    SELECT level, count(*) AS n, round(pow(sum(w*(x-mx)*(y-my)),2)/(sum(w*(x-mx)*(x-mx))*sum(w*(y-my)*(y-my))),6) AS r2 FROM m GROUP BY 1""")
def _(t):
    u = t.unit.filter("population > 0")
    bins = F.when(F.col("los") <= 10, "1").otherwise(F.ceil(F.col("los") / 10).cast("string"))
    levels = F.array(*[F.struct(F.lit(n).alias("level"), c.alias("code")) for n, c in (("bg", F.substring("geoid", 1, 12)), ("tract", F.substring("geoid", 1, 11)), ("county", F.substring("geoid", 1, 5)), ("score", bins))])
    rows = u.select((F.col("los") * F.col("population")).alias("fp"), F.col("population").alias("p"), F.col("dem").alias("d"), F.inline(levels))
    g = rows.groupBy("level", "code").agg((F.sum("fp") / F.sum("p")).alias("x"), (F.sum("d") / F.sum("p")).alias("y"), F.sum("p").alias("w"))
    return S.r2_by(g, ["level"], "x", "y", {"population": "w"}).select("level", F.col("n_population").alias("n"), r(F.col("r2_population")).alias("r2"))


CALLS = """SELECT user_id%40 AS station, event_id%2 AS direction, (extract('hour' FROM ts)*3600 + extract('minute' FROM ts)*60 + floor(extract('second' FROM ts)))::INT AS sec, ['bus','tram','rail'][(user_id%3+1)::INT] AS mode,
    CASE WHEN event_id%17 > 0 THEN 2000.0::DOUBLE + (event_id%50)*300 END AS distance, 1800.0::DOUBLE AS time FROM events"""


@query("best_subset_merged_directions", "K1 K3 W8", f"""
    WITH c AS (SELECT *, CASE WHEN distance IS NOT NULL THEN floor(distance/1000.0/(time/3600.0)/2)*2 END AS step FROM ({CALLS}) WHERE sec >= 21600 AND sec < 79200),
    s AS (SELECT station, direction, sec, mode, step, max(distance) AS d, max(CASE WHEN distance IS NOT NULL THEN time END) AS t FROM c GROUP BY 1,2,3,4,5),
    tr AS (SELECT s.*, ti, tier FROM s JOIN (VALUES (0,'bus',['bus','tram','rail']), (1,'tram',['tram','rail']), (2,'rail',['rail'])) k(ti, tier, ms) ON list_contains(ms, mode)),
    cu AS (SELECT DISTINCT station, ti, step AS cut FROM tr WHERE step IS NOT NULL), e AS (SELECT tr.station, tr.ti, tier, cut, direction, sec, sum(d) AS d, sum(t) AS t FROM tr JOIN cu ON tr.station = cu.station AND tr.ti = cu.ti AND (step IS NULL OR step >= cut) GROUP BY 1,2,3,4,5,6),
    sp AS (SELECT station, ti, tier, cut, (sum(d)/1000)/(sum(t)/3600) AS speed FROM e GROUP BY 1,2,3,4),
    g AS (SELECT *, (lead(sec) OVER (PARTITION BY station, ti, cut, direction ORDER BY sec)-sec)::DOUBLE AS gap FROM e),
    h AS (SELECT station, ti, cut, min(h) AS headway FROM (SELECT station, ti, cut, direction, (coalesce(sum(gap*gap),0)+pow(57600-(max(sec)-min(sec)),2))/57600/60 AS h FROM g GROUP BY 1,2,3,4) GROUP BY 1,2,3),
    sc AS (SELECT sp.*, headway, {MODE.format(m='tier')}*{HEAD.format(h='headway')}*{SPEED.format(v='speed')} AS score FROM sp JOIN h USING (station, ti, cut)),
    b AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(score,12) DESC, ti, cut) AS n FROM sc)
    SELECT station, tier, round(headway,6) AS headway, round(speed,6) AS speed, cut AS min_speed, round(score,6) AS score FROM b WHERE n = 1""")
def _(t):
    ts, k, u = F.col("ts"), F.col("event_id"), F.col("user_id")
    calls = t.events.select((u % 40).alias("station"), (k % 2).alias("direction"), (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("sec"),
                            F.element_at(F.array(F.lit("bus"), F.lit("tram"), F.lit("rail")), (u % 3 + 1).cast("int")).alias("mode"),
                            F.when(k % 17 > 0, F.lit(2000.0) + k % 50 * 300).alias("distance"), F.lit(1800.0).alias("time"))
    out = K.best_subset_merged(calls)
    return out.select("station", "tier", r(F.col("headway")).alias("headway"), r(F.col("speed")).alias("speed"), "min_speed", r(F.col("score")).alias("score"))


@query("feeds_to_station_scores", "K3 C5 T7 W1")
def _(t):
    from stopfield.plans.stop_scores import Feeds, scored_stops

    stops = t.station.select(F.col("station").alias("stop"), (F.col("station") % 60).alias("station"), "lon", "lat")
    modes = F.element_at(F.array(F.lit("bus"), F.lit("tram"), F.lit("rail")), (F.col("route") % 3 + 1).cast("int"))
    routes = t.trip.select("feed", "route").distinct().withColumn("mode", modes)
    feeds = Feeds(t.trip, t.stop_time, stops, routes, t.calendar, t.exception)
    out = scored_stops(feeds, "2024-01-10")
    return out.select("station", "tier", r(F.col("headway"), 4).alias("headway"), r(F.col("speed"), 4).alias("speed"), r(F.col("score")).alias("score"), F.size("route_ids").alias("routes"))

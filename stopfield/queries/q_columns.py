"""Queries on projections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import clock, geo, numeric, text
from stopfield.operators import columns as C
from stopfield.queries.registry import query
from stopfield.queries.views import sql_haversine, sql_plane


def r(c, digits=6):
    return F.round(c, digits)


@query("lenient_numbers", "P1 F15", """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number,
           CAST(NULL AS DOUBLE) AS absent FROM events""")
def _(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return e.select("event_id", *[numeric.as_number(c, e.columns).alias(n) for c, n in (("k", "k"), ("event_type", "not_a_number"), ("no_such", "absent"))])


@query("sentinels_to_null", "P2", "SELECT id, CASE WHEN income > 0 THEN income END AS income FROM v_place")
def _(t):
    return t.place.select("id", C.above(F.col("income"), 0).alias("income"))


SHARE_SPECS = [("democrat_share", "dem", "population"), ("republican_share", "rep", "population"), ("jobs_share", "jobs", "population")]


@query("count_shares", "P3", """
    SELECT id, round(greatest(0, least(100, CASE WHEN population > 0 THEN 100*dem/population END)), 6) AS democrat_share,
           round(greatest(0, least(100, CASE WHEN population > 0 THEN 100*rep/population END)), 6) AS republican_share,
           round(greatest(0, least(100, CASE WHEN population > 0 THEN 100*jobs/population END)), 6) AS jobs_share,
           CAST(NULL AS DOUBLE) AS absent_share
    FROM (SELECT * FROM v_unit WHERE population > 0)""")
def _(t):
    df = t.unit.filter("population > 0")
    out = C.shares(df, [*SHARE_SPECS, ("absent_share", "no_such", "population")], ["id"])
    return out.select("id", *[r(c).alias(c) for c in out.columns if c != "id"])


@query("intensive_positive", "P4", "SELECT id, CASE WHEN income > 0 THEN income END AS median_income, CASE WHEN los > 0 THEN los END AS access_index FROM v_place")
def _(t):
    return C.intensive(t.place, {"income": "median_income", "los": "access_index"}, ["id"])


@query("count_densities", "P5 G4", """
    SELECT cell, round(population/a, 6) AS population_density, round(jobs/a, 6) AS jobs_density, round(population/a*a, 6) AS population_back
    FROM (SELECT *, {area} AS a FROM v_fine_cell)""".replace("{area}", __import__("stopfield.queries.views", fromlist=["x"]).sql_area("cell", 12)))
def _(t):
    from stopfield.functions import grid

    a = grid.area_km2(F.col("cell"), 12)
    d = t.fine_cell.withColumn("a", a)
    density = numeric.ratio(F.col("population"), F.col("a"))
    return d.select("cell", r(density).alias("population_density"), r(numeric.ratio(F.col("jobs"), F.col("a"))).alias("jobs_density"), r(density * F.col("a")).alias("population_back"))


@query("bounded_ratios", "P6", """
    SELECT id, CASE WHEN v > 0 AND v < 180 THEN round(v, 9) END AS minutes, CASE WHEN population > 0 THEN round(jobs/population, 9) END AS jobs_per_resident
    FROM (SELECT *, CASE WHEN population > 0 THEN jobs/population END AS v FROM v_unit)""")
def _(t):
    v = numeric.ratio(F.col("jobs"), F.col("population"))
    return t.unit.select("id", r(C.bounded(v, 0, 180), 9).alias("minutes"), r(v, 9).alias("jobs_per_resident"))


@query("band_shares", "P7", """
    SELECT o_custkey, round(100.0*f/(f+o+p), 6) AS f_share, round(100.0*o/(f+o+p), 6) AS o_share, round(100.0*p/(f+o+p), 6) AS p_share FROM (
      SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus='F') AS f, count(*) FILTER (WHERE o_orderstatus='O') AS o,
             count(*) FILTER (WHERE o_orderstatus='P') AS p FROM orders GROUP BY 1)""")
def _(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s.upper()).alias(s)
    bands = t.orders.groupBy("o_custkey").agg(n("f"), n("o"), n("p"))
    out = C.band_shares(bands, ["f", "o", "p"], ["o_custkey"])
    return out.select("o_custkey", *[r(c).alias(c) for c in out.columns[1:]])


@query("covariate_logs", "P8", """
    SELECT id, round(ln(1+jobs), 6) AS log_jobs, CASE WHEN income > 0 THEN round(ln(income), 6) END AS log_income,
           CASE WHEN population > 0 THEN round(jobs/population, 9) END AS jobs_ratio FROM v_unit""")
def _(t):
    return t.unit.select(
        "id", r(F.log1p("jobs")).alias("log_jobs"), r(C.safe_log(F.col("income"))).alias("log_income"),
        r(numeric.finite(numeric.ratio(F.col("jobs"), F.col("population"))), 9).alias("jobs_ratio"))


PATTERNS = {"percent": r"_pct$", "share": r"(?i)share|_pct$", "positive": r"(?i)income|price"}


def _map_input(t):
    u = t.unit
    return u.select("id", (F.col("los") + 5).alias("los_pct"), (F.col("dem") / 10).alias("dem_share"), "income", F.lit(None).cast("double").alias("empty_price"))


@query("map_view_values", "P9", """
    SELECT id, greatest(0, least(1, (los+5)/100.0)) AS los_pct, greatest(0, least(1, dem/10)) AS dem_share, CASE WHEN income >= 0 THEN income END AS income,
           CAST(NULL AS DOUBLE) AS empty_price FROM v_unit""")
def _(t):
    return C.map_view(_map_input(t), **PATTERNS, protect=["id"])


@query("map_view_report", "P9", """
    SELECT 'los_pct' AS "column", count(*) FILTER (WHERE (los+5)/100.0 > 1) AS clipped, 0::BIGINT AS negative, false AS dropped FROM v_unit
    UNION ALL SELECT 'dem_share', count(*) FILTER (WHERE dem/10 > 1), 0, false FROM v_unit
    UNION ALL SELECT 'income', 0, count(*) FILTER (WHERE income < 0), false FROM v_unit
    UNION ALL SELECT 'empty_price', 0, 0, true""")
def _(t):
    return C.map_report(_map_input(t), **PATTERNS, protect=["id"])


@query("measure_rules", "P10 U3 Q5", """
    SELECT 'population' AS "column", 'sum' AS rule, count(population) AS "values" FROM v_fine_cell UNION ALL SELECT 'jobs', 'sum', count(jobs) FROM v_fine_cell
    UNION ALL SELECT 'income_median', 'mean', count(income_median) FROM v_fine_cell UNION ALL SELECT 'los', 'sum', count(los) FROM v_fine_cell""")
def _(t):
    return C.rules_table(t.fine_cell, skip=["cell", "county"])


@query("attach_prefixed", "P11 J1", """
    SELECT id, geoid, n_regionkey AS nat_n_regionkey, n_name AS nat_n_name FROM v_place LEFT JOIN nation ON substr(geoid,3,3)::INT = n_nationkey""")
def _(t):
    base = t.place.select("id", "geoid")
    return C.attach(base, t.nation, "n_nationkey", "nat_", on=F.substring("geoid", 3, 3).cast("int"))


@query("sources_merged", "J2", """
    WITH a AS (SELECT id, los AS score, income FROM v_place WHERE county < 15), b AS (SELECT id, population, jobs FROM v_unit WHERE county > 5)
    SELECT id, score, income, population, round(jobs,5) AS jobs FROM a FULL JOIN b USING (id)""")
def _(t):
    a = t.place.filter("county < 15").select("id", F.col("los").alias("score"), "income")
    b = t.unit.filter("county > 5").select("id", F.lit(-1.0).alias("income"), "population", r(F.col("jobs"), 5).alias("jobs"))
    return C.merge_sources([a, b], "id")


@query("latest_period_columns", "P12", """
    SELECT o_custkey AS id, count(*) FILTER (WHERE year(o_orderdate)=1996) AS rent_1996,
           count(*) FILTER (WHERE year(o_orderdate)=1997) AS elec_1997_share, count(*) AS total FROM orders GROUP BY 1""")
def _(t):
    y = lambda k: F.count_if(F.year("o_orderdate") == k)
    wide = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        y(1995).alias("rent_1995"), y(1996).alias("rent_1996"), y(1993).alias("elec_1993_share"), y(1997).alias("elec_1997_share"), F.count("*").alias("total"))
    return wide.select(*C.latest_period(wide.columns))


@query("activity_filter", "P13", "SELECT id, population, round(jobs, 5) AS jobs FROM v_unit WHERE population > 0 OR jobs > 0")
def _(t):
    return t.unit.filter(C.active(F.col("population"), F.col("jobs"))).select("id", "population", r(F.col("jobs"), 5).alias("jobs"))


@query("occupancy_filter", "P14", """
    SELECT cell, population FROM (SELECT *, {area} AS a FROM v_fine_cell)
    WHERE CASE WHEN county < 12 THEN (population + jobs)/a >= 10 ELSE population + jobs > 0 END"""
    .replace("{area}", __import__("stopfield.queries.views", fromlist=["x"]).sql_area("cell", 12)))
def _(t):
    from stopfield.functions import grid

    d = t.fine_cell.withColumn("a", grid.area_km2(F.col("cell"), 12))
    return d.filter(C.occupied(F.col("population") + F.col("jobs"), F.col("a"), F.col("county") < 12)).select("cell", "population")


@query("score_bins", "P15", """
    SELECT id, least(100.0, greatest(0.0, round_even(los/5.0, 0)*5.0)) AS snapped, ceil(los/10 - 1e-9)*10 AS tens FROM v_place""")
def _(t):
    return t.place.select("id", numeric.snap(F.col("los"), 5.0).alias("snapped"), numeric.ceil_tens(F.col("los")).cast("double").alias("tens"))


HEADWAY_XS, HEADWAY_YS = (2.0, 5.0, 10.0, 30.0, 60.0), (1.0, 0.8, 0.6, 0.25, 0.0)


@query("curve_lookup", "P16 U2", """
    SELECT station, route, direction, round(CASE WHEN h <= 2 THEN 1.0 WHEN h <= 5 THEN 1.0 + (h-2)*(0.8-1.0)/3 WHEN h <= 10 THEN 0.8 + (h-5)*(0.6-0.8)/5
        WHEN h <= 30 THEN 0.6 + (h-10)*(0.25-0.6)/20 WHEN h <= 60 THEN 0.25 + (h-30)*(0.0-0.25)/30 ELSE 0 END, 6) AS linear,
      round(CASE WHEN h <= 2 THEN 1.0 WHEN h <= 5 THEN 1.0 + (ln(h)-ln(2))*(0.8-1.0)/(ln(5)-ln(2)) WHEN h <= 10 THEN 0.8 + (ln(h)-ln(5))*(0.6-0.8)/(ln(10)-ln(5))
        WHEN h <= 30 THEN 0.6 + (ln(h)-ln(10))*(0.25-0.6)/(ln(30)-ln(10)) WHEN h <= 60 THEN 0.25 + (ln(h)-ln(30))*(0.0-0.25)/(ln(60)-ln(30)) ELSE 0 END, 6) AS log_axis
    FROM (SELECT *, headway AS h FROM v_route_service)""")
def _(t):
    h = F.col("headway")
    return t.route_service.select(
        "station", "route", "direction",
        r(numeric.interpolate(h, HEADWAY_XS, HEADWAY_YS)).alias("linear"), r(numeric.interpolate(h, HEADWAY_XS, HEADWAY_YS, log_axis=True)).alias("log_axis"))


@query("standardised_covariates", "P17", """
    WITH s AS (SELECT id, CASE WHEN income > 0 THEN income END AS income, jobs FROM v_unit),
    m AS (SELECT quantile_cont(income, 0.5) AS mi, quantile_cont(jobs, 0.5) AS mj FROM s),
    f AS (SELECT id, s.income, s.jobs, coalesce(income, mi) AS fi, coalesce(jobs, mj) AS fj, CASE WHEN income IS NULL THEN 1.0 ELSE 0.0 END AS xi FROM s, m),
    a AS (SELECT avg(fi) AS ai, stddev_samp(fi) AS si, avg(fj) AS aj, stddev_samp(fj) AS sj, avg(xi) AS ax FROM f)
    SELECT id, round((fi-ai)/si, 6) AS z_income, round(CASE WHEN ax > 0.002 THEN xi-ax ELSE 0 END, 6) AS m_income, round((fj-aj)/sj, 6) AS z_jobs, 0.0 AS m_jobs FROM f, a""")
def _(t):
    u = t.unit.select("id", C.above(F.col("income"), 0).alias("income"), "jobs")
    out = C.standardise(u, ["income", "jobs"])
    return out.select("id", *[r(c).alias(c) for c in ("z_income", "m_income", "z_jobs", "m_jobs")])


@query("winsorised_covariate", "P18", """
    WITH q AS (SELECT quantile_cont(jobs, 0.001) AS lo, quantile_cont(jobs, 0.999) AS hi FROM v_unit),
    c AS (SELECT id, greatest(lo, least(hi, jobs)) AS c FROM v_unit, q), a AS (SELECT avg(c) AS m, stddev_samp(c) AS s FROM c)
    SELECT id, round((c-m)/s, 6) AS w_jobs FROM c, a""")
def _(t):
    return C.winsorise(t.unit.select("id", "jobs"), "jobs").select("id", r(F.col("w_jobs")).alias("w_jobs"))


@query("valid_positions", "P19", """
    SELECT user_id, count(*) AS n FROM events WHERE abs(TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE)) > 0.01
      AND abs(TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE)) <= 90 AND abs(value) <= 180 GROUP BY 1""")
def _(t):
    e = t.events.filter(C.valid_position(F.col("value").cast("string"), F.get_json_object("props", "$.k")))
    return e.groupBy("user_id").agg(F.count("*").alias("n"))


@query("route_type_families", "P20", """
    WITH x AS (SELECT p_partkey, (p_partkey*13)%1500 AS t FROM part),
    k AS (SELECT p_partkey, t, (t BETWEEN 0 AND 2 OR t BETWEEN 5 AND 7 OR t BETWEEN 11 AND 12 OR t BETWEEN 100 AND 199 OR t BETWEEN 400 AND 499
                 OR t BETWEEN 900 AND 999 OR t BETWEEN 1300 AND 1399) AS rail,
            (t = 3 OR t = 11 OR t BETWEEN 200 AND 299 OR t BETWEEN 700 AND 899) AS bus, (t = 4 OR t BETWEEN 1000 AND 1099) AS ferry FROM x)
    SELECT p_partkey, concat_ws('/', CASE WHEN rail THEN 'rail' END, CASE WHEN bus THEN 'bus' END, CASE WHEN ferry THEN 'ferry' END) AS kinds,
           CASE WHEN t = 702 OR t IN (0, 5) OR t BETWEEN 900 AND 999 THEN 'tram' WHEN rail AND t <> 11 THEN 'rail' ELSE 'bus' END AS mode FROM k""")
def _(t):
    ty = (F.col("p_partkey") * 13 % 1500).cast("string")
    return t.part.select("p_partkey", F.array_join(C.route_kinds(ty), "/").alias("kinds"), C.route_mode(ty).alias("mode"))


CLASS_RULES = (("(?i)express|^red", "brt_like"), ("ring$", "loop"))
NUMBER_RANGES = ((900, 999, "community"), (200, 399, "town"))


@query("route_classes", "P21", """
    SELECT p_partkey, CASE WHEN regexp_matches(name, '(?i)express|^red') THEN 'brt_like' WHEN regexp_matches(name, 'ring$') THEN 'loop'
        WHEN n BETWEEN 900 AND 999 THEN 'community' WHEN n BETWEEN 200 AND 399 THEN 'town' ELSE 'ordinary' END AS class
    FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey%2=0 THEN ' ' || (p_partkey%1000)::VARCHAR ELSE '' END AS name, CASE WHEN p_partkey%2=0 THEN p_partkey%1000 END AS n FROM part)""")
def _(t):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), (F.col("p_partkey") % 1000).cast("string"))).otherwise(""))
    return t.part.select("p_partkey", C.route_class(name, CLASS_RULES, NUMBER_RANGES, "ordinary").alias("class"))


@query("code_levels", "P22", """
    SELECT id, substr(geoid,1,2) AS state_code, substr(geoid,1,5) AS county_code, substr(geoid,1,11) AS tract_code, substr(geoid,1,12) AS bg_code,
           CASE WHEN length(id::VARCHAR) >= 10 THEN id::VARCHAR ELSE lpad(id::VARCHAR, 10, '0') END AS padded FROM v_place""")
def _(t):
    g = F.col("geoid")
    return t.place.select("id", text.geoid_level(g, 2).alias("state_code"), text.geoid_level(g, 5).alias("county_code"), text.geoid_level(g, 11).alias("tract_code"),
                          text.geoid_level(g, 12).alias("bg_code"), text.pad_code(F.col("id"), 10).alias("padded"))


@query("vote_shares", "P23", """
    SELECT id, CASE WHEN ok THEN adults END AS eligible_voters, CASE WHEN tot > 0 THEN tot ELSE 7.0 END AS total_votes, round(CASE WHEN ok THEN dem/adults END, 6) AS democrat_share,
           round(CASE WHEN ok THEN rep/adults END, 6) AS republican_share, round(CASE WHEN ok THEN greatest(tot-dem-rep, 0)/adults END, 6) AS other_share,
           round(CASE WHEN ok THEN tot/adults END, 6) AS turnout_rate
    FROM (SELECT *, dem+rep AS tot, population-2 AS adults, dem+rep > 0 AND population-2 > 0 AS ok FROM v_unit)""")
def _(t):
    out = C.set_votes(t.unit.select("id", "dem", "rep", "population"), F.col("dem"), F.col("rep"), F.col("dem") + F.col("rep"), F.col("population") - 2,
                      old={"total_votes": F.lit(7.0)})
    shares = ["democrat_share", "republican_share", "other_share", "turnout_rate"]
    return out.select("id", "eligible_voters", "total_votes", *[r(c).alias(c) for c in shares])


@query("commute_helper_counts", "P24 P25", """
    WITH bg AS (SELECT substr(geoid,1,12) AS bg, avg(los) AS minutes, avg(income)/1000 AS km FROM v_unit GROUP BY 1),
    b AS (SELECT county, coalesce(population,0) AS commuters, coalesce(population*minutes,0) AS commuter_minutes, coalesce(population*km,0) AS commuter_km
          FROM v_unit LEFT JOIN bg ON substr(geoid,1,12) = bg)
    SELECT county, sum(commuters) AS commuters, CASE WHEN sum(commuters) > 0 THEN round(sum(commuter_minutes)/sum(commuters), 6) END AS mean_minutes,
           CASE WHEN sum(commuters) > 0 THEN round(1000*sum(commuter_km)/sum(commuters), 4) END AS mean_metres FROM b GROUP BY 1""")
def _(t):
    bg = t.unit.groupBy(F.substring("geoid", 1, 12).alias("bg")).agg(F.avg("los").alias("minutes"), (F.avg("income") / 1000).alias("km"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    b = t.unit.withColumn("bg", F.substring("geoid", 1, 12)).join(bg, "bg", "left").select(
        "county", zero(F.col("population")).alias("commuters"), zero(F.col("population") * F.col("minutes")).alias("commuter_minutes"),
        zero(F.col("population") * F.col("km")).alias("commuter_km"))
    sums = b.groupBy("county").agg(*[F.sum(c).alias(c) for c in ("commuters", "commuter_minutes", "commuter_km")])
    means = C.mean_of_sums([("mean_minutes", "commuter_minutes", "commuters", 1.0), ("mean_metres", "commuter_km", "commuters", 1000.0)])
    out = sums.select("county", "commuters", *means)
    return out.select("county", "commuters", r(F.col("mean_minutes")).alias("mean_minutes"), r(F.col("mean_metres"), 4).alias("mean_metres"))


@query("fit_outcomes", "P26", """
    SELECT id, population AS n, least(greatest(dem + rep, 0), population) AS y,
           round(ln((least(greatest(dem+rep,0),population)+0.5)/(population-least(greatest(dem+rep,0),population)+0.5)), 6) AS logit
    FROM v_unit WHERE population > 0""")
def _(t):
    out = C.outcome(t.unit, ["dem", "rep"], "population", "population")
    return out.select("id", "n", "y", r(F.col("logit")).alias("logit"))


@query("haversine_to_station", "F1", f"""
    SELECT h, w, round({sql_haversine('p.lon', 'p.lat', 's.lon', 's.lat')}, 4) AS km FROM v_flow JOIN v_place p ON h = id JOIN v_station s ON w = station""")
def _(t):
    f = t.flow.join(t.place.select(F.col("id").alias("h"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), "h").join(
        t.station.select(F.col("station").alias("w"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "w")
    return f.select("h", "w", r(geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 4).alias("km"))


@query("plane_metres_to_station", "F2", f"""
    SELECT h, w, round({sql_plane('p.lon', 'p.lat', 's.lon', 's.lat', '37.5')}, 3) AS metres FROM v_flow JOIN v_place p ON h = id JOIN v_station s ON w = station""")
def _(t):
    f = t.flow.join(t.place.select(F.col("id").alias("h"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), "h").join(
        t.station.select(F.col("station").alias("w"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "w")
    return f.select("h", "w", r(geo.plane_metres(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 37.5), 3).alias("metres"))


@query("clock_round_trip", "F3 F4 F5", """
    SELECT dep_id, lpad((s//3600)::VARCHAR,2,'0') || ':' || lpad(((s%3600)//60)::VARCHAR,2,'0') || ':' || lpad((s%60)::VARCHAR,2,'0') AS clock, s AS seconds,
           (s//3600)%24*60 + (s%3600)//60 AS minutes, (s >= 7*3600 AND s < 9*3600) OR (s >= 16.5*3600 AND s < 19*3600) AS peak
    FROM (SELECT dep_id, sec + CASE WHEN sec < 14400 THEN 86400 ELSE 0 END AS s FROM v_departure)""")
def _(t):
    s = F.col("sec") + F.when(F.col("sec") < 14400, 86400).otherwise(0)
    d = t.departure.select("dep_id", s.alias("s")).withColumn("clock", clock.text(F.col("s")))
    compact = F.concat(F.lpad((F.floor(F.col("s") / 3600) % 24).cast("string"), 2, "0"), F.substring(F.element_at(F.split("clock", ":"), 2), 1, 2))
    return d.select("dep_id", "clock", clock.seconds(F.col("clock")).alias("seconds"), clock.compact_minutes(compact).alias("minutes"), clock.in_peak(F.col("s"), F.col("s")).alias("peak"))


@query("text_time_spans", "F4", """
    WITH x AS (SELECT event_id, (event_id%24)*60 + event_id%60 AS a, ((event_id*7)%24)*60 + (event_id*11)%60 AS b FROM events)
    SELECT event_id, a AS start, CASE WHEN b <= a THEN b + 1440 ELSE b END AS "end" FROM x""")
def _(t):
    k = F.col("event_id")
    hm = lambda h, m: F.concat((h % 24).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    e = t.events.select("event_id", F.concat(F.lit("open "), hm(k, k), F.lit(" - "), hm(k * 7, k * 11), F.lit(" daily")).alias("note"))
    return e.select("event_id", F.inline(clock.spans(F.col("note"))))


@query("accent_free_keys", "F6 F9", """
    SELECT doc_id, trim(regexp_replace(translate(lower(substr(text,1,200)), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', ' ', 'g')) AS key,
      regexp_replace(regexp_replace(translate(lower(source || '/' || lang), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
    FROM documents""".replace("substr(text,1,200)", "text"))
def _(t):
    return t.documents.select("doc_id", text.name_key(F.col("text")).alias("key"), text.slug(F.concat_ws("/", "source", "lang")).alias("slug"))


@query("name_tokens", "F7 F8", """
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) > 1))), ' ') AS tokens,
           list_aggregate(list_transform(string_split(p_name, ' '), lambda w: w[1]), 'string_agg', '') AS acronym, true AS within
    FROM part""")
def _(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_join(F.array_sort(text.tokens(F.col("p_name"))), " ").alias("tokens"), text.acronym(words).alias("acronym"),
                         text.is_subsequence(text.acronym(words), F.col("p_name")).alias("within"))


@query("delimited_lists", "F10", """
    SELECT o_custkey, string_agg(o_orderstatus, ';' ORDER BY p) AS statuses FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS p FROM orders GROUP BY 1,2) GROUP BY 1""")
def _(t):
    # the first order of every status is kept, so a customer's list never holds more than the three statuses
    first = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("p"))
    lists = first.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "o_orderstatus"))), lambda x: x["o_orderstatus"]), " ; ").alias("s"))
    return lists.select("o_custkey", text.join_list(text.split_list(F.concat_ws(";", F.col("s"), F.col("s")))).alias("statuses"))


@query("link_functions", "F11", """
    SELECT id, round(1/(1+exp(-x)), 6) AS logistic, round(ln(1+exp(x)), 6) AS softplus, round(-ln(1+exp(-x)), 6) AS log_logistic, round(ln(p/(1-p)), 6) AS logit
    FROM (SELECT id, income/1000 AS x, (los+1)/103 AS p FROM v_place)""")
def _(t):
    x, p = F.col("income") / 1000, (F.col("los") + 1) / 103
    return t.place.select("id", r(numeric.logistic(x)).alias("logistic"), r(numeric.softplus(x)).alias("softplus"), r(numeric.log_logistic(x)).alias("log_logistic"), r(numeric.logit(p)).alias("logit"))


@query("edge_bins", "F12", """
    SELECT id, (los > 1e-7)::INT + (los > 10)::INT + (los > 20)::INT + (los > 30)::INT + (los > 40)::INT + (los > 50)::INT + (los > 60)::INT + (los > 70)::INT + (los > 80)::INT + (los > 90)::INT AS bin FROM v_place""")
def _(t):
    from stopfield.operators.stats import score_bin

    return t.place.select("id", score_bin(F.col("los")).alias("bin"))


@query("calendar_dates", "F14", """
    SELECT DISTINCT o_orderdate::DATE AS day, lower(dayname(o_orderdate)) AS weekday, CASE dayofweek(o_orderdate) WHEN 0 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END AS type FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(d.alias("day"), clock.weekday_name(d).alias("weekday"), clock.day_type(d).alias("type")).distinct()


@query("significant_rounding", "F16", """
    SELECT o_orderkey, round(o_totalprice/7, 2) AS two_decimals, CASE WHEN o_totalprice = 0 THEN 0.0
       ELSE round_even(o_totalprice*pow(10.0, 4-floor(log10(abs(o_totalprice)))), 0)/pow(10.0, 4-floor(log10(abs(o_totalprice)))) END AS five_digits FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", r(F.col("o_totalprice") / 7, 2).alias("two_decimals"), numeric.significant(F.col("o_totalprice"), 5).alias("five_digits"))

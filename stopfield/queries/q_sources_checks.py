"""Queries on text and JSON sources, sinks' tables, line positions and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopfield.functions import grid
from stopfield.operators import checks as Q
from stopfield.operators import lines as L
from stopfield.operators import rollup as R
from stopfield.operators import stats as S
from stopfield.operators.skew import first_row
from stopfield.queries.registry import query
from stopfield.queries.views import COARSE, FINE, sql_area, sql_cell, sql_centre, sql_col, sql_row
from stopfield.sources import readers as Rd
from stopfield.sources import sinks as Sk


def r(c, digits=6):
    return F.round(c, digits)


@query("feed_text_trimmed", "S1 S2", "SELECT c_custkey::VARCHAR AS stop_id, c_name AS stop_name, round(c_acctbal,2)::VARCHAR AS score FROM customer")
def _(t):
    raw = t.customer.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("﻿stop_id "), F.concat(F.col("c_name"), F.lit("  ")).alias(" stop_name"), F.col("c_acctbal").cast("string").alias("score"))
    from stopfield.operators.gtfs import trim_table

    return trim_table(raw)


@query("wanted_columns_that_exist", "S3 P1", "SELECT c_custkey AS id, c_acctbal AS income, CAST(NULL AS DOUBLE) AS rent FROM customer")
def _(t):
    df = Rd.parquet_columns(t.spark, f"{t.sf_dir}/customer.parquet", {"c_custkey": "long", "c_acctbal": "double", "rent": "double"})
    return df.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("income"), "rent")


@query("region_from_file_name", "S4", "SELECT 'customer.parquet' AS region, count(*) AS n FROM customer UNION ALL SELECT 'orders.parquet', count(*) FROM orders")
def _(t):
    files = [Rd.region_folders(t.spark, f"{t.sf_dir}/{n}.parquet", 0).select("region") for n in ("customer", "orders")]
    return files[0].unionByName(files[1]).groupBy("region").agg(F.count("*").alias("n"))


@query("census_answers_parsed", "S6", """
    SELECT lpad(c_nationkey::VARCHAR,2,'0') || lpad((c_custkey%1000)::VARCHAR,3,'0') AS "GEOID", max(CASE WHEN c_acctbal > 0 THEN round(c_acctbal,2) END) AS income, max(c_custkey)::DOUBLE AS people FROM customer GROUP BY 1""")
def _(t):
    row = F.to_json(F.array(
        F.array(*[F.lit(x) for x in ("income", "state", "people", "tract")]),
        F.array(F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", 2).cast("string")).otherwise("-666666666"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.col("c_custkey").cast("string"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))))
    return Rd.census_arrays(t.customer.select(row.alias("answer")), "answer", ["state", "tract"], ["income", "people"])


@query("log_factors_last_run", "S7 W3", """
    WITH k AS (SELECT lpad((o_custkey%100000)::VARCHAR,5,'0') AS county, CASE WHEN o_orderkey%2=0 THEN 'res' ELSE 'non' END AS "group", CASE WHEN o_orderkey%2=0 THEN 'population' ELSE 'jobsTotal' END AS anchor, o_orderkey AS o, o_orderkey+2000 AS total, 1000+o_orderkey%900 AS miss FROM orders)
    SELECT county, "group", anchor, total::DOUBLE AS total, (total-miss)::DOUBLE AS kept, round(1+(o%500)/1000.0::DOUBLE,3) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY county, "group" ORDER BY o DESC) AS n FROM k) WHERE n = 1""")
def _(t):
    k = F.col("o_orderkey")
    number = lambda c: F.format_number(c, 0)
    line = F.concat(F.lit("2026 [rescale] county "), F.lpad((F.col("o_custkey") % 100_000).cast("string"), 5, "0"), F.lit(" "), F.when(k % 2 == 0, "population").otherwise("jobsTotal"), F.lit(": "), number(1000 + k % 900),
                    F.lit(" of "), number(k + 2000), F.lit(" (1.5%) not on an active cell -- factor "), F.format_string("%.3f", 1 + k % 500 / 1000.0), F.lit(" on 3 columns"))
    logs = t.orders.select(k.alias("o"), line.alias("line"))
    return Rd.log_factors(logs, "line", [F.col("o")])


@query("html_lists_to_rows", "S8", """
    WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|sup)\\b.*?</(script|style|sup)>', '', 'g') AS h FROM pages),
    u AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1)) AS u FROM c), l AS (SELECT page_id, unnest(regexp_extract_all(u, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) AS l FROM u)
    SELECT page_id, string_agg(x, '|' ORDER BY x) AS cells FROM (SELECT page_id, trim(regexp_replace(regexp_replace(l, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS x FROM l) WHERE length(x) > 0 GROUP BY 1""")
def _(t):
    rows = Rd.html_rows(t.pages, "page_id", "html", "ul", "li")
    # a page's list items are the answer; they are ordered as text so that both engines agree
    return rows.groupBy("page_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("cells"))), "|").alias("cells"))


@query("metro_membership", "S9", """
    SELECT lpad(n_regionkey::VARCHAR,2,'0') || lpad(n_nationkey::VARCHAR,3,'0') AS code, n_name AS metro FROM nation WHERE n_nationkey%3 < 2""")
def _(t):
    k = F.col("n_nationkey")
    sheet = t.nation.select(F.when(k % 3 < 2, "Metropolitan").otherwise("Micropolitan").alias("kind"), F.col("n_name").alias("name"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("st"), F.lpad(k.cast("string"), 3, "0").alias("cty"))
    return Rd.metro_members(sheet, "kind", "name", ["st", "cty"])


@query("pixels_in_areas", "S10", """
    WITH p AS (SELECT o_orderkey, -100 + ((o_orderkey*13)%200)*0.1::DOUBLE + 0.05 AS lon, 30 + ((o_orderkey*7)%150)*0.1::DOUBLE + 0.05 AS lat, CASE WHEN o_orderkey%5 > 0 THEN o_totalprice ELSE 0 END AS value FROM orders)
    SELECT area, count(*) AS pixels, round(sum(value),2) AS value FROM p JOIN v_area ON lon >= west AND lon < east AND lat >= south AND lat < north WHERE value <> 0 GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey")
    pixels = t.orders.select((F.lit(-100) + k * 13 % 200 * 0.1 + 0.05).alias("lon"), (F.lit(30) + k * 7 % 150 * 0.1 + 0.05).alias("lat"), F.when(k % 5 > 0, F.col("o_totalprice")).otherwise(0.0).alias("value"))
    return Rd.mask_pixels(pixels, t.area, "area", 8).groupBy("area").agg(F.count("*").alias("pixels"), r(F.sum("value"), 2).alias("value"))


@query("column_chunks_round_trip", "S13", "SELECT county, id, round(los,2) AS los, CASE WHEN income > 0 THEN round(income,2) END AS income FROM v_place")
def _(t):
    rows = t.place.select("county", "id", "los", F.when(F.col("income") > 0, F.col("income")).otherwise(F.lit(float("nan"))).alias("income"))
    chunks = Sk.column_chunks(rows, "county", "id", chunk_rows=40)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("los", T.DoubleType()), T.StructField("income", T.DoubleType())])
    return Sk.read_chunks(chunks.select("county", "chunk"), "chunk", schema)


_CX, _CY = sql_centre("cell", FINE)


@query("population_squares", "S14", f"SELECT floor({_CY})::BIGINT::VARCHAR || '_' || floor({_CX})::BIGINT::VARCHAR AS chunk, count(*) AS cells FROM v_fine_cell WHERE population > 0 GROUP BY 1")
def _(t):
    c = t.fine_cell.select("cell", "population", "los", grid.centre_lon(F.col("cell"), FINE).alias("lon"), grid.centre_lat(F.col("cell"), FINE).alias("lat"))
    return Sk.square_index(Sk.population_squares(c, 1.0))


@query("region_index_entries", "S15", """
    WITH m AS (SELECT state, county::VARCHAR AS id, sum(population)::BIGINT AS pop FROM v_unit GROUP BY 1,2), v AS (SELECT n_nationkey::VARCHAR AS id, n_nationkey*10.4 AS km FROM nation),
    e AS (SELECT state, '{"name":"' || n_name || '","id":"' || m.id || '","pop":' || pop::VARCHAR || ',"vkm":' || round(km)::BIGINT::VARCHAR || '}' AS e, n_name, m.id FROM m JOIN v ON m.id = v.id JOIN nation ON n_nationkey = m.id::INT),
    t AS (SELECT state, count(*) AS n, sum(population)::BIGINT AS pop FROM v_unit GROUP BY 1)
    SELECT state, '{"key":' || state::VARCHAR || ',"county":[' || string_agg(e, ',' ORDER BY n_name, id) || '],"n":' || any_value(n)::VARCHAR || ',"pop":' || any_value(pop)::VARCHAR || '}' AS entry FROM e JOIN t USING (state) GROUP BY 1""")
def _(t):
    names = t.nation.select(F.lit("county").alias("level"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    km = t.nation.select(F.lit("county").alias("level"), F.col("n_nationkey").cast("string").alias("id"), (F.col("n_nationkey") * 10.4).alias("km"))
    return Sk.region_index(t.unit, "state", {"county": "county"}, names, km)


def _along_lines() -> str:
    """Vectors of points and pieces as in the operator; the stops follow one another, so each has its own step."""
    vector = "cos(radians(lat))*cos(radians(lon)) AS {0}x, cos(radians(lat))*sin(radians(lon)) AS {0}y, sin(radians(lat)) AS {0}z"
    dot = lambda a, b: f"({a}x*{b}x + {a}y*{b}y + {a}z*{b}z)"
    parts = [
        """p AS (SELECT p_partkey AS route, unnest(range(5)) AS piece, unnest([0.0, 0.1, 0.2, 0.1, 0.3]::DOUBLE[]) + p_partkey%7*0.01::DOUBLE - 90.0 AS lon,
           35.0 + unnest([0.0, p_partkey%5*0.01::DOUBLE, p_partkey%3*0.02::DOUBLE, p_partkey%5*0.01::DOUBLE + 0.03, p_partkey%4*0.01::DOUBLE]) AS lat FROM part)""",
        f"v AS (SELECT route, piece, {vector.format('a')} FROM p)",
        "w AS (SELECT *, lead(ax) OVER o - ax AS wx, lead(ay) OVER o - ay AS wy, lead(az) OVER o - az AS wz FROM v WINDOW o AS (PARTITION BY route ORDER BY piece))",
        f"l AS (SELECT *, {dot('w', 'w')} AS size, 2*6371.0*asin(least(sqrt({dot('w', 'w')})/2, 1)) AS long FROM w WHERE wx IS NOT NULL)",
        "m AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY route ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS km FROM l)",
        "q AS (SELECT p_partkey AS route, unnest(range(5)) AS nth, -90.0 + p_partkey%7*0.01::DOUBLE + unnest(range(5))*0.06::DOUBLE AS lon, 35.0 + p_partkey%3*0.01::DOUBLE AS lat FROM part)",
        f"s AS (SELECT route, nth, {vector.format('p')} FROM q)",
        "t AS (SELECT *, px-ax AS tx, py-ay AS ty, pz-az AS tz FROM m JOIN s USING (route))",
        f"u AS (SELECT *, CASE WHEN size > 0 THEN {dot('t', 'w')}/size ELSE 0 END AS share FROM t)",
        f"r AS (SELECT route, nth, piece, km, km+long AS stop, km+share*long AS foot, greatest(({dot('t', 't')} - share*share*size)*(6371.0*6371.0), 0) AS off FROM u)",
        "k0 AS (SELECT DISTINCT route, 0.0::DOUBLE AS spot, []::DOUBLE[] AS list FROM r)",
    ]
    for i in range(5):
        parts.append(f"""c{i} AS (SELECT r.route, greatest(least(foot, stop), km, spot) AS here, round(off + pow(greatest(least(foot, stop), km, spot) - foot, 2), 9) AS d
            FROM r JOIN k{i} USING (route) WHERE nth = {i} AND stop >= spot)""")
        parts.append(f"""k{i+1} AS (SELECT route, coalesce(n.spot, k{i}.spot) AS spot, list_append(list, coalesce(n.spot, k{i}.spot)) AS list
            FROM k{i} LEFT JOIN (SELECT route, arg_min(here, row(d, here)) AS spot FROM c{i} GROUP BY 1) n USING (route))""")
    parts.append("g AS (SELECT *, greatest(least(foot, stop), km) AS held, sqrt(off + pow(greatest(least(foot, stop), km) - foot, 2)) AS gap FROM r)")
    parts.append("h AS (SELECT *, min(gap) OVER (PARTITION BY route, nth) AS least_gap FROM g)")
    parts.append("a AS (SELECT route, bool_or(gap <= least_gap + 0.0111195 AND abs(held - list[nth+1]) > 0.1) AS ambiguous FROM h JOIN k5 USING (route) GROUP BY 1)")
    return "WITH " + ", ".join(parts) + " SELECT route, array_to_string(list_transform(list, lambda x: round(x, 3)::VARCHAR), ',') AS km, ambiguous FROM k5 JOIN a USING (route)"


@query("stops_along_lines", "G9 G10", _along_lines())
def _(t):
    k = F.col("p_partkey")
    pt = lambda x, y: F.struct((F.lit(-90.0) + x).alias("lon"), (F.lit(35.0) + y).alias("lat"))
    line = F.array(pt(k % 7 * 0.01, k * 0), pt(k % 7 * 0.01 + 0.1, k % 5 * 0.01), pt(k % 7 * 0.01 + 0.2, k % 3 * 0.02), pt(k % 7 * 0.01 + 0.1, k % 5 * 0.01 + 0.03), pt(k % 7 * 0.01 + 0.3, k % 4 * 0.01))
    stops = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.alias("stop"), (F.lit(-90.0) + k % 7 * 0.01 + i * 0.06).alias("lon"), (F.lit(35.0) + k % 3 * 0.01).alias("lat")))
    rows = t.part.select(k.alias("route"), line.alias("line"), stops.alias("stops"))
    out = L.stop_positions(rows)
    return out.select("route", F.array_join(F.transform("km", lambda v: F.round(v, 3).cast("string")), ",").alias("km"), "ambiguous")


def _levels(t):
    c = t.fine_cell.withColumn("income_median", F.col("income_median"))
    rules = {"population": "sum", "jobs": "sum"}
    fine = c.select("cell", "los", "population", "jobs")
    return {FINE: fine, COARSE: R.roll_to_parent(c, FINE, COARSE, rules), 6: R.roll_to_parent(c.filter("county <> 7"), FINE, 6, rules)}


@query("level_totals_agree", "Q1", f"""
    WITH t AS (SELECT {FINE} AS res, sum(population) AS population, sum(jobs) AS jobs FROM v_fine_cell UNION ALL SELECT {COARSE}, sum(population), sum(jobs) FROM v_fine_cell
      UNION ALL SELECT 6, sum(population), sum(jobs) FROM v_fine_cell WHERE county <> 7),
    k AS (SELECT res, unnest(['population', 'jobs']) AS a, unnest([population, jobs]) AS v FROM t), f AS (SELECT a, v AS finest FROM k WHERE res = {FINE})
    SELECT res, a || ' differs from the finest level' AS problem FROM k JOIN f USING (a) WHERE finest <> 0 AND abs(v - finest) > 0.002*abs(finest) + 1
    UNION ALL SELECT {FINE}, count(*)::VARCHAR || ' cells without score' FROM v_fine_cell WHERE los IS NULL HAVING count(*) > 0
    UNION ALL SELECT {FINE}, 'score outside 0-100' FROM v_fine_cell WHERE los < 0 OR los > 100 HAVING count(*) > 0""")
def _(t):
    return Q.level_problems(_levels(t), ["population", "jobs"])


@query("estimates_match_census", "Q2", """
    WITH s AS (SELECT sum(population) AS census, sum(population*1.001) AS a, sum(population*1.1) AS b FROM v_unit), k AS (SELECT census, unnest(['a', 'b']) AS c, unnest([a, b]) AS v FROM s)
    SELECT c AS "column", 'total differs from the census' AS problem FROM k WHERE abs(v - census) > 0.002*census
    UNION ALL SELECT 'c', 'missing' WHERE 'c' NOT IN (SELECT c FROM k)""")
def _(t):
    df = t.unit.select(F.col("population").alias("census"), (F.col("population") * 1.001).alias("a"), (F.col("population") * 1.1).alias("b"))
    return Q.estimate_problems(df, "census", ["a", "b"], ["c"])


@query("vote_totals_against_reference", "Q3", """
    WITH r AS (SELECT county, sum(dem) AS s FROM v_unit GROUP BY 1), p AS (SELECT county, sum(CASE WHEN id%200 = 0 THEN 0 ELSE dem END) AS s FROM v_unit GROUP BY 1)
    SELECT county, round(greatest(0, abs(p.s/r.s-1)/10),9) AS worst, abs(p.s/r.s-1)/10 < 0.001 AS ok FROM r JOIN p USING (county)""")
def _(t):
    u = t.unit.select("county", "id", "dem")
    levels = {"state": u, "cells": u.withColumn("dem", F.when(F.col("id") % 200 == 0, 0.0).otherwise(F.col("dem")))}
    reference = u.groupBy("county").agg(F.sum("dem").alias("reference"))
    return Q.vote_check(levels, "county", "dem", reference, loose=["cells"]).withColumn("worst", r(F.col("worst"), 9))


@query("shares_in_range", "Q4", "SELECT 'los_share' AS \"column\", count(*) AS rows FROM v_place WHERE los/90 > 1 UNION ALL SELECT 'income', count(*) FROM v_place WHERE income < 0")
def _(t):
    df = t.place.select((F.col("los") / 90).alias("los_share"), (F.col("los") / 200).alias("half_share"), "income")
    return Q.share_problems(df, ["los_share", "half_share"], ["income"])


@query("underserved_patches", "Q7 A53", f"""
    WITH RECURSIVE c AS (SELECT {sql_cell('lon', 'lat', 9)} AS cell, sum(population) AS population, max(los) AS los FROM v_unit GROUP BY 1),
    p AS (SELECT cell, {sql_row('cell')} AS y, {sql_col('cell')} AS x, population FROM c WHERE population >= 10 AND coalesce(los, 0) <= 80),
    r AS (SELECT cell, x, y, cell AS label FROM p UNION SELECT p.cell, p.x, p.y, r.label FROM r JOIN p ON abs(r.x-p.x) + abs(r.y-p.y) = 1 WHERE r.label < p.cell)
    SELECT label, count(*) AS cells, sum(population) AS population FROM (SELECT cell, min(label) AS label FROM r GROUP BY 1) JOIN p USING (cell) GROUP BY 1 HAVING sum(population) >= 30""")
def _(t):
    c = t.unit.withColumn("cell", grid.cell(F.col("lon"), F.col("lat"), 9)).groupBy("cell").agg(F.sum("population").alias("population"), F.max("los").alias("los"))
    c = c.withColumn("density", F.col("population"))
    return Q.underserved_patches(c, 9, 10.0, 80.0, 30.0)


FLAGGED = f"""
    b AS (SELECT {sql_cell('lon', 'lat', 9)} AS cell, county, sum(population) AS population, max(los) AS los FROM v_unit GROUP BY 1,2), d AS (SELECT *, population/{sql_area('cell', 9)}*1000 AS density FROM b),
    f AS (SELECT county, slope, intercept, sqrt(greatest(syy-slope*sxy,0)/n) AS std FROM (SELECT county, count(*) AS n, regr_slope(los, ln(density)) AS slope, regr_intercept(los, ln(density)) AS intercept, regr_syy(los, ln(density)) AS syy, regr_sxy(los, ln(density)) AS sxy
       FROM d WHERE density > 0 AND los > 0 GROUP BY 1) WHERE n >= 4),
    e AS (SELECT d.*, CASE WHEN density > 0 AND los-(slope*ln(density)+intercept) > std THEN 'more_housing' WHEN density > 10 AND los-(slope*ln(density)+intercept) < -std THEN 'more_transit' END AS flag FROM d LEFT JOIN f USING (county))"""


def _flagged(t):
    c = t.unit.withColumn("cell", grid.cell(F.col("lon"), F.col("lat"), 9)).groupBy("cell", "county").agg(F.sum("population").alias("population"), F.max("los").alias("los"))
    c = c.withColumn("density", F.col("population") / grid.area_km2(F.col("cell"), 9) * 1000)
    return S.equity_flag(c, S.density_fit(c, ["county"], "density", "los"), ["county"], "density", "los", gate=10.0)


@query("development_overlay", "A52 K10", f"""
    WITH {FLAGGED} SELECT cell, county, flag FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY population DESC, county) AS n FROM e WHERE flag IS NOT NULL) WHERE n = 1""")
def _(t):
    rows = _flagged(t).filter(F.col("flag").isNotNull())
    return first_row(rows, ["cell"], [-F.col("population"), F.col("county")], ["county", "flag"])


@query("flagged_share_and_fit_per_city", "A50 A20", f"""
    WITH {FLAGGED}, m AS (SELECT *, sum(population*density) OVER c/sum(population) OVER c AS mx, sum(population*los) OVER c/sum(population) OVER c AS my FROM e WINDOW c AS (PARTITION BY county))
    SELECT county, round(coalesce(count(*) FILTER (WHERE flag='more_transit')::DOUBLE/nullif(count(flag),0),0),6) AS more_transit, round(pow(sum(population*(density-mx)*(los-my)),2)/(sum(population*pow(density-mx,2))*sum(population*pow(los-my,2))),6) AS r2 FROM m GROUP BY 1""")
def _(t):
    f = _flagged(t)
    n = F.count("flag")
    shares = f.groupBy("county").agg(r(F.coalesce(F.count_if(F.col("flag") == "more_transit") / F.when(n > 0, n), F.lit(0.0))).alias("more_transit"))
    fit = S.regression(f, ["county"], "density", "los", "population").select("county", r(F.col("r2")).alias("r2"))
    return shares.join(fit, "county")


@query("coarse_grid_from_edges", "A13 J13 J3", f"""
    WITH s AS (SELECT DISTINCT {sql_cell('x1', 'y1', FINE)} AS cell FROM v_edge WHERE los > 50), c AS (SELECT cell, population, {_CX} AS lon, {_CY} AS lat, cell IN (SELECT cell FROM s) AS street FROM v_fine_cell),
    m AS (SELECT d.cell, arg_min(k.cell, row(sqrt(pow((d.lon-k.lon)*{grid.METRES_PER_DEGREE!r}::DOUBLE*cos(radians(37.5)),2)+pow((d.lat-k.lat)*{grid.METRES_PER_DEGREE!r}::DOUBLE,2)), k.cell)) AS recipient FROM c d JOIN c k ON NOT d.street AND d.population > 0 AND k.street
      AND sqrt(pow((d.lon-k.lon)*{grid.METRES_PER_DEGREE!r}::DOUBLE*cos(radians(37.5)),2)+pow((d.lat-k.lat)*{grid.METRES_PER_DEGREE!r}::DOUBLE,2)) <= 40000 GROUP BY 1),
    g AS (SELECT recipient AS cell, sum(population) AS g FROM m JOIN c USING (cell) GROUP BY 1) SELECT c.cell, population + coalesce(g,0) AS population FROM c LEFT JOIN g ON c.cell = g.cell WHERE street""")
def _(t):
    from stopfield.plans.street_grid import move_roadless

    street = t.edge.filter("los > 50").select(grid.cell(F.col("x1"), F.col("y1"), FINE).alias("cell")).distinct()
    return move_roadless(t.fine_cell.select("cell", "population"), street, ["population"], FINE, 40_000.0)



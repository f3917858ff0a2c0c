"""Queries on apportioning, rescaling, raking and redistributing."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators import apportion as A
from stopfield.queries.registry import query
from stopfield.queries.views import COARSE, FINE, sql_area, sql_parent


def r(c, digits=6):
    return F.round(c, digits)


@query("apportion_by_population", "A9 J24", """
    WITH b AS (SELECT id, substr(geoid,1,12) AS bg, CASE WHEN county < 5 THEN 0 ELSE population END AS w FROM v_unit),
    s AS (SELECT substr(geoid,1,12) AS bg, sum(income) AS amount, avg(los) AS share FROM v_unit WHERE county <> 24 GROUP BY 1)
    SELECT id, round(amount * coalesce(w/nullif(sum(w) OVER (PARTITION BY bg),0), 1.0/count(*) OVER (PARTITION BY bg)), 7) AS amount, round(share, 6) AS share
    FROM b LEFT JOIN s USING (bg)""")
def _(t):
    b = t.unit.select("id", F.substring("geoid", 1, 12).alias("bg"), F.when(F.col("county") < 5, 0.0).otherwise(F.col("population")).alias("w"))
    s = t.unit.filter("county <> 24").groupBy(F.substring("geoid", 1, 12).alias("bg")).agg(F.sum("income").alias("amount"), F.avg("los").alias("share"))
    return A.apportion(b, s, "bg", "w", ["amount"], ["share"]).select("id", r(F.col("amount"), 7).alias("amount"), r(F.col("share")).alias("share"))


@query("dasymetric_split", "A10", f"""
    WITH pairs AS (SELECT county AS polygon, cell, CASE WHEN county%3=0 THEN 0 ELSE population END AS home, CASE WHEN county%3 < 2 THEN 0 ELSE jobs END AS other FROM v_fine_cell),
    poly AS (SELECT c_nationkey AS polygon, count(*) AS residents, sum(c_acctbal) AS work FROM customer GROUP BY 1),
    x AS (SELECT cell, residents, work, home, other, sum(home) OVER p AS th, sum(other) OVER p AS tot, sum(home+other) OVER p AS ta, count(*) OVER p AS n FROM pairs JOIN poly USING (polygon) WINDOW p AS (PARTITION BY polygon)),
    y AS (SELECT cell, residents*coalesce(home/nullif(th,0), (home+other)/nullif(ta,0), 1.0/n) AS residents, work*coalesce(other/nullif(tot,0), (home+other)/nullif(ta,0), 1.0/n) AS work FROM x
          UNION ALL SELECT cell, 3.0, 2.0 FROM v_fine_cell WHERE county = 1)
    SELECT cell, round(sum(residents), 6) AS residents, round(sum(work), 7) AS work FROM y GROUP BY 1""")
def _(t):
    c = F.col("county")
    cells = t.fine_cell.select(c.alias("polygon"), "cell", F.when(c % 3 == 0, 0.0).otherwise(F.col("population")).alias("home"), F.when(c % 3 < 2, 0.0).otherwise(F.col("jobs")).alias("other"))
    poly = t.customer.groupBy(F.col("c_nationkey").alias("polygon")).agg(F.count("*").cast("double").alias("residents"), F.sum("c_acctbal").alias("work"))
    lone = t.fine_cell.filter("county = 1").select("cell", F.lit(3.0).alias("residents"), F.lit(2.0).alias("work"))
    out = A.dasymetric(cells.join(poly, "polygon"), {"residents": "home", "work": "other"}, ["home", "other"], lone)
    return out.select("cell", r(F.col("residents")).alias("residents"), r(F.col("work"), 7).alias("work"))


@query("floor_area_by_use", "A11", f"""
    SELECT c_nationkey AS cell, round(sum(CASE WHEN c_mktsegment IN ('HOUSEHOLD','BUILDING') THEN c_acctbal ELSE 0 END), 2) AS home_area,
           round(sum(CASE WHEN c_mktsegment IN ('HOUSEHOLD','BUILDING') THEN 0 ELSE c_acctbal END), 2) AS other_area FROM customer GROUP BY 1""")
def _(t):
    out = A.floor_area(t.customer.withColumnRenamed("c_nationkey", "cell"), "cell", "c_mktsegment", "c_acctbal", ("HOUSEHOLD", "BUILDING"))
    return out.select("cell", r(F.col("home_area"), 2).alias("home_area"), r(F.col("other_area"), 2).alias("other_area"))


KEEP_SQL = f"(population + jobs)/{sql_area('cell', FINE)} >= 12"


def _keep():
    return (F.col("population") + F.col("jobs")) / grid.area_km2(F.col("cell"), FINE) >= 12


@query("rescale_factors", "A12", f"""
    SELECT 'people' AS "group", round(sum(population), 3) AS total, round(sum(CASE WHEN {KEEP_SQL} THEN population ELSE 0 END), 3) AS kept,
      round(sum(population)/sum(CASE WHEN {KEEP_SQL} THEN population ELSE 0 END), 6) AS factor, 1-sum(CASE WHEN {KEEP_SQL} THEN population ELSE 0 END)/sum(population) > 0.05 AS warning FROM v_fine_cell
    UNION ALL SELECT 'work', round(sum(jobs), 3), round(sum(CASE WHEN {KEEP_SQL} THEN jobs ELSE 0 END), 3),
      round(sum(jobs)/sum(CASE WHEN {KEEP_SQL} THEN jobs ELSE 0 END), 6), 1-sum(CASE WHEN {KEEP_SQL} THEN jobs ELSE 0 END)/sum(jobs) > 0.05 FROM v_fine_cell""")
def _(t):
    out = A.rescale_factors(t.fine_cell, _keep(), {"people": "population", "work": "jobs"})
    return out.select("group", *[r(F.col(c), d).alias(c) for c, d in (("total", 3), ("kept", 3), ("factor", 6))], "warning")


@query("rescale_kept_cells", "A12 Q6", f"""
    WITH f AS (SELECT sum(population)/sum(CASE WHEN {KEEP_SQL} THEN population ELSE 0 END) AS fp, sum(jobs)/sum(CASE WHEN {KEEP_SQL} THEN jobs ELSE 0 END) AS fj FROM v_fine_cell)
    SELECT cell, round(population*fp, 6) AS population, round(jobs*fj, 6) AS jobs FROM v_fine_cell, f WHERE {KEEP_SQL}""")
def _(t):
    out = A.rescale(t.fine_cell, _keep(), {"people": ("population", ["population"]), "work": ("jobs", ["jobs"])})
    return out.select("cell", r(F.col("population")).alias("population"), r(F.col("jobs")).alias("jobs"))


@query("rake_to_controls", "A14", """
    WITH w AS (SELECT county, sum(CASE WHEN id%4 > 0 THEN dem ELSE 0 END) AS hd, sum(CASE WHEN id%4 > 0 THEN rep ELSE 0 END) AS hr, sum(dem) AS wd, sum(rep) AS wr FROM v_unit GROUP BY 1),
    s AS (SELECT id, u.county, CASE WHEN id%4 > 0 THEN dem ELSE 0 END * greatest(1, least(1.3, coalesce(wd/nullif(hd,0),1))) AS dem,
                 CASE WHEN id%4 > 0 THEN rep ELSE 0 END * greatest(1, least(1.3, coalesce(wr/nullif(hr,0),1))) AS rep FROM v_unit u JOIN w USING (county)),
    g AS (SELECT sum(dem) AS gd, sum(rep) AS gr FROM s), c AS (SELECT sum(wd) AS cd, sum(wr) AS cr FROM w)
    SELECT id, round(dem*cd/gd, 6) AS dem, round(rep*cr/gr, 6) AS rep FROM s, g, c""")
def _(t):
    part = t.unit.select("id", "county", *[F.when(F.col("id") % 4 > 0, F.col(c)).otherwise(0.0).alias(c) for c in ("dem", "rep")])
    control = t.unit.groupBy("county").agg(F.sum("dem").alias("dem"), F.sum("rep").alias("rep"))
    out = A.rake(part, control, "county", ["dem", "rep"], 1.0, 1.3)
    return out.select("id", r(F.col("dem")).alias("dem"), r(F.col("rep")).alias("rep"))


@query("keep_layer_total", "A14", """
    WITH f AS (SELECT sum(population) AS want, sum(CASE WHEN county < 20 THEN population END) AS have FROM v_fine_cell)
    SELECT cell, round(population*want/have, 6) AS population FROM v_fine_cell, f WHERE county < 20""")
def _(t):
    part = t.fine_cell.filter("county < 20").select("cell", "population")
    return A.keep_total(part, t.fine_cell, ["population"]).select("cell", r(F.col("population")).alias("population"))


@query("redistribute_to_recipients", "A13", f"""
    WITH d AS (SELECT cell, population FROM v_fine_cell WHERE county = 3), p AS (SELECT {sql_parent('cell', FINE, COARSE)} AS up, min(cell) AS recipient FROM v_fine_cell WHERE county <> 3 GROUP BY 1),
    m AS (SELECT cell AS donor, recipient FROM d JOIN p ON {sql_parent('cell', FINE, COARSE)} = up),
    g AS (SELECT recipient AS cell, sum(population) AS g FROM m JOIN d ON donor = d.cell GROUP BY 1)
    SELECT cell, population + coalesce(g, 0) AS population FROM v_fine_cell LEFT JOIN g USING (cell) WHERE cell NOT IN (SELECT donor FROM m)""")
def _(t):
    up = grid.parent(F.col("cell"), FINE, COARSE).alias("up")
    c = t.fine_cell.select("cell", "population", "county", up)
    takers = c.filter("county <> 3").groupBy("up").agg(F.min("cell").alias("recipient"))
    moves = c.filter("county = 3").select(F.col("cell").alias("donor"), "up").join(takers, "up").select("donor", "recipient")
    return A.redistribute(c.select("cell", "population"), moves, ["population"])


@query("redistribution_conserves", "A13 Q6", """
    SELECT 'population' AS amount, sum(population) AS before, sum(population) AS after, true AS ok FROM v_fine_cell""")
def _(t):
    up = grid.parent(F.col("cell"), FINE, COARSE).alias("up")
    c = t.fine_cell.select("cell", "population", "county", up)
    takers = c.filter("county <> 3").groupBy("up").agg(F.min("cell").alias("recipient"))
    moves = c.filter("county = 3").select(F.col("cell").alias("donor"), "up").join(takers, "up").select("donor", "recipient")
    cells = c.select("cell", "population")
    return A.conservation(cells, A.redistribute(cells, moves, ["population"]), ["population"])

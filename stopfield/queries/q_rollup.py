"""Queries on roll-ups: grid parents, hierarchies, memberships, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators import rollup as R
from stopfield.operators.columns import measure_rules
from stopfield.queries.registry import query
from stopfield.queries.views import COARSE, FINE, sql_parent


def r(c, digits=6):
    return F.round(c, digits)


RULES = {"population": "sum", "jobs": "sum", "income_median": "mean"}
LOS = ("coalesce(sum(coalesce(los,0)*population)/nullif(sum(population),0), sum(coalesce(los,0)*jobs)/nullif(sum(jobs),0), avg(coalesce(los,0)))")
MEAN = "sum(income_median*population)/nullif(sum(CASE WHEN income_median IS NOT NULL THEN population END),0)"


def rounded(df, keys):
    """Rounded columns. Means of cents can lie halfway between two roundings, where the order of a sum decides; the nudge takes them off it."""
    digits = {"population": 3, "jobs": 5}
    return df.select(*keys, *[r(F.col(c) if c in digits else F.col(c) + 1e-9, digits.get(c, 6)).alias(c) for c in df.columns if c not in keys])


@query("rollup_to_parent", "A1 A2 G1 G2", f"""
    SELECT {sql_parent('cell', FINE, COARSE)} AS cell, round({LOS} + 1e-9, 6) AS los, round(sum(population), 3) AS population, round(sum(jobs), 5) AS jobs,
           round({MEAN} + 1e-9, 6) AS income_median FROM v_fine_cell GROUP BY 1""")
def _(t):
    return rounded(R.roll_to_parent(t.fine_cell, FINE, COARSE, RULES), ["cell"])


@query("rollup_all_levels", "A1 A5 J25", " UNION ALL ".join(
    f"SELECT {to} AS res, {sql_parent('cell', FINE, to)} AS cell, round({LOS} + 1e-9, 6) AS los, round(sum(population), 3) AS population, round(sum(jobs), 5) AS jobs,"
    f" round({MEAN} + 1e-9, 6) AS income_median FROM v_fine_cell GROUP BY 2" for to in (10, 8, 6)))
def _(t):
    return rounded(R.roll_levels(t.fine_cell, FINE, [10, 8, 6], RULES), ["res", "cell"])


@query("los_three_tiers", "A2", """
    SELECT county, round(coalesce(sum(los*p)/nullif(sum(p),0), sum(los*j)/nullif(sum(j),0), avg(los)), 6) AS los
    FROM (SELECT county, los, CASE WHEN county % 3 = 0 THEN population ELSE 0 END AS p, CASE WHEN county % 3 < 2 THEN jobs ELSE 0 END AS j FROM v_unit) GROUP BY 1""")
def _(t):
    c = F.col("county") % 3
    p, j = F.when(c == 0, F.col("population")).otherwise(0.0), F.when(c < 2, F.col("jobs")).otherwise(0.0)
    return t.unit.groupBy("county").agg(r(R.los_mean(F.col("los"), p, j)).alias("los"))


@query("coarse_los_from_children", "A3", f"""
    WITH c AS (SELECT {sql_parent('cell', FINE, 9)} AS cell, sum(coalesce(los,0)*population) AS lp, sum(population) AS p, avg(coalesce(los,0)) AS m
               FROM v_fine_cell GROUP BY 1),
    k AS (SELECT {sql_parent('cell', FINE, 9)} AS cell, sum(population)*1.5 AS population FROM v_fine_cell GROUP BY 1)
    SELECT cell, k.population, round(coalesce(lp/nullif(greatest(k.population, coalesce(p,0)),0), m, 0), 6) AS los FROM k LEFT JOIN c USING (cell)""")
def _(t):
    coarse = t.fine_cell.groupBy(grid.parent(F.col("cell"), FINE, 9).alias("cell")).agg((F.sum("population") * 1.5).alias("population"))
    out = R.coarse_from_children(t.fine_cell, coarse, FINE, 9)
    return out.select("cell", "population", r(F.col("los")).alias("los"))


@query("dissolve_hierarchy", "A5 A26", """
    SELECT state, county, segment, CASE WHEN state IS NULL THEN 0 WHEN county IS NULL THEN 1 WHEN segment IS NULL THEN 2 ELSE 3 END AS level, count(*) AS members,
           round(sum(population), 3) AS population, round(sum(jobs), 5) AS jobs, round(sum(los*population)/nullif(sum(population),0), 6) AS los_mean
    FROM v_unit GROUP BY ROLLUP (state, county, segment)""")
def _(t):
    u = t.unit.withColumn("los_mean", F.col("los"))
    out = R.dissolve(u, ["state", "county", "segment"], {"population": "sum", "jobs": "sum", "los_mean": "mean"})
    return out.select("state", "county", "segment", "level", "members", r(F.col("population"), 3).alias("population"), r(F.col("jobs"), 5).alias("jobs"), r(F.col("los_mean")).alias("los_mean"))


@query("null_aware_means", "A6", """
    SELECT state, county, round(sum(v*population)/nullif(sum(CASE WHEN v IS NOT NULL THEN population END),0), 6) AS v, round(sum(CASE WHEN v > 90 THEN v END), 3) AS some
    FROM (SELECT *, CASE WHEN los >= 20 THEN los END AS v FROM v_unit) GROUP BY ROLLUP (state, county)""")
def _(t):
    v = F.when(F.col("los") >= 20, F.col("los"))
    return t.unit.withColumn("v", v).rollup("state", "county").agg(
        r(R.weighted_mean(F.col("v"), F.col("population"))).alias("v"), r(F.sum(F.when(F.col("v") > 90, F.col("v"))), 3).alias("some"))


@query("commute_means_two_weights", "A7", """
    WITH x AS (SELECT substr(geoid,1,11) AS tract, sum(los*population)/nullif(sum(CASE WHEN los IS NOT NULL THEN population END),0) AS t,
        sum(income/1000*jobs)/nullif(sum(CASE WHEN income IS NOT NULL THEN jobs END),0) AS km FROM v_unit GROUP BY 1),
    e AS (SELECT substr(geoid,1,11) AS tract, max(los) AS exact FROM v_unit GROUP BY 1)
    SELECT tract, round(coalesce(CASE WHEN exact BETWEEN 20 AND 90 THEN exact END, t), 6) AS minutes, round(km/nullif(coalesce(CASE WHEN exact BETWEEN 20 AND 90 THEN exact END, t),0), 6) AS speed
    FROM x JOIN e USING (tract)""")
def _(t):
    u = t.unit.withColumn("tract", F.substring("geoid", 1, 11)).withColumn("km", F.col("income") / 1000)
    means = u.groupBy("tract").agg(R.weighted_mean(F.col("los"), F.col("population")).alias("t"), R.weighted_mean(F.col("km"), F.col("jobs")).alias("km"), F.max("los").alias("exact"))
    minutes = F.coalesce(F.when(F.col("exact").between(20, 90), F.col("exact")), F.col("t"))
    return means.select("tract", r(minutes).alias("minutes"), r(F.col("km") / F.when(minutes != 0, minutes)).alias("speed"))


@query("split_units_over_districts", "A8 W4", """
    WITH p AS (SELECT substr(geoid,1,12) AS unit, id%40 AS district, sum(population) AS pop, count(*) AS n FROM v_unit GROUP BY 1,2),
    w AS (SELECT unit, district, coalesce(pop/nullif(sum(pop) OVER (PARTITION BY unit),0), n/sum(n) OVER (PARTITION BY unit)) AS frac FROM p),
    u AS (SELECT substr(geoid,1,12) AS unit, sum(population) AS population, avg(income) AS income_mean, sum(jobs) AS jobs FROM v_unit GROUP BY 1)
    SELECT district, round(sum(population*frac), 3) AS population, round(sum(jobs*frac), 5) AS jobs,
           round(coalesce(sum(income_mean*population*frac)/nullif(sum(population*frac),0),0), 6) AS income_mean FROM w JOIN u USING (unit) GROUP BY 1""")
def _(t):
    u = t.unit.withColumn("unit", F.substring("geoid", 1, 12))
    parts = u.groupBy("unit", (F.col("id") % 40).alias("district")).agg(F.sum("population").alias("pop"), F.count("*").alias("n"))
    units = u.groupBy("unit").agg(F.sum("population").alias("population"), F.avg("income").alias("income_mean"), F.sum("jobs").alias("jobs"))
    out = R.roll_split(units, parts, {"population": "sum", "jobs": "sum", "income_mean": "mean"})
    return out.select("district", r(F.col("population"), 3).alias("population"), r(F.col("jobs"), 5).alias("jobs"), r(F.col("income_mean")).alias("income_mean"))


@query("state_row_without_votes", "A17", """
    SELECT round(sum(population), 3) AS population, round(sum(jobs), 5) AS jobs, round(coalesce(sum(los_mean*population)/nullif(sum(population),0),0), 6) AS los_mean
    FROM (SELECT county, sum(population) AS population, sum(jobs) AS jobs, avg(los) AS los_mean FROM v_unit GROUP BY 1)""")
def _(t):
    counties = t.unit.groupBy("county").agg(F.sum("population").alias("population"), F.sum("jobs").alias("jobs"), F.avg("los").alias("los_mean"), F.sum("dem").alias("2024_president_votes"))
    out = R.state_row(counties, measure_rules(counties, skip=["county"]), r"^\d{4}_")
    return out.select(r(F.col("population"), 3).alias("population"), r(F.col("jobs"), 5).alias("jobs"), r(F.col("los_mean")).alias("los_mean"))


@query("votes_by_code_prefix", "A15 O8", " UNION ALL ".join(
    f"SELECT '{n}' AS level, substr(geoid,1,{k}) AS code, sum(dem) AS dem, sum(rep) AS rep FROM v_unit GROUP BY 2" for n, k in (("bg", 12), ("tract", 11), ("county", 5), ("state", 2))))
def _(t):
    return R.prefix_levels(t.unit, "geoid", {"bg": 12, "tract": 11, "county": 5, "state": 2}, ["dem", "rep"])


@query("votes_to_cells_and_back", "A15", f"""
    WITH c AS (SELECT {sql_parent('cell', FINE, COARSE)} AS parent, cell, population FROM v_fine_cell),
    v AS (SELECT parent, sum(population) AS votes FROM c GROUP BY 1)
    SELECT cell, round(votes * coalesce(q/nullif(sum(q) OVER (PARTITION BY parent),0), 1.0/count(*) OVER (PARTITION BY parent)), 6) AS votes
    FROM (SELECT *, CASE WHEN cell % 3 = 0 THEN 0 ELSE population END AS q FROM c) JOIN v USING (parent)""")
def _(t):
    from stopfield.operators.apportion import apportion

    c = t.fine_cell.select("cell", grid.parent(F.col("cell"), FINE, COARSE).alias("parent"), F.when(F.col("cell") % 3 == 0, 0.0).otherwise(F.col("population")).alias("q"), "population")
    votes = c.groupBy("parent").agg(F.sum("population").alias("votes"))
    return apportion(c.select("cell", "parent", "q"), votes, "parent", "q", ["votes"]).select("cell", r(F.col("votes")).alias("votes"))


PARTY = "CASE o_orderstatus WHEN 'F' THEN 'DEMOCRAT' WHEN 'O' THEN 'republican' ELSE 'Green' END"


@query("party_totals", "A16", f"""
    SELECT o_custkey, total_votes, round(d/total_votes, 6) AS democrat_share, round(rp/total_votes, 6) AS republican_share, round(greatest(1.0-d/total_votes-rp/total_votes,0), 6) AS other_share FROM (
    SELECT o_custkey, sum(v)::DOUBLE AS total_votes, sum(CASE WHEN lower(party)='democrat' THEN v ELSE 0 END) AS d, sum(CASE WHEN lower(party)='republican' THEN v ELSE 0 END) AS rp
    FROM (SELECT o_custkey, {PARTY} AS party, o_orderkey%17 AS v FROM orders) GROUP BY 1) WHERE total_votes > 0""")
def _(t):
    s = F.col("o_orderstatus")
    party = F.when(s == "F", "DEMOCRAT").when(s == "O", "republican").otherwise("Green")
    rows = t.orders.select("o_custkey", party.alias("party"), (F.col("o_orderkey") % 17).cast("string").alias("votes"))
    out = R.party_totals(rows, ["o_custkey"], "party", "votes")
    return out.select("o_custkey", "total_votes", *[r(c).alias(c) for c in ("democrat_share", "republican_share", "other_share")])


@query("border_duplicates_merged", "O8 A18", f"""
    WITH two AS (SELECT * FROM v_fine_cell UNION ALL SELECT * FROM v_fine_cell WHERE county % 4 = 0)
    SELECT cell, round({LOS} + 1e-9, 6) AS los, round(sum(population), 3) AS population, round(sum(jobs), 5) AS jobs, round({MEAN} + 1e-9, 6) AS income_median FROM two GROUP BY 1""")
def _(t):
    two = t.fine_cell.unionByName(t.fine_cell.filter("county % 4 = 0"))
    return rounded(R.roll_to_parent(two, FINE, FINE, RULES), ["cell"])


@query("metro_regrouping", "A54 S9 A28", """
    WITH m AS (SELECT n_nationkey AS county, 'Metro ' || (n_nationkey%6)::VARCHAR AS metro FROM nation WHERE n_nationkey%6 <> 5)
    SELECT metro, count(*) AS units, round(sum(population), 3) AS population, round(coalesce(sum(los*population)/nullif(sum(population),0), sum(los*jobs)/nullif(sum(jobs),0), avg(los)), 6) AS los
    FROM v_unit JOIN m USING (county) GROUP BY 1""")
def _(t):
    names = t.nation.select(F.col("n_nationkey").alias("county"), F.concat(F.when(F.col("n_nationkey") % 6 == 5, "Micro ").otherwise("Metro "), (F.col("n_nationkey") % 6).cast("string")).alias("metro"))
    members = names.filter(F.col("metro").startswith("Metro"))
    return t.unit.join(members, "county").groupBy("metro").agg(
        F.count("*").alias("units"), r(F.sum("population"), 3).alias("population"), r(R.los_mean(F.col("los"), F.col("population"), F.col("jobs"))).alias("los"))

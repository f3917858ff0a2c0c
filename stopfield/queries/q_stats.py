"""Queries on statistics: regressions, splits, flags, distributions, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators import rollup as R
from stopfield.operators import stats as S
from stopfield.operators.skew import exact_quantiles
from stopfield.queries.registry import query
from stopfield.queries.views import FINE, sql_area, sql_parent


def r(c, digits=6):
    return F.round(c, digits)


def rounded(df, keys, digits=6):
    return df.select(*keys, *[r(F.col(c), digits).alias(c) if t in ("double",) else F.col(c) for c, t in df.dtypes if c not in keys])


# two-sided p-value of Student's t by Simpson's rule over the angle atan(t / sqrt(dof)); an independent route to the expression in Spark
def t_pvalue(t: str, v: str, steps: int = 2000) -> str:
    h = f"(atan(abs({t})/sqrt({v}))/{steps})"
    fold = (f"list_sum(list_transform(range(0,{steps}+1), lambda k: (CASE WHEN k=0 OR k={steps} THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)*pow(cos(k*{h}), {v}-1)))")
    return f"greatest(0.0, 1 - 2*exp(lgamma(({v}+1)/2)-lgamma({v}/2))/sqrt(pi())*{fold}*{h}/3)"


REGRESSION = """
    SELECT county, slope, intercept, r2, n, {p} AS p_value FROM (
      SELECT *, slope/sqrt(res/(n-2)/sxx) AS t FROM (
        SELECT county, n, sxy/sxx AS slope, my-sxy/sxx*mx AS intercept, 1-(syy-sxy*sxy/sxx)/syy AS r2, syy-sxy*sxy/sxx AS res, sxx FROM (
          SELECT county, count(*) AS n, max(mx) AS mx, max(my) AS my, sum(w*(x-mx)*(x-mx)) AS sxx, sum(w*(x-mx)*(y-my)) AS sxy, sum(w*(y-my)*(y-my)) AS syy FROM (
            SELECT county, x, y, w, sum(w*x) OVER g/sum(w) OVER g AS mx, sum(w*y) OVER g/sum(w) OVER g AS my FROM ({src}) WINDOW g AS (PARTITION BY county)) GROUP BY 1)))"""


def regression_sql(src):
    body = REGRESSION.replace("{p}", t_pvalue("t", "(n-2)::DOUBLE")).replace("{src}", src)
    pts = f"SELECT county, count(DISTINCT (x, y)) >= 5 AS ok FROM ({src}) GROUP BY 1"
    cols = ", ".join(f"CASE WHEN ok THEN round({c},6) END AS {c}" for c in ("slope", "intercept", "r2", "p_value"))
    return f"SELECT county, {cols}, n FROM ({body}) JOIN ({pts}) USING (county)"


@query("regression_plain", "A20 M2", regression_sql("SELECT county, ln(1+jobs) AS x, los AS y, 1.0::DOUBLE AS w FROM v_unit"))
def _(t):
    u = t.unit.withColumn("x", F.log1p("jobs"))
    return rounded(S.regression(u, ["county"], "x", "los"), ["county"])


@query("regression_weighted", "A20 M2", regression_sql("SELECT county, ln(1+jobs) AS x, los AS y, population AS w FROM v_unit"))
def _(t):
    u = t.unit.withColumn("x", F.log1p("jobs"))
    return rounded(S.regression(u, ["county"], "x", "los", "population"), ["county"])


@query("weighted_mean_and_median", "A19 W5", """
    WITH c AS (SELECT county, income, population, sum(population) OVER (PARTITION BY county ORDER BY income) AS cum, sum(population) OVER (PARTITION BY county) AS tot FROM v_unit)
    SELECT county, round(max(m), 6) AS mean, min(income) AS median FROM c JOIN (SELECT county, sum(income*population)/sum(population) AS m FROM v_unit GROUP BY 1) USING (county)
    WHERE cum >= 0.5*tot AND population > 0 GROUP BY 1""")
def _(t):
    mean = t.unit.groupBy("county").agg(r(R.weighted_mean(F.col("income"), F.col("population"))).alias("mean"))
    return mean.join(S.weighted_median(t.unit, ["county"], "income", "population"), "county")


SPLIT = """
    WITH m AS ({median}), j AS (SELECT u.county, income, los, {w} AS w, m.median, income <= m.median AS low FROM v_unit u JOIN m ON u.county = m.county),
    a AS (SELECT county, max(median) AS median, sum(los*w) FILTER (WHERE low)/nullif(sum(w) FILTER (WHERE low),0) AS low_mean, sum(los*w) FILTER (WHERE NOT low)/nullif(sum(w) FILTER (WHERE NOT low),0) AS high_mean,
       count(*) FILTER (WHERE low) AS low_n, count(*) FILTER (WHERE NOT low) AS high_n, avg(los) FILTER (WHERE low) AS la, avg(los) FILTER (WHERE NOT low) AS ha,
       var_samp(los) FILTER (WHERE low) AS lv, var_samp(los) FILTER (WHERE NOT low) AS hv FROM j GROUP BY 1),
    b AS (SELECT *, (la-ha)/sqrt(lv/low_n+hv/high_n) AS t, pow(lv/low_n+hv/high_n,2)/(pow(lv/low_n,2)/(low_n-1)+pow(hv/high_n,2)/(high_n-1)) AS v FROM a)
    SELECT county, CASE WHEN big THEN round(median,6) END AS median, CASE WHEN big THEN round(low_mean,6) END AS low_mean, CASE WHEN big THEN round(high_mean,6) END AS high_mean,
      CASE WHEN big THEN low_n ELSE 0 END AS low_n, CASE WHEN big THEN high_n ELSE 0 END AS high_n, CASE WHEN ok THEN round(t,6) END AS t_statistic, CASE WHEN ok THEN round({p},6) END AS p_value {extra}
    FROM (SELECT *, low_n+high_n >= 4 AS big, low_n+high_n >= 4 AND low_n >= 2 AND high_n >= 2 AS ok FROM b)"""


@query("median_split", "A21", SPLIT.replace("{median}", "SELECT county, quantile_cont(income,0.5) AS median FROM v_unit GROUP BY 1").replace("{w}", "1.0").replace("{p}", t_pvalue("t", "v")).replace("{extra}", ""))
def _(t):
    return rounded(S.median_split(t.unit, ["county"], "income", "los"), ["county"])


@query("median_split_weighted", "A21", SPLIT.replace("{median}", """SELECT county, min(income) AS median FROM (SELECT county, income, population,
      sum(population) OVER (PARTITION BY county ORDER BY income) AS cum, sum(population) OVER (PARTITION BY county) AS tot FROM v_unit) WHERE cum >= 0.5*tot AND population > 0 GROUP BY 1""")
    .replace("{w}", "population").replace("{p}", t_pvalue("t", "v")).replace("{extra}", ", CASE WHEN big THEN round(high_mean-low_mean,6) END AS diff"))
def _(t):
    return rounded(S.median_split(t.unit, ["county"], "income", "los", "population"), ["county"])


BIN = "((los > 1e-7)::INT + (los > 10)::INT + (los > 20)::INT + (los > 30)::INT + (los > 40)::INT + (los > 50)::INT + (los > 60)::INT + (los > 70)::INT + (los > 80)::INT + (los > 90)::INT)"


@query("access_distribution", "A22 F12", f"""
    WITH f AS (SELECT county, sum(population) AS tp, sum(dem) AS td, sum(los*population)/nullif(sum(population),0) AS ap, sum(los*dem)/nullif(sum(dem),0) AS ad FROM v_unit GROUP BY 1),
    b AS (SELECT county, {BIN} AS bin, sum(population) AS p, sum(dem) AS d FROM v_unit GROUP BY 1,2)
    SELECT f.county, k.bin::INT AS bin, ['0','0-10','10-20','20-30','30-40','40-50','50-60','60-70','70-80','80-90','90-100'][(k.bin+1)::INT] AS label,
      coalesce(p,0) AS population, round(100.0*coalesce(p,0)/tp,6) AS population_pct, round(ap,6) AS access_population,
      coalesce(d,0) AS overlay, round(100.0*coalesce(d,0)/td,6) AS overlay_pct, round(ad,6) AS access_overlay
    FROM f CROSS JOIN range(0,11) k(bin) LEFT JOIN b ON b.county = f.county AND b.bin = k.bin""")
def _(t):
    return rounded(S.distribution(t.unit, ["county"], "los", "population", "dem"), ["county", "bin", "label"])


@query("relative_columns", "A23", f"""
    WITH c AS (SELECT county, population, jobs, {sql_area('cell', FINE)} AS a FROM v_fine_cell)
    SELECT county, 'jobs' AS "column", round(sum(jobs/a*population)/sum(population),6) AS density, round(sum(jobs/nullif(population+jobs,0)*population)/nullif(sum(CASE WHEN population+jobs > 0 THEN population END),0),6) AS share FROM c GROUP BY 1
    UNION ALL SELECT county, 'population', round(sum(population/a*population)/sum(population),6), round(sum(population/nullif(population+jobs,0)*population)/nullif(sum(CASE WHEN population+jobs > 0 THEN population END),0),6) FROM c GROUP BY 1""")
def _(t):
    c = t.fine_cell.withColumn("a", grid.area_km2(F.col("cell"), FINE)).withColumn("both", F.col("population") + F.col("jobs"))
    return rounded(S.relative_summary(c, ["county"], ["jobs", "population"], "a", "both"), ["county", "column"])


DENSE = f"SELECT *, (population+jobs)/{sql_area('cell', FINE)} AS density FROM v_fine_cell"
FIT = f"""SELECT county, n, CASE WHEN n>=4 THEN slope END AS slope, CASE WHEN n>=4 THEN intercept END AS intercept, CASE WHEN n>=4 THEN sqrt(greatest(syy-slope*sxy,0)/n) END AS std FROM (
    SELECT county, count(*) AS n, regr_slope(los, ln(density)) AS slope, regr_intercept(los, ln(density)) AS intercept, regr_syy(los, ln(density)) AS syy, regr_sxy(los, ln(density)) AS sxy
    FROM ({DENSE}) WHERE density > 0 AND los > 0 GROUP BY 1)"""


def _dense(t):
    return t.fine_cell.withColumn("density", (F.col("population") + F.col("jobs")) / grid.area_km2(F.col("cell"), FINE))


@query("density_fit_per_county", "A24", f"SELECT county, n, round(slope,6) AS slope, round(intercept,6) AS intercept, round(std,6) AS std FROM ({FIT})")
def _(t):
    return rounded(S.density_fit(_dense(t), ["county"], "density", "los"), ["county", "n"])


@query("equity_flags", "K10 A24", f"""
    WITH f AS ({FIT}), d AS ({DENSE})
    SELECT cell, CASE WHEN los-(slope*ln(density)+intercept) > std THEN 'more_housing' WHEN los-(slope*ln(density)+intercept) < -std AND density > 20 THEN 'more_transit' END AS flag
    FROM d LEFT JOIN f USING (county)""")
def _(t):
    d = _dense(t)
    return S.equity_flag(d, S.density_fit(d, ["county"], "density", "los"), ["county"], "density", "los", gate=20.0).select("cell", "flag")


def _wm(src, v, name):
    return f"""SELECT county, min({v}) AS {name} FROM (SELECT county, {v}, population, sum(population) OVER (PARTITION BY county ORDER BY {v}) AS cum,
        sum(population) OVER (PARTITION BY county) AS tot FROM {src}) WHERE cum >= 0.5*tot AND population > 0 GROUP BY 1"""


@query("priority_flags", "K11", f"""
    WITH d AS ({DENSE}), m AS ({_wm('d', 'density', 'ma')}), h AS (SELECT d.*, ma, density > ma AS half FROM d JOIN m USING (county)),
    ha AS (SELECT * FROM h WHERE half), hb AS (SELECT * FROM h WHERE NOT half),
    ad AS ({_wm('ha', 'density', 'ad')}), al AS ({_wm('ha', 'los', 'als')}), bd AS ({_wm('hb', 'density', 'bd')}), bl AS ({_wm('hb', 'los', 'bls')})
    SELECT cell, coalesce(density > ma AND density > ad AND los < bls, false) AS more_transit, coalesce(density <= ma AND density < bd AND los > als, false) AS more_housing
    FROM h LEFT JOIN ad USING (county) LEFT JOIN al USING (county) LEFT JOIN bd USING (county) LEFT JOIN bl USING (county)""")
def _(t):
    return S.priority_flags(_dense(t), ["county"], "density", "los", "population").select("cell", "more_transit", "more_housing")


@query("quantiles_101", "A25", """
    WITH a AS (SELECT 'jobs' AS "column", list_sort(list(jobs)) AS v FROM v_unit UNION ALL SELECT 'los', list_sort(list(los)) FROM v_unit),
    p AS (SELECT "column", k.q AS k, v, k.q/100.0::DOUBLE AS q, (k.q/100.0::DOUBLE)*(len(v)-1) AS pos FROM a, range(0,101) k(q))
    SELECT "column", q, round(v[floor(pos)::INT+1] + (v[ceil(pos)::INT+1]-v[floor(pos)::INT+1])*(pos-floor(pos)), 6) AS value FROM p""")
def _(t):
    return rounded(S.quantile_table(t.unit, ["jobs", "los"]), ["column", "q"])


@query("region_service_report", "A26 A1 K10 A52", f"""
    WITH c AS (SELECT state, {sql_parent('cell', FINE, 9)} AS cell, sum(population) AS population, sum(jobs) AS jobs,
          coalesce(sum(los*population)/nullif(sum(population),0), sum(los*jobs)/nullif(sum(jobs),0), avg(los)) AS los
        FROM (SELECT *, {__import__('stopfield.queries.views', fromlist=['x']).sql_cell('lon', 'lat', FINE)} AS cell FROM v_unit) GROUP BY 1,2),
    d AS (SELECT *, population/{sql_area('cell', 9)} AS density FROM c),
    f AS (SELECT state, CASE WHEN n>=4 THEN slope END AS slope, CASE WHEN n>=4 THEN intercept END AS intercept, CASE WHEN n>=4 THEN sqrt(greatest(syy-slope*sxy,0)/n) END AS std FROM (
       SELECT state, count(*) AS n, regr_slope(los, ln(density)) AS slope, regr_intercept(los, ln(density)) AS intercept, regr_syy(los, ln(density)) AS syy, regr_sxy(los, ln(density)) AS sxy
       FROM d WHERE density > 0 AND los > 0 GROUP BY 1)),
    e AS (SELECT d.*, CASE WHEN density > 0 AND los-(slope*ln(density)+intercept) > std THEN 1 ELSE 0 END AS h, CASE WHEN density > 0.005 AND los-(slope*ln(density)+intercept) < -std THEN 1 ELSE 0 END AS tr
          FROM d LEFT JOIN f USING (state))
    SELECT state, count(*) AS cells, round(sum(population),3) AS population, round(sum(los*population)/nullif(sum(population),0),6) AS los,
           round(sum(CASE WHEN los > 20 THEN population ELSE 0 END)/nullif(sum(population),0),6) AS served_share, sum(h)::BIGINT AS more_housing, sum(tr)::BIGINT AS more_transit
    FROM e GROUP BY ROLLUP (state)""")
def _(t):
    from stopfield.plans.region_report import region_report

    return rounded(region_report(t.unit, "state", FINE, 9, served_above=20.0, gate=0.005), ["state"])


@query("weighted_correlations", "A44", """
    WITH m AS (SELECT sum(population*los)/sum(population) AS a, sum(population*income)/sum(population) AS b, sum(population*jobs)/sum(population) AS c FROM v_unit),
    x AS (SELECT sum(population*(los-a)*(los-a)) AS aa, sum(population*(income-b)*(income-b)) AS bb, sum(population*(jobs-c)*(jobs-c)) AS cc,
      sum(population*(los-a)*(income-b)) AS ab, sum(population*(los-a)*(jobs-c)) AS ac, sum(population*(income-b)*(jobs-c)) AS bc FROM v_unit, m)
    SELECT 'los' AS a, 'income' AS b, round(ab/sqrt(aa*bb),6) AS correlation FROM x UNION ALL SELECT 'los','jobs', round(ac/sqrt(aa*cc),6) FROM x UNION ALL SELECT 'income','jobs', round(bc/sqrt(bb*cc),6) FROM x""")
def _(t):
    return rounded(S.correlations(t.unit, ["los", "income", "jobs"], "population"), ["a", "b"])


@query("group_medians", "A55 A47", """
    SELECT county, round(quantile_cont(lon,0.02),6) AS west, round(quantile_cont(lon,0.98),6) AS east, round(quantile_cont(lat,0.02),6) AS south, round(quantile_cont(lat,0.98),6) AS north FROM v_unit GROUP BY 1""")
def _(t):
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in ("lon", "lat")])
    q = exact_quantiles(t.unit.select("county", F.inline(pairs)), ["county", "axis"], "v", [0.02, 0.98])
    pick = lambda a, p, n: r(F.max(F.when((F.col("axis") == a) & (F.col("q") == p), F.col("value")))).alias(n)
    return q.groupBy("county").agg(pick("lon", 0.02, "west"), pick("lon", 0.98, "east"), pick("lat", 0.02, "south"), pick("lat", 0.98, "north"))

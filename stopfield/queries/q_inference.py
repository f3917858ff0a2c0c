"""Queries on samples, tests, models and network loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.functions.curves import DEFAULT
from stopfield.operators import inference as I
from stopfield.operators import models as Mo
from stopfield.operators import network as Nw
from stopfield.operators import sample as Sa
from stopfield.operators import score as K
from stopfield.queries.registry import query
from stopfield.queries.q_score import HEAD, MODE, SPEED
from stopfield.queries.q_spatial import along, segment
from stopfield.queries.views import FINE, sql_centre
from stopfield.session import cut_lineage


def r(c, digits=6):
    return F.round(c, digits)


def U(key, seed):
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR),1,13))::BIGINT::DOUBLE/4503599627370496.0)"


STRATA = """
    q AS (SELECT list_sort(list(population)) AS v FROM v_unit WHERE population > 0),
    e AS (SELECT list(v[floor(p*(len(v)-1))::INT+1] + (v[ceil(p*(len(v)-1))::INT+1]-v[floor(p*(len(v)-1))::INT+1])*(p*(len(v)-1)-floor(p*(len(v)-1)))) AS e FROM q, (VALUES (0.5::DOUBLE),(0.7),(0.8),(0.9),(0.95),(0.98),(0.99),(0.995)) k(p)),
    s AS (SELECT u.*, len(list_filter(e, lambda x: population > x))*100 + (los >= 0.0001)::INT + greatest(0, least(19, floor(los/5)))::INT AS stratum FROM v_unit u, e WHERE population > 0)"""


@query("national_stratified_sample", "I1", f"""
    WITH {STRATA}, n AS (SELECT count(*) AS al FROM s), k AS (SELECT s.*, al, count(*) OVER (PARTITION BY stratum) AS tot, row_number() OVER (PARTITION BY stratum ORDER BY {U('id', 7)}) AS pos FROM s, n),
    p AS (SELECT * FROM k WHERE pos <= greatest(1, round_even(tot*(least(400.0, al)/al),0))), f AS (SELECT stratum, sum(population) AS fp FROM s GROUP BY 1), g AS (SELECT stratum, sum(population) AS sp FROM p GROUP BY 1)
    SELECT id, p.stratum, round(population*fp/sp,6) AS population, los, round(al/(SELECT count(*) FROM p),6) AS factor FROM p JOIN f ON f.stratum = p.stratum JOIN g ON g.stratum = p.stratum""")
def _(t):
    out = Sa.stratified_sample(t.unit.select("id", "population", "los"), "id", "population", "los", ["population"], 400)
    return out.select("id", "stratum", r(F.col("population")).alias("population"), "los", r(F.col("factor")).alias("factor"))


@query("informative_rows_weighted", "I2 F13", f"""
    SELECT id, CASE WHEN los > 60 OR dem > 5 THEN 1.0 ELSE 5.0 END AS w FROM v_unit WHERE los > 60 OR dem > 5 OR floor({U('id', 0)}*5) = 0""")
def _(t):
    return Sa.informative_weights(t.unit.select("id", "los", "dem"), "id", (F.col("los") > 60) | (F.col("dem") > 5)).select("id", "w")


@query("proportional_sample", "I3 W10", f"""
    WITH k AS (SELECT id, county, count(*) OVER (PARTITION BY county) AS n, count(*) OVER () AS al, row_number() OVER (PARTITION BY county ORDER BY {U('id', 3)}) AS pos FROM v_place),
    s AS (SELECT *, least(n, greatest(15.0, round_even(500.0*n/al,0))) AS k FROM k) SELECT id, county, round(n/k,6) AS w FROM s WHERE pos <= k""")
def _(t):
    out = Sa.proportional_sample(t.place.select("id", "county"), "county", "id", 500, 15, 3)
    return out.select("id", "county", r(F.col("w")).alias("w"))


@query("metro_sample", "I3 W10", f"""
    SELECT id, county, round(n/least(n, 30),6) AS w FROM (SELECT id, county, count(*) OVER (PARTITION BY county) AS n, row_number() OVER (PARTITION BY county ORDER BY {U('id', 5)}) AS pos FROM v_place) WHERE pos <= 30""")
def _(t):
    out = Sa.group_sample(t.place.select("id", "county"), "county", "id", 30, 5)
    return out.select("id", "county", r(F.col("w")).alias("w"))


def _raw(t):
    share = F.least(F.col("dem"), F.col("population")) / F.greatest(F.col("population"), F.lit(1.0))
    u = t.unit.filter("population > 0").withColumn("share", share)
    return u.withColumn("sbin", Sa.share_bin(F.col("share"))).withColumn("raw", F.sqrt("population") * F.when(F.col("share") > 0, 2.0).otherwise(1.0)).select("id", "state", "county", "population", "sbin", "raw")


@query("unequal_probability_sample", "I4 W9", """
    WITH x AS (SELECT id, state, county, population, least(dem,population)/greatest(population,1) AS share FROM v_unit WHERE population > 0),
    y AS (SELECT *, (share >= 1e-9)::INT + (share >= 0.01)::INT + (share >= 0.03)::INT + (share >= 0.08)::INT AS sbin, sqrt(population)*CASE WHEN share > 0 THEN 2 ELSE 1 END AS raw FROM x),
    p AS (SELECT *, raw*0.1*(SELECT count(*) FROM y)/(SELECT sum(raw) FROM y) AS pi FROM y),
    c AS (SELECT *, sum(pi) OVER (ORDER BY state, county, sbin, population, md5(id::VARCHAR) ROWS UNBOUNDED PRECEDING) + 0.37 AS cum FROM p)
    SELECT id, round(1/pi,6) AS w FROM c WHERE floor(cum + 1e-9) > floor(cum - pi + 1e-9) OR pi >= 1""")
def _(t):
    rows, _c = Sa.inclusion(_raw(t).withColumn("one", F.lit(1.0)), "raw", 0.1)
    return Sa.systematic_sample(rows, ["state", "county", "sbin"], "population", "id", "one", 0.37).select("id", r(F.col("w")).alias("w"))


@query("metro_folds", "I5", f"""
    WITH g AS (SELECT county, sum(population) AS s FROM v_unit GROUP BY 1), k AS (SELECT county, row_number() OVER (ORDER BY s DESC, county) - 1 AS p FROM g)
    SELECT id, CASE WHEN p < 10 THEN p%5 ELSE floor({U('county', 0)}*5)::INT END AS fold FROM v_unit JOIN k USING (county)""")
def _(t):
    return Sa.group_folds(t.unit.select("id", "county", "population"), "county", "population").select("id", "fold")


def _pois(u):
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(1, 13):
        total += term
        out.append(f"({u} >= {total!r})::INT")
        term /= k
    return "(" + "+".join(out) + ")"


@query("bootstrap_weights", "I6", f"""
    SELECT DISTINCT c_nationkey AS county, rep::INT AS rep, {_pois(U("c_nationkey::VARCHAR || '/' || rep::VARCHAR", 0))}::DOUBLE AS weight FROM customer, range(0,40) k(rep)""")
def _(t):
    return I.bootstrap_weights(t.place, "county", 40)


@query("exponential_weights", "I6", f"""
    SELECT DISTINCT c_nationkey AS county, rep::INT AS rep, round(-ln(1-{U("c_nationkey::VARCHAR || '/' || rep::VARCHAR", 0)}),9) AS weight FROM customer, range(0,40) k(rep)""")
def _(t):
    return I.bootstrap_weights(t.place, "county", 40, "exponential").withColumn("weight", r(F.col("weight"), 9))


RUNS = "SELECT run, county, sum(population*abs(los/100-dem/10)*(1-run*0.02+((id*run)%7)*0.004)) AS num, sum(population*0.5) AS den FROM v_unit, range(0,6) k(run) GROUP BY 1,2"


def _runs(t):
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("run")
    u = t.unit.select("id", "county", "population", "los", "dem", run)
    loss = F.col("population") * F.abs(F.col("los") / 100 - F.col("dem") / 10) * (1 - F.col("run") * 0.02 + (F.col("id") * F.col("run")) % 7 * 0.004)
    return u.groupBy("run", "county").agg(F.sum(loss).alias("num"), F.sum(F.col("population") * 0.5).alias("den"))


def _pairs(t):
    base = _runs(t).filter("run = 0").select("county", F.col("num").alias("a"))
    return _runs(t).filter("run > 0").join(base, "county")


TESTS = f"""
    u AS ({RUNS}), p AS (SELECT b.run, b.county, a.num AS na, b.num AS nb, b.den FROM u a JOIN u b ON a.county = b.county AND a.run = 0 AND b.run > 0),
    d AS (SELECT run, sum(na-nb)/sum(den) AS difference FROM p GROUP BY 1), w AS (SELECT n_nationkey AS county, rep, {_pois(U("n_nationkey::VARCHAR || '/' || rep::VARCHAR", 0))} AS w FROM nation, range(0,4000) k(rep)),
    b AS (SELECT run, rep, sum(w*(na-nb))/nullif(sum(w*den),0) AS d FROM p JOIN w USING (county) GROUP BY 1,2), t AS (SELECT run, difference, p_value FROM d JOIN (SELECT run, avg((coalesce(d,0) <= 0)::INT) AS p_value FROM b GROUP BY 1) USING (run))"""


def _tests(t):
    return I.paired_bootstrap(_pairs(t), ["run"], "county", "a", "num", "den", replicates=4000)


@query("paired_bootstrap_tests", "I7 I6", f"WITH {TESTS} SELECT run, round(difference,9) AS difference, round(p_value,6) AS p_value FROM t")
def _(t):
    return _tests(t).select("run", r(F.col("difference"), 9).alias("difference"), r(F.col("p_value")).alias("p_value"))


@query("holm_step_down", "I8", f"""
    WITH {TESTS}, k AS (SELECT run, p_value, p_value < 0.05/(count(*) OVER () - row_number() OVER (ORDER BY p_value, run) + 1) AS ok FROM t)
    SELECT run, bool_and(ok) OVER (ORDER BY p_value, run ROWS UNBOUNDED PRECEDING) AS significant FROM k""")
def _(t):
    return I.holm(_tests(t), "run", "p_value").select("run", "significant")


@query("fold_skills", "I9", f"""
    WITH u AS (SELECT *, county%5 AS fold FROM ({RUNS})) SELECT run, fold, round(1-sum(num)/sum(den),6) AS skill FROM u GROUP BY 1,2 UNION ALL SELECT run, NULL, round(1-sum(num)/sum(den),6) FROM u GROUP BY 1""")
def _(t):
    u = _runs(t).withColumn("fold", F.col("county") % 5)
    return I.fold_skills(u, ["run"], "fold", "num", "den").withColumn("skill", r(F.col("skill")))


@query("folds_better", "I9", f"""
    WITH u AS (SELECT run, county%5 AS fold, 1-sum(num)/sum(den) AS skill FROM ({RUNS}) GROUP BY 1,2) SELECT a.run, count(*) FILTER (WHERE a.skill > b.skill) AS better, count(*) AS folds FROM u a JOIN u b ON a.fold = b.fold AND b.run = 0 GROUP BY 1""")
def _(t):
    u = _runs(t).withColumn("fold", F.col("county") % 5)
    return I.folds_better(I.fold_skills(u, ["run"], "fold", "num", "den"), "run", "fold", 0)


@query("median_group_skill", "I9", f"SELECT round(median(s),6) AS median_skill FROM (SELECT county, 1-sum(num)/sum(den) AS s FROM ({RUNS}) WHERE run = 1 GROUP BY 1)")
def _(t):
    return I.group_skills(_runs(t).filter("run = 1"), "county", "num", "den")[1].select(r(F.col("median_skill")).alias("median_skill"))


TH = [0.1, 0.2, 0.4, 0.6]
ALPHAS = [0.8, 0.2, -0.8, -1.8]


def _ll(hit, p):
    q = f"least(greatest({p},1e-6),1-1e-6)"
    return f"-({hit}*ln({q})+(1-{hit})*ln(1-{q}))"


LOSSES = " UNION ALL ".join(
    f"SELECT {th}::DOUBLE AS threshold, sum(population*({_ll(f'(dem/population > {th})::INT', f'1/(1+exp(-({a}+0.01*los)))')}))/sum(population) AS loss, sum(population*(dem/population > {th})::INT)/sum(population) AS p0 FROM v_unit WHERE population > 0"
    for th, a in zip(TH, ALPHAS))


def _losses(t):
    u = t.unit.filter("population > 0")
    return I.threshold_losses(u, F.col("dem") / F.col("population"), F.col("population"), TH, lambda i: 1 / (1 + F.exp(-(F.lit(ALPHAS[i]) + 0.01 * F.col("los")))))


@query("threshold_losses", "I11", f"SELECT threshold, round(loss,6) AS loss, round(-(p0*ln(p0)+(1-p0)*ln(1-p0)),6) AS base, round(1-loss/-(p0*ln(p0)+(1-p0)*ln(1-p0)),6) AS skill FROM ({LOSSES})")
def _(t):
    return _losses(t).select("threshold", *[r(F.col(c)).alias(c) for c in ("loss", "base", "skill")])


@query("ordinal_loss", "I11", f"SELECT round(avg(loss/-(p0*ln(p0)+(1-p0)*ln(1-p0))),6) AS ordinal_loss FROM ({LOSSES})")
def _(t):
    return I.ordinal_loss(_losses(t)).select(r(F.col("ordinal_loss")).alias("ordinal_loss"))


@query("control_ranking", "I12", f"""
    WITH {TESTS}, f AS (SELECT run, p_value, p_value < 0.05/(count(*) OVER () - row_number() OVER (ORDER BY p_value, run) + 1) AS ok FROM t WHERE difference > 0),
    g AS (SELECT run, bool_and(ok) OVER (ORDER BY p_value, run ROWS UNBOUNDED PRECEDING) AS significant FROM f)
    SELECT run, row_number() OVER (ORDER BY difference DESC, run) AS place, coalesce(significant, false) AS significant FROM t LEFT JOIN g USING (run)""")
def _(t):
    return I.rank_controls(_tests(t), "run").select("run", F.col("place").cast("long").alias("place"), "significant")


@query("smallest_good_set", "I12", f"WITH {TESTS} SELECT min(run) AS k FROM t WHERE NOT (difference > 0 AND p_value < 0.05)")
def _(t):
    return I.smallest_set(_tests(t).withColumnRenamed("run", "k"))


def _newton(rounds=15):
    parts = ["u AS (SELECT los/100 AS f, dem AS y, population AS n FROM v_unit WHERE population > 0)", "k0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(rounds):
        parts.append(f"k{i+1} AS (SELECT a+(hbb*ga-hab*gb)/(haa*hbb-hab*hab) AS a, b+(haa*gb-hab*ga)/(haa*hbb-hab*hab) AS b FROM (SELECT any_value(a) AS a, any_value(b) AS b, sum(y-n*p) AS ga, sum((y-n*p)*f) AS gb, sum(n*p*(1-p)) AS haa, sum(n*p*(1-p)*f) AS hab,"
                     f" sum(n*p*(1-p)*f*f) AS hbb FROM (SELECT *, 1/(1+exp(-(a+b*f))) AS p FROM u, k{i})))")
    return "WITH " + ", ".join(parts) + f" SELECT round(a,4) AS intercept, round(b,4) AS slope FROM k{rounds}"


@query("logistic_pooled", "M1", _newton())
def _(t):
    u = t.unit.filter("population > 0").select((F.col("los") / 100).alias("f"), "dem", "population")
    a, b = Mo.logistic_pooled(u, ["f"], "dem", "population")
    return t.spark.createDataFrame([(a, b[0])], "intercept double, slope double").select(r(F.col("intercept"), 4).alias("intercept"), r(F.col("slope"), 4).alias("slope"))


def _newton_by_group(rounds=20):
    parts = ["u AS (SELECT county, los/100 AS f, dem AS y, population AS n FROM v_unit WHERE population > 0)",
             "k0 AS (SELECT DISTINCT county, (SELECT ln((sum(y)+0.5)/(sum(n)-sum(y)+0.5)) FROM u) AS a, 0.0::DOUBLE AS b FROM u)"]
    for i in range(rounds):
        parts.append(f"s{i} AS (SELECT county, any_value(a) AS a, any_value(b) AS b, sum(y-n*p) AS r, sum(n*p*(1-p)) AS w, sum(n*p*(1-p)*f) AS c, sum((y-n*p)*f) AS g, sum(n*p*(1-p)*f*f) AS h"
                     f" FROM (SELECT *, 1/(1+exp(-(a+b*f))) AS p FROM u JOIN k{i} USING (county)) GROUP BY 1)")
        parts.append(f"d{i} AS (SELECT sum(g-c*r/w)/sum(h-c*c/w) AS change FROM s{i})")
        parts.append(f"k{i+1} AS (SELECT county, a + greatest(-2, least(2, (r-c*change)/w)) AS a, b + change AS b FROM s{i}, d{i})")
    return "WITH " + ", ".join(parts) + f" SELECT county, round(a,5) AS intercept, round(b,5) AS slope FROM k{rounds}"


@query("logistic_by_metro", "M1", _newton_by_group())
def _(t):
    u = t.unit.filter("population > 0").select("county", (F.col("los") / 100).alias("f"), "dem", "population")
    a, b = Mo.logistic_by_group(u, "county", "f", "dem", "population")
    return a.select("county", r(F.col("a"), 5).alias("intercept"), F.lit(round(b, 5)).alias("slope"))


@query("two_part_probabilities", "M3", """
    SELECT id, round(1/(1+exp(-(0.5+0.02*los)))*q,6) AS p_low, round(1/(1+exp(-(-1.0+0.02*los)))*q,6) AS p_high, round(q,6) AS p_any FROM (SELECT *, 1/(1+exp(-(-1.0+0.3*ln(greatest(population,1))+0.01*los))) AS q FROM v_unit)""")
def _(t):
    ps, chance = Mo.two_part(F.col("los"), F.col("population"), [0.5, -1.0], 0.02, (-1.0, 0.3, 0.01))
    return t.unit.select("id", r(ps[0]).alias("p_low"), r(ps[1]).alias("p_high"), r(chance).alias("p_any"))


def _fit_loss(t):
    u = t.unit.filter("population > 0").select(F.col("id").alias("cell"), (F.col("dem") / F.col("population")).alias("share"), F.col("population").alias("pw"))
    return lambda scores: scores.join(u, "cell").groupBy("set", *[c for c in scores.columns if c == "county"]).agg((F.sum(F.col("pw") * F.pow(F.col("los") / 100 - F.col("share"), F.lit(2))) / F.sum("pw")).alias("loss"))


def _profiles(t):
    return K.pattern_slots(t.pattern, [F.col("h"), F.col("route"), F.col("direction")], 3)


def _search_sql(start=1.5, steps=(0.4, 0.2)):
    """Two rounds over one parameter; the second one starts at the best of the first with half the steps."""
    moves = [(f"walk_power:{sign * s / 2**r:+.4f}", sign * s / 2**r, r) for r in range(2) for s in steps for sign in (1, -1)]
    names = lambda r: ", ".join(["('stay', 0.0::DOUBLE)", *[f"('{n}', {v!r}::DOUBLE)" for n, v, at in moves if at == r]])
    parts = [
        f"b AS (SELECT station, mode, max({MODE.format(m='mode')}*{HEAD.format(h='h')}*{SPEED.format(v='v')}) AS base FROM v_pattern GROUP BY 1, 2)",
        """p AS (SELECT cell, base, 1+dist/(CASE mode WHEN 'bus' THEN 500.0 WHEN 'tram' THEN 700.0 ELSE 900.0 END) AS k FROM v_item i JOIN b ON i.station = b.station)""",
        f"b0 AS (SELECT {start}::DOUBLE AS power)",
    ]
    for r in range(2):
        parts.append(f"m{r} AS (SELECT st, power*(1+move) AS power FROM b{r}, (VALUES {names(r)}) x(st, move))")
        parts.append(f"s{r} AS (SELECT cell, st, any_value(power) AS power, 100*max(base*pow(k, -power)) AS los FROM p, m{r} GROUP BY 1, 2)")
        parts.append(f"l{r} AS (SELECT st, any_value(power) AS power, sum(population*pow(s.los/100-dem/population,2))/sum(population) AS loss FROM s{r} s JOIN v_unit u ON cell = id WHERE population > 0 GROUP BY 1)")
        parts.append(f"b{r+1} AS (SELECT arg_min(power, row(loss, st)) AS power FROM l{r})")
    return "WITH " + ", ".join(parts) + " SELECT st AS \"set\", round(loss, 6) AS loss, round(b2.power, 6) AS walk_power FROM l1, b2"


@query("curve_parameter_search", "M4 K12", _search_sql())
def _(t):
    best, losses = Mo.search_curves(t.item, t.pattern, DEFAULT, {"walk_power": [0.4, 0.2]}, _fit_loss(t), rounds=2)
    return losses.select("set", r(F.col("loss")).alias("loss"), F.lit(round(best.walk_power, 6)).alias("walk_power"))


@query("curve_fit_from_several_starts", "M4 K12")
def _(t):
    # the shares are those of known curves, so the best fit can be read off the result
    truth = DEFAULT.with_(walk_power=2.2, mode={**DEFAULT.mode, "tram": 0.5})
    items, profiles = cut_lineage(t.item.select("cell", "station", "dist")), cut_lineage(_profiles(t))
    aim = cut_lineage(K.rescore(items, profiles, {"truth": truth}).select("cell", F.col("los").alias("aim")))
    loss = lambda scores: scores.join(aim, "cell").groupBy("set").agg(F.avg(F.pow(F.col("los") - F.col("aim"), F.lit(2))).alias("loss"))
    best, runs = Mo.fit_curves(items, profiles, DEFAULT, ["walk_power", "mode:tram"], loss, starts=2, spread=0.2, tolerance=0.05)
    rows = [(i, round(v, 1), round(p["walk_power"], 1), round(p["mode:tram"], 1)) for i, (v, p) in enumerate(runs)]
    return t.spark.createDataFrame(rows, "start int, loss double, walk_power double, tram double")


SETS = {"national": DEFAULT, "steep": DEFAULT.with_(walk_power=2.5), "flat": DEFAULT.with_(walk_power=0.5)}


@query("best_curves_per_metro", "M5", """
    WITH p AS (SELECT *, value*pow(1+dist/(CASE mode WHEN 'bus' THEN 500.0 WHEN 'tram' THEN 700.0 ELSE 900.0 END), 1.5) AS base, 1+dist/(CASE mode WHEN 'bus' THEN 500.0 WHEN 'tram' THEN 700.0 ELSE 900.0 END) AS k FROM v_scored_item WHERE slot < 3),
    s AS (SELECT cell, county, 'national' AS st, 100*max(base*pow(k,-1.5)) AS los FROM p GROUP BY 1,2 UNION ALL SELECT cell, county, 'steep', 100*max(base*pow(k,-2.5)) FROM p GROUP BY 1,2 UNION ALL SELECT cell, county, 'flat', 100*max(base*pow(k,-0.5)) FROM p GROUP BY 1,2),
    l AS (SELECT s.county, st, sum(population*pow(s.los/100-dem/population,2))/sum(population) AS loss FROM s JOIN v_unit u ON cell = id WHERE population > 0 GROUP BY 1,2)
    SELECT county, arg_min(st, row(loss, st)) AS best, round(min(loss),6) AS best_loss, round(max(loss) FILTER (WHERE st='national'),6) AS national_loss FROM l GROUP BY 1""")
def _(t):
    losses = _fit_loss(t)(K.rescore(t.item, _profiles(t), SETS, ["county"]))
    out = Mo.best_set_per_group(losses, "county", "national")
    return out.select("county", "best", r(F.col("best_loss")).alias("best_loss"), r(F.col("national_loss")).alias("national_loss"))


@query("inflation_factors", "A44", """
    WITH m AS (SELECT sum(population*los)/sum(population) AS a, sum(population*income)/sum(population) AS b, sum(population*jobs)/sum(population) AS c FROM v_unit),
    x AS (SELECT sum(population*(los-a)*(los-a)) AS aa, sum(population*(income-b)*(income-b)) AS bb, sum(population*(jobs-c)*(jobs-c)) AS cc, sum(population*(los-a)*(income-b)) AS ab, sum(population*(los-a)*(jobs-c)) AS ac, sum(population*(income-b)*(jobs-c)) AS bc FROM v_unit, m),
    y AS (SELECT ab/sqrt(aa*bb) AS r12, ac/sqrt(aa*cc) AS r13, bc/sqrt(bb*cc) AS r23 FROM x), d AS (SELECT *, 1+2*r12*r13*r23-r12*r12-r13*r13-r23*r23 AS det FROM y)
    SELECT 'los' AS "column", round((1-r23*r23)/det,6) AS vif FROM d UNION ALL SELECT 'income', round((1-r13*r13)/det,6) FROM d UNION ALL SELECT 'jobs', round((1-r12*r12)/det,6) FROM d""")
def _(t):
    return Mo.inflation_factors(t.unit, ["los", "income", "jobs"], "population").withColumn("vif", r(F.col("vif")))


@query("mediation", "A45", """
    WITH m AS (SELECT sum(population*dem)/sum(population) AS y, sum(population*los)/sum(population) AS a, sum(population*jobs)/sum(population) AS c FROM v_unit),
    x AS (SELECT sum(population*(dem-y)*(dem-y)) AS yy, sum(population*(los-a)*(los-a)) AS aa, sum(population*(jobs-c)*(jobs-c)) AS cc, sum(population*(los-a)*(jobs-c)) AS ac, sum(population*(dem-y)*(los-a)) AS ya, sum(population*(dem-y)*(jobs-c)) AS yc FROM v_unit, m)
    SELECT round((ya*cc-yc*ac)/(aa*cc-ac*ac),6) AS coefficient, round((ya*(ya*cc-yc*ac)+yc*(yc*aa-ya*ac))/(aa*cc-ac*ac)/yy,6) AS r2_with, round(yc*yc/cc/yy,6) AS r2_controls FROM x""")
def _(t):
    return Mo.mediation(t.unit, "dem", "los", ["jobs"], "population").select(*[r(F.col(c)).alias(c) for c in ("coefficient", "r2_with", "r2_controls")])


@query("distance_band_effects", "A46 I6")
def _(t):
    edges = [0, 400, 800, 1250, 2000]
    near = t.item.join(t.station.select("station", "mode"), "station").groupBy("cell", "mode").agg(F.min("dist").alias("d"))
    feats = [F.max(F.when((F.col("mode") == m) & (F.col("d") >= a) & (F.col("d") < b), 1.0).otherwise(0.0)).alias(f"{m}_{a}") for m in ("bus", "tram", "rail") for a, b in zip(edges, edges[1:])]
    u = t.unit.filter("population > 0").select(F.col("id").alias("cell"), "county", "population", (F.col("dem") / F.col("population")).alias("share"))
    table = u.join(near.groupBy("cell").agg(*feats), "cell", "left").na.fill(0.0)
    names = [f"{m}_{a}" for m in ("bus", "tram", "rail") for a in edges[:-1]]
    return Mo.band_effects(table, "county", names, "share", "population").select("feature", r(F.col("effect"), 5).alias("effect"), r(F.col("sd"), 5).alias("sd"))


def _street(t):
    k = F.col("o_orderkey")
    at = F.expr("o_orderkey div 16")
    return t.orders.select(at.alias("src"), (at + 1 + k % 5).alias("dst"), (F.lit(150.0) + k % 400).alias("w"))


@query("bounded_walks", "K13", """
    WITH RECURSIVE e AS (SELECT src, dst, min(w) AS w FROM (SELECT o_orderkey//16 AS src, o_orderkey//16+1+o_orderkey%5 AS dst, 150.0::DOUBLE+o_orderkey%400 AS w FROM orders UNION ALL SELECT o_orderkey//16+1+o_orderkey%5, o_orderkey//16, 150.0+o_orderkey%400 FROM orders) GROUP BY 1,2),
    r AS (SELECT s_suppkey AS station, s_suppkey*9 AS node, 10.0::DOUBLE AS dist FROM supplier UNION SELECT station, dst, dist+w FROM r JOIN e ON node = src WHERE dist+w <= 600)
    SELECT station, count(*) AS nodes, round(sum(dist),3) AS total FROM (SELECT station, node, min(dist) AS dist FROM r GROUP BY 1,2) GROUP BY 1""")
def _(t):
    e = _street(t)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    starts = t.supplier.select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 9).alias("node"), F.lit(10.0).alias("dist"))
    return Nw.bounded_walk(both, starts, 600.0).groupBy("station").agg(F.count("*").alias("nodes"), r(F.sum("dist"), 3).alias("total"))


@query("cell_walks_to_stations", "K14 J7", f"""
    WITH c AS (SELECT cell, {sql_centre('cell', FINE)[0]} AS lon, {sql_centre('cell', FINE)[1]} AS lat FROM v_fine_cell),
    d AS (SELECT cell, edge, {segment('lon', 'lat')} AS dist, {along('lon', 'lat')} AS f FROM c JOIN v_edge ON lon BETWEEN least(x1,x2)-0.1 AND greatest(x1,x2)+0.1 AND lat BETWEEN least(y1,y2)-0.06 AND greatest(y1,y2)+0.06),
    n AS (SELECT cell, min(row(dist, edge, f)) AS m FROM d WHERE dist <= 6000 GROUP BY 1), e AS (SELECT cell, m[1] AS dist, m[2] AS edge, m[3] AS f FROM n),
    o AS (SELECT cell, edge//16 AS node, dist + f*300 AS off FROM e UNION ALL SELECT cell, edge//16+1+edge%5, dist + (1-f)*300 FROM e),
    w AS (SELECT cell, s_suppkey AS station, min(off + 10) AS dist FROM o JOIN supplier ON s_suppkey*9 = node WHERE off <= 6000 AND off + 10 <= 6000 GROUP BY 1,2)
    SELECT station, count(*) AS cells, round(min(dist), 2) AS nearest FROM w GROUP BY 1""")
def _(t):
    cells = t.fine_cell.select("cell")
    streets = t.edge.select("edge", F.expr("edge div 16").alias("u"), (F.expr("edge div 16") + 1 + F.col("edge") % 5).alias("v"), F.lit(300.0).alias("w"), "x1", "y1", "x2", "y2")
    walks = t.supplier.select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 9).alias("node"), F.lit(10.0).alias("dist"))
    out = Nw.cell_walks(cells, streets, walks, FINE, 6000.0)
    return out.groupBy("station").agg(F.count("*").alias("cells"), r(F.min("dist"), 2).alias("nearest"))


@query("urban_patches", "A53 Q7", f"""
    WITH RECURSIVE d AS (SELECT DISTINCT (c_custkey*7)%10 + 12*((c_custkey//50)%100) AS x, (c_custkey//10*3 + c_custkey*c_custkey)%10 + 12*((c_custkey//50)//100) AS y FROM customer),
    r AS (SELECT x, y, y*100000+x AS label FROM d UNION SELECT d.x, d.y, r.label FROM r JOIN d ON abs(r.x-d.x)+abs(r.y-d.y) = 1 WHERE r.label < d.y*100000+d.x)
    SELECT (({FINE}::BIGINT)<<52)|((1000+label//100000)<<26)|(1000+label%100000) AS label, count(*) AS cells, count(*)::DOUBLE AS amount FROM (SELECT x, y, min(label) AS label FROM r GROUP BY 1,2) GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    k = F.col("c_custkey")
    d = t.customer.withColumn("b", F.floor(k / 50)).select((k * 7 % 10 + F.col("b") % 100 * 12).alias("x"), ((F.floor(k / 10) * 3 + k * k) % 10 + F.floor(F.col("b") / 100) * 12).alias("y")).distinct()
    cells = d.select(grid.pack(FINE, F.lit(1000) + F.col("y"), F.lit(1000) + F.col("x")).alias("cell"), F.lit(1.0).alias("density"), F.lit(1.0).alias("amount"))
    return Nw.urban_patches(cells, FINE, "density", "amount", 1.0, 3.0)

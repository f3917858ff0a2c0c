import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopfield.functions.curves import DEFAULT
from stopfield.operators import inference, models, sample
from stopfield.operators.score import rescore


def units(spark, n=900):
    rnd = random.Random(6)
    return spark.createDataFrame([(i, f"m{i % 3 and 'hot'}{i % 12 if i % 3 == 0 else ''}", float(rnd.randint(1, 500)), float(rnd.choice([0, rnd.random() * 100]))) for i in range(n)], "id long, metro string, population double, los double")


def test_stratified_sample_keeps_every_stratum(spark):
    df = units(spark)
    out = sample.stratified_sample(df, "id", "population", "los", ["population"], 200)
    full = {r["stratum"]: r["s"] for r in sample.population_stratum(df, "population", "los").groupBy("stratum").agg(F.sum("population").alias("s")).collect()}
    part = {r["stratum"]: r["s"] for r in out.groupBy("stratum").agg(F.sum("population").alias("s")).collect()}
    assert set(full) == set(part) and all(abs(full[k] - part[k]) < 1e-6 for k in full)


def test_samples_do_not_depend_on_partitioning(spark, rows):
    df = units(spark)
    a = sample.proportional_sample(df.repartition(11), "metro", "id", 200, 15, 1)
    b = sample.proportional_sample(df.coalesce(1), "metro", "id", 200, 15, 1)
    assert rows(a, "id", "w") == rows(b, "id", "w")
    sizes = {r["metro"]: (r["n"], r["w"]) for r in a.groupBy("metro").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    total = {r["metro"]: r["count"] for r in df.groupBy("metro").count().collect()}
    assert all(n >= min(15, total[m]) and abs(w - total[m]) < 1e-6 for m, (n, w) in sizes.items())


def test_unequal_sample_size_and_certainty_rows(spark):
    df = units(spark).withColumn("raw", F.when(F.col("id") == 5, 1e6).otherwise(F.sqrt("population")))
    rows, _ = sample.inclusion(df, "raw", 0.1)
    assert abs(rows.agg(F.sum("pi")).first()[0] - 90) < 1e-6
    out = sample.systematic_sample(rows.withColumn("one", F.lit(1.0)), ["metro"], "population", "id", "one", 0.4)
    assert 89 <= out.count() <= 91 and out.filter("id = 5").count() == 1


def test_big_groups_are_spread_over_folds(spark):
    f = sample.group_folds(units(spark), "metro", "population").select("metro", "fold").distinct().collect()
    assert len({r["metro"] for r in f}) == len(f)
    assert len({r["fold"] for r in f}) == 5


def test_holm_stops_at_the_first_failure(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.001)], "name string, p double")
    got = {r["name"]: r["significant"] for r in inference.holm(t, "name", "p").collect()}
    assert got == {"a": True, "d": True, "b": True, "c": True}
    t = spark.createDataFrame([("a", 0.03), ("b", 0.012), ("c", 0.04)], "name string, p double")
    assert not any(r["significant"] and r["name"] != "b" for r in inference.holm(t, "name", "p").collect())


def test_bootstrap_agrees_with_a_clear_and_a_null_difference(spark):
    rnd = random.Random(2)
    rows = [(run, u, 10.0 + rnd.random(), 10.0 + rnd.random() - run * 3, 20.0) for run in (0, 1) for u in range(60)]
    df = spark.createDataFrame(rows, "run int, u int, a double, b double, d double")
    got = {r["run"]: r["p_value"] for r in inference.paired_bootstrap(df, ["run"], "u", "a", "b", "d", replicates=400).collect()}
    assert got[1] == 0.0 and 0.01 < got[0] < 0.99


def test_bootstrap_weights_have_mean_one(spark):
    w = inference.bootstrap_weights(spark.range(60).withColumnRenamed("id", "k"), "k", 100)
    m = w.agg(F.avg("weight").alias("m"), F.var_samp("weight").alias("v")).first()
    assert abs(m["m"] - 1) < 0.05 and abs(m["v"] - 1) < 0.1
    e = inference.bootstrap_weights(spark.range(60).withColumnRenamed("id", "k"), "k", 100, "exponential").agg(F.avg("weight")).first()[0]
    assert abs(e - 1) < 0.05


def test_logistic_by_group_finds_the_planted_slope(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, a in enumerate((-2.0, -1.0, 0.5)):
        for _ in range(200):
            f = rng.uniform(0, 1)
            rows.append((g, float(f), float(rng.binomial(200, 1 / (1 + np.exp(-(a + 1.5 * f))))), 200.0))
    a, b = models.logistic_by_group(spark.createDataFrame(rows, "g int, f double, y double, n double"), "g", "f", "y", "n")
    got = {r["g"]: r["a"] for r in a.collect()}
    assert abs(b - 1.5) < 0.08 and all(abs(got[g] - v) < 0.08 for g, v in enumerate((-2.0, -1.0, 0.5)))
    slope = models.logistic_pooled(spark.createDataFrame([r for r in rows if r[0] == 1], "g int, f double, y double, n double"), ["f"], "y", "n")[1][0]
    assert abs(slope - 1.5) < 0.15


def test_non_negative_effects(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (300, 3))
    y = 0.1 + x @ np.array([0.5, 0.0, 0.2]) - 0.3 * x[:, 1]
    df = spark.createDataFrame([(int(i % 9), *map(float, r), float(v), 1.0) for i, (r, v) in enumerate(zip(x, y))], "m int, a double, b double, c double, y double, w double")
    got = {r["feature"]: r["effect"] for r in models.band_effects(df, "m", ["a", "b", "c"], "y", "w", replicates=5).collect()}
    assert abs(got["a"] - 0.5) < 0.1 and got["b"] == 0.0 and all(v >= 0 for v in got.values())


def test_curve_search_moves_towards_the_planted_decay(spark):
    from stopfield.functions.curves import DEFAULT
    from stopfield.operators.score import rescore

    items = spark.createDataFrame([(i, 1, float(100 * i)) for i in range(1, 15)], "cell int, station int, dist double")
    profiles = spark.createDataFrame([(1, 0, "bus", 10.0, 20.0)], "station int, slot int, mode string, h double, v double")
    truth = rescore(items, profiles, {"t": DEFAULT.with_(walk_power=2.1)}).select("cell", F.col("los").alias("t"))
    loss = lambda s: s.join(truth, "cell").groupBy("set").agg(F.avg(F.pow(F.col("los") - F.col("t"), F.lit(2))).alias("loss"))
    best, _ = models.search_curves(items, profiles, DEFAULT, {"walk_power": [0.4, 0.2]}, loss, rounds=2)
    assert abs(best.walk_power - 2.1) < 1e-9


def test_simplexes_find_a_planted_minimum_side_by_side():
    calls = []

    def valley(places):
        calls.append(len(places))
        return [100 * (y - x * x) ** 2 + (1 - x) ** 2 + (z + 2) ** 2 for x, y, z in places]

    runs = models.simplex_search(valley, [-1.0, 1.5, 0.0], starts=4, seed=3, tolerance=1e-10)
    assert len(runs) == 4 and all(v < 1e-6 for v, _ in runs)
    assert all(np.allclose(p, [1, 1, -2], atol=1e-2) for _, p in runs)
    assert calls[0] == 16 and max(calls[1:]) <= 4 * 7 and len(calls) < 400
    with pytest.raises(RuntimeError):
        models.simplex_search(valley, [-1.0, 1.5, 0.0], tolerance=1e-10, most_rounds=5)


def test_planted_curves_of_three_parameters_are_found(spark):
    rnd = random.Random(2)
    items = spark.createDataFrame([(c, s, float(rnd.randint(0, 2500))) for c in range(60) for s in rnd.sample(range(30), 3)], "cell int, station int, dist double").cache()
    profiles = spark.createDataFrame([(s, 0, ["bus", "tram", "rail"][s % 3], float(rnd.randint(2, 60)), float(rnd.randint(8, 50))) for s in range(30)], "station int, slot int, mode string, h double, v double").cache()
    truth = DEFAULT.with_(walk_power=2.2, walk_scale={**DEFAULT.walk_scale, "bus": 800.0}, mode={**DEFAULT.mode, "tram": 0.5})
    aim = rescore(items, profiles, {"truth": truth}).select("cell", F.col("los").alias("aim")).cache()
    loss = lambda scores: scores.join(aim, "cell").groupBy("set").agg(F.avg(F.pow(F.col("los") - F.col("aim"), F.lit(2))).alias("loss"))
    best, runs = models.fit_curves(items, profiles, DEFAULT, ["walk_power", "walk_scale:bus", "mode:tram"], loss, starts=2, spread=0.2, tolerance=1e-2)
    assert abs(best.walk_power - 2.2) < 0.2 and abs(best.walk_scale["bus"] - 800) < 120 and abs(best.mode["tram"] - 0.5) < 0.05
    assert min(v for v, _ in runs) < 0.05 and len(runs) == 2


def test_curve_search_scores_all_patterns_of_a_station(spark, tmp_path):
    import __spark_entry__ as contract

    # the station's three most frequent patterns are slow, the fourth has by far the best score
    lines = [(1, 1, 8.0, 1000.0), (2, 2, 8.0, 1000.0), (3, 3, 8.0, 1000.0), (5, 4, 9.0, 14000.0)]
    tables = {
        "nation": ([(0, 0)], "n_nationkey long, n_regionkey long"),
        "customer": ([(k, 0, 10.0, "A") for k in (1, 40)], "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "s", 0)], "s_suppkey long, s_name string, s_nationkey long"),
        "orders": ([(k, 1 if k < 5 else 40, 100.0, "F" if k in (1, 2, 5) else "O") for k in range(1, 8)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"),
        "lineitem": ([(o, p, 1, 1, q, x) for o, p, q, x in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    h, v = [2 + q for _, _, q, _ in lines], [x / 1000 / ((600 + 30 * q) / 3600) for _, _, q, x in lines]
    base = max(0.85 * np.interp(a, [2, 10, 30, 60], [1, 0.7, 0.3, 0.1]) * np.interp(b, [5, 20, 50], [0.2, 0.6, 1]) for a, b in zip(h, v))
    units = [((1 * 13 + 7) % 2500, 4, 2), ((40 * 13 + 7) % 2500, 3, 1)]  # distance, residents, votes
    loss = lambda power: sum(n * (base * (1 + d / 700) ** -power - dem / n) ** 2 for d, n, dem in units) / 7
    power = 1.5
    for half in (1, 2):
        tried = {"stay": power} | {f"walk_power:{sign * s / half:+.4f}": power * (1 + sign * s / half) for s in (0.4, 0.2) for sign in (1, -1)}
        power = min(tried.values(), key=loss)
    got = {r["set"]: (r.loss, r.walk_power) for r in contract.queries()["curve_parameter_search"](spark, str(tmp_path)).collect()}
    assert {s: x for s, (x, _) in got.items()} == pytest.approx({s: loss(p) for s, p in tried.items()}, abs=1e-6) and {p for _, p in got.values()} == {round(power, 6)}

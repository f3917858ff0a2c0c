import random

from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators import apportion, columns, rollup

RULES = {"population": "sum", "income_median": "mean"}


def cells(spark, n=300):
    rnd = random.Random(2)
    rows = [(rnd.uniform(0, 3), rnd.uniform(40, 42), float(rnd.randint(0, 50)), rnd.uniform(0, 100), None if rnd.random() < 0.2 else rnd.uniform(1, 9)) for _ in range(n)]
    df = spark.createDataFrame(rows, "lon double, lat double, population double, los double, income_median double").withColumn("jobs", F.lit(1.0))
    return df.withColumn("cell", grid.cell(F.col("lon"), F.col("lat"), 14)).drop("lon", "lat")


def test_roll_up_does_not_depend_on_partitions(spark, rows):
    df = cells(spark)
    a, b = rollup.roll_to_parent(df.repartition(9), 14, 9, RULES), rollup.roll_to_parent(df.coalesce(1), 14, 9, RULES)
    assert rows(a) == rows(b)


def test_totals_survive_every_level(spark):
    df = cells(spark)
    total = df.agg(F.sum("population")).first()[0]
    for r in rollup.roll_levels(df, 14, [12, 9, 6], RULES).groupBy("res").agg(F.sum("population").alias("s")).collect():
        assert abs(r["s"] - total) < 1e-6


def test_all_levels_equal_level_by_level(spark, rows):
    df = cells(spark)
    at_once = rollup.roll_levels(df, 14, [9], RULES).drop("res")
    assert rows(at_once, "cell", "los", "population", "income_median") == rows(rollup.roll_to_parent(df, 14, 9, RULES), "cell", "los", "population", "income_median")


def test_wide_tables_are_aggregated_in_blocks(spark):
    df = spark.range(20).select((F.col("id") % 3).alias("g"), *[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(120)], F.lit(1.0).alias("population"))
    out = rollup.roll(df, ["g"], {f"c{k}": "sum" for k in range(120)})
    assert len(out.columns) == 121 and out.count() == 3
    assert out.agg(F.sum("c7")).first()[0] == 7 * sum(range(20))


def test_three_tiers(spark):
    df = spark.createDataFrame([(1, 50.0, 0.0, 0.0), (1, 100.0, 0.0, 0.0), (2, 50.0, 0.0, 1.0), (2, 100.0, 0.0, 3.0), (3, 50.0, 9.0, 1.0), (3, None, 1.0, 3.0)], "g int, los double, p double, j double")
    got = {r["g"]: r["v"] for r in df.groupBy("g").agg(rollup.los_mean(F.col("los"), F.col("p"), F.col("j")).alias("v")).collect()}
    assert got == {1: 75.0, 2: 87.5, 3: 45.0}


def test_apportion_by_weight_and_equally(spark, rows):
    source = spark.createDataFrame([("a", 100.0), ("b", 40.0)], "bg string, labor double")
    members = spark.createDataFrame([(1, "a", 30.0), (2, "a", 10.0), (3, "b", 0.0), (4, "b", 0.0), (5, "z", 7.0)], "id int, bg string, population double")
    assert rows(apportion.apportion(members, source, "bg", "population", ["labor"]), "id", "labor") == [(1, 75.0), (2, 25.0), (3, 20.0), (4, 20.0), (5, None)]


def test_rake_is_clipped_then_the_whole_is_met(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 5.0)], "id int, c string, v double")
    control = spark.createDataFrame([("a", 20.0), ("b", 4.0)], "c string, v double")
    part = {r["id"]: r["v"] for r in apportion.rake(df, control, "c", ["v"], 1.0, 3.0, whole=False).collect()}
    assert part == {1: 3.0, 2: 3.0, 3: 5.0}
    assert abs(apportion.rake(df, control, "c", ["v"]).agg(F.sum("v")).first()[0] - 24.0) < 1e-9


def test_rescale_keeps_totals_and_reports_the_factor(spark):
    df = spark.createDataFrame([(1, 90.0, 5.0), (2, 10.0, 5.0), (3, 0.5, 0.0)], "cell int, population double, jobs double")
    keep = F.col("population") > 1
    f = apportion.rescale_factors(df, keep, {"people": "population"}).first()
    assert abs(f["factor"] - 100.5 / 100) < 1e-12 and not f["warning"]
    out = apportion.rescale(df, keep, {"people": ("population", ["population"])})
    assert abs(out.agg(F.sum("population")).first()[0] - 100.5) < 1e-9 and out.count() == 2


def test_left_fill_keeps_existing_columns(spark, rows):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "cell string, malePopulation double")
    layer = spark.createDataFrame([("a", 9.0, 3.0)], "cell string, malePopulation double, femalePopulation double")
    out = columns.attach(base, layer, "cell", "").na.fill(0.0)
    assert rows(out) == [("a", 1.0, 3.0), ("b", 2.0, 0.0)]


def test_party_totals_any_case(spark):
    df = spark.createDataFrame([("s", "DEMOCRAT", "10"), ("s", "republican", "5"), ("s", "Green", "5"), ("z", "x", "0")], "GEOID string, party string, votes string")
    out = rollup.party_totals(df, ["GEOID"], "party", "votes").collect()
    assert len(out) == 1 and out[0]["democrat_share"] == 0.5 and out[0]["other_share"] == 0.25


def test_rules_and_latest_period():
    assert columns.rule_of("acs5_income_median_household") == "mean" and columns.rule_of("population") == "sum" and columns.rule_of("transit_commute_share") == "mean"
    assert columns.latest_period(["rent_2016", "rent_2023", "GEOID", "elec_2019_share"]) == ["rent_2023", "GEOID", "elec_2019_share"]

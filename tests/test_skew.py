import random

import numpy as np
from pyspark.sql import functions as F

from stopfield.operators import skew


def hot(spark, n=6000):
    rnd = random.Random(5)
    return spark.createDataFrame(
        [(i, "hot" if i % 3 else f"g{i % 7}", float(rnd.choice([0, 0, 0, rnd.random() * 100])), float(rnd.randint(1, 9))) for i in range(n)],
        "id long, g string, v double, w double",
    )


def test_a_hot_key_is_split(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        rest = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.md5(F.col("id").cast("string")).alias("x")).repartition(8)
        small = spark.range(30_000).select(F.col("id").cast("string").alias("g"), F.lit(2).alias("t")).union(spark.sql("SELECT 'hot', 1"))
        out = skew.skewed_join(rest, small, ["g"], "inner")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("x")).collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 0.5 * 30_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_totals_match_a_window(spark, rows):
    df = hot(spark)
    got = skew.with_totals(df, ["g"], {"s": F.sum("w"), "n": F.count("*")})
    want = {r["g"]: (r["s"], r["n"]) for r in df.groupBy("g").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()}
    assert got.count() == 6000
    assert all((r["s"], r["n"]) == want[r["g"]] for r in got.select("g", "s", "n").collect())


def test_quantiles_match_numpy(spark):
    df = hot(spark)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in skew.exact_quantiles(df, ["g"], "v", probs).collect()}
    data = df.toPandas()
    for g, part in data.groupby("g"):
        for p in probs:
            assert abs(got[(g, p)] - np.quantile(part.v, p)) < 1e-9


def test_weighted_median_is_first_value_reaching_half(spark):
    df = hot(spark)
    got = {r["g"]: r["m"] for r in skew.weighted_quantiles(df, ["g"], "v", "w", {"m": 0.5}).collect()}
    for g, part in df.toPandas().groupby("g"):
        part = part.sort_values("v")
        cum = part.w.cumsum().to_numpy()
        assert got[g] == part.v.to_numpy()[np.searchsorted(cum, 0.5 * cum[-1])]


def test_negative_values_keep_their_order(spark):
    df = spark.createDataFrame([(float(v),) for v in (-5, -1e-9, 0, 1e-9, 3, -1000)], "v double")
    got = [r["value"] for r in skew.exact_quantiles(df, [], "v", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).orderBy("q").collect()]
    assert np.allclose(got, sorted([-5, -1e-9, 0, 1e-9, 3, -1000]), atol=0, rtol=1e-9)


def test_rank_puts_missing_last(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0), (4, 5.0)], "id int, v double")
    assert rows(skew.rank_within(df, [], "v", "p", descending=True), "id", "p") == [(1, 2), (2, 4), (3, 1), (4, 2)]


def test_running_sum_covers_everything_once(spark):
    df = hot(spark)
    out = skew.running_sum(df, ["g"], "v", "id", "w", "c").toPandas()
    assert len(out) == 6000 and abs(out.c.max() - out.w.sum()) < 1e-6
    # sorted by the running sum, the steps are the weights
    out = out.sort_values("c")
    assert np.allclose(np.diff(np.r_[0, out.c.to_numpy()]), out.w.to_numpy())
    assert out.g.is_monotonic_increasing


def test_running_ids_are_gapless_and_grouped(spark):
    out = skew.global_ids(hot(spark), "g", "id", "n").toPandas().sort_values("n")
    assert out.n.tolist() == list(range(6000)) and out.g.is_monotonic_increasing


def test_results_do_not_depend_on_partitioning(spark, rows):
    df = hot(spark, 900)
    a = skew.running_sum(df.repartition(7), ["g"], "v", "id", "w", "c")
    b = skew.running_sum(df.coalesce(1), ["g"], "v", "id", "w", "c")
    assert rows(a, "id", "c") == rows(b, "id", "c")


def test_buckets_follow_the_data(spark):
    """Narrow columns and long tails spread over many buckets of like size, and buckets keep the order."""
    base = spark.range(100_000)
    columns = {
        "rate": F.col("id") / 1e8, "second": F.lit(1_700_000_000.0) + F.col("id") % 86_400, "latitude": F.lit(41.3) + F.col("id") / 1e6, "count": F.col("id").cast("double"),
        "skewed": F.pow(F.lit(1.0002), F.col("id")), "outlier": F.when(F.col("id") == 7, 1e12).otherwise(F.exp(F.randn(3) * 2)), "pareto": F.pow(F.rand(5) + 1e-9, F.lit(-2.0)),
    }
    for name, value in columns.items():
        marked = skew.with_order_bucket(base.select(value.alias("v"), F.lit(1).alias("w")), "v", "w", "b").cache()
        sizes = marked.groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        assert len(sizes) >= 3_000 and max(r["n"] for r in sizes) < 100, (name, len(sizes), max(r["n"] for r in sizes))
        assert all(a["hi"] <= b["lo"] for a, b in zip(sizes, sizes[1:])), name
    same = base.select(F.lit(2.5).alias("v"), F.lit(1).alias("w"))
    assert skew.with_order_bucket(same, "v", "w", "b").select("b").distinct().count() == 1
    assert skew.with_order_bucket(same.filter("v < 0"), "v", "w", "b").count() == 0


def test_order_statistics_are_built_without_a_job(spark):
    from stopfield.operators import stats

    df = hot(spark)
    spark.sparkContext.setJobGroup("order-statistics", "none expected")
    try:
        plans = [skew.exact_quantiles(df, ["g"], "v", [0.5]), skew.weighted_quantiles(df, ["g"], "v", "w", {"m": 0.5}), skew.running_sum(df, ["g"], "v", "id", "w", "c"), skew.rank_within(df, ["g"], "v", "r"), stats.quantile_table(df, ["v", "w"])]
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("order-statistics") == []
        assert all(p.count() > 0 for p in plans)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

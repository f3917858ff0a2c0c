"""Samples that depend on seeded key digests only: the same rows under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.functions.hashing import bucket, uniform
from stopfield.functions.numeric import bin_of
from stopfield.operators.rollup import positive
from stopfield.operators.skew import exact_quantiles, running_sum, skewed_join, values_at, with_grand_totals, with_totals
from stopfield.operators.windows import top_k
from stopfield.session import cut_lineage

# Shares of the population quantiles and score edges that make the strata of the national sample.
POPULATION_SHARES = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 1.0)
SCORE_STEPS = (0.0001, *range(5, 100, 5))
# Edges of the outcome share that order the unequal-probability sample.
SHARE_STEPS = (1e-9, 0.01, 0.03, 0.08)


def sample_per_group(df: DataFrame, by: Sequence[str], key: str, size: Column, seed: int) -> DataFrame:
    """The rows with the smallest digests of every group, as many as ``size`` (a column of ``_total``, the group's rows) says.

    The digest of the last kept row is found by counting in buckets, so a group of any size is sampled without sorting it.
    """
    rows = df.withColumn("_u", uniform(F.col(key), seed))
    cut = values_at(rows, by, "_u", F.lit(1.0), [size]).select(*by, F.col("_value").alias("_cut"))
    joined = skewed_join(rows, cut, by, "inner") if by else rows.crossJoin(F.broadcast(cut))
    return joined.filter(F.col("_u") <= F.col("_cut")).select(*df.columns)


def population_stratum(df: DataFrame, population: str, score: str) -> DataFrame:
    """``stratum``: population bucket by quantiles x score bucket."""
    q = exact_quantiles(df, [], population, list(POPULATION_SHARES[1:-1]))
    edges = q.agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("_e"))
    rows = df.crossJoin(F.broadcast(edges))
    p = F.size(F.filter("_e", lambda e: F.col(population) > e["value"]))
    s = F.coalesce(F.col(score), F.lit(-1.0))
    # score edges are closed below: a score equal to an edge belongs to the bin the edge opens
    steps = sum((F.when(s >= float(e), 1).otherwise(0) for e in SCORE_STEPS), F.lit(0))
    return rows.withColumn("stratum", p * 100 + steps).drop("_e")


def stratified_sample(df: DataFrame, key: str, population: str, score: str, counts: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """A sample of about ``n`` inhabited rows, the same share of every stratum and at least one row, with counts scaled per stratum so that
    each stratum keeps its whole population. ``factor`` is rows per sampled row."""
    rows = population_stratum(df.filter(F.col(population) > 0), population, score)
    rows = with_grand_totals(rows, {"_all": F.count("*")}).withColumn("_frac", F.least(F.lit(float(n)), F.col("_all").cast("double")) / F.col("_all"))
    # the rows with their strata, and then the few sampled ones, are read several times: both are written once
    rows = cut_lineage(rows)
    picked = cut_lineage(sample_per_group(rows, ["stratum", "_frac"], key, F.greatest(F.lit(1.0), F.rint(F.col("_total") * F.col("_frac"))), seed))
    full = rows.groupBy("stratum").agg(F.sum(population).alias("_f"))
    part = picked.groupBy("stratum").agg(F.sum(population).alias("_s"))
    scale = full.join(part, "stratum").select("stratum", F.coalesce(F.col("_f") / positive(F.col("_s")), F.lit(1.0)).alias("_k"))
    out = skewed_join(picked, scale, ["stratum"], "inner")
    size = picked.agg(F.count("*").alias("_m"))
    out = out.crossJoin(F.broadcast(size))
    scaled = {c: F.col(c) * F.col("_k") for c in counts}
    return out.select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns], "stratum", (F.col("_all") / F.col("_m")).alias("factor"))


def informative_weights(df: DataFrame, key: str, informative: Column, one_in: int = 5, seed: int = 0) -> DataFrame:
    """Informative rows with weight 1; of the others one in ``one_in`` by the key's digest, standing for all of them."""
    keep = bucket(F.col(key), seed, one_in) == 0
    w = F.when(informative, 1.0).when(keep, float(one_in)).otherwise(0.0)
    return df.withColumn("w", w).filter(F.col("w") > 0)


def proportional_sample(df: DataFrame, by: str, key: str, n: int, least: int, seed: int) -> DataFrame:
    """Per group its share of ``n`` rows, at least ``least``; ``w`` = group size over sample size."""
    rows = with_totals(with_grand_totals(df, {"_all": F.count("*")}), [by], {"_n": F.count("*")})
    size = F.least(F.col("_n").cast("double"), F.greatest(F.lit(float(least)), F.rint(F.lit(float(n)) * F.col("_n") / F.col("_all"))))
    rows = rows.withColumn("_k", size)
    picked = sample_per_group(rows, [by, "_k"], key, F.col("_k"), seed)
    return picked.withColumn("w", F.col("_n") / F.col("_k")).select(*df.columns, "w")


def group_sample(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of every group with weight N / n; n is a small constant, so the top-K path keeps map output short."""
    picked = top_k(df.withColumn("_u", uniform(F.col(key), seed)), [by], [F.col("_u")], n).drop("_u")
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    out = skewed_join(picked, sizes, [by], "inner")
    return out.withColumn("w", F.col("_n") / F.least(F.col("_n"), F.lit(n))).select(*df.columns, "w")


def inclusion(df: DataFrame, raw: str, share: float) -> tuple[DataFrame, float]:
    """``pi`` = min(1, c x raw) with c such that the sum of pi is ``share`` of the rows.

    Rows that reach 1 leave the balance; each round is one aggregate of two numbers and the rounds end when no further row saturates. The table is
    read once: what the rounds read is its distinct values of ``raw`` with their counts, landed in the shared folder.
    """
    values = cut_lineage(df.groupBy(F.col(raw).alias("v")).agg(F.count("*").alias("n")))
    target = share * (values.agg(F.sum("n")).first()[0] or 0)
    c, certain = 0.0, -1
    while True:  # every round but the last one adds a row that saturates
        full = F.col("v") * c >= 1
        row = values.agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~full, F.col("v") * F.col("n"))), F.lit(0.0)).alias("s")).first()
        if row["n"] == certain or not row["s"] > 0:
            break
        certain = row["n"]
        c = (target - certain) / row["s"]
    return df.withColumn("pi", F.least(F.lit(1.0), F.col(raw) * c)), c


def systematic_sample(df: DataFrame, groups: Sequence[str], order: str, key: str, weight: str, start: float) -> DataFrame:
    """Rows at which the running sum of ``pi`` plus a start in [0, 1) passes an integer, and all rows of pi 1; ``w`` = weight / pi."""
    exact = df.withColumn("_pi", F.round(F.col("pi"), 12).cast("decimal(38,12)"))  # sums of decimals do not drift
    run = running_sum(exact, groups, order, key, "_pi", "_cum")
    after = F.col("_cum") + F.lit(start).cast("decimal(38,12)")
    hit = F.floor(after) > F.floor(after - F.col("_pi"))
    picked = run.filter(hit | (F.col("pi") >= 1))
    return picked.withColumn("w", F.col(weight) / F.col("pi")).drop("_cum", "_pi")


def share_bin(share: Column) -> Column:
    return bin_of(share, [e - 1e-15 for e in SHARE_STEPS])


def group_folds(df: DataFrame, group: str, size: str, k: int = 5, spread: int = 10, seed: int = 0) -> DataFrame:
    """Fold of every row by its group; the ``spread`` largest groups go round the folds so that no two of k neighbours share one."""
    groups = df.groupBy(group).agg(F.sum(size).alias("_s"))
    biggest = groups.orderBy(F.col("_s").desc(), group).limit(spread)
    ranked = biggest.agg(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), F.col(group).alias("g")))).alias("_l")).select(F.posexplode("_l").alias("_p", "_x"))
    top = ranked.select(F.col("_x.g").alias(group), (F.col("_p") % k).alias("_top"))
    folds = groups.join(F.broadcast(top), group, "left").select(group, F.coalesce("_top", bucket(F.col(group), seed, k)).alias("fold"))
    return skewed_join(df, folds, [group], "inner")

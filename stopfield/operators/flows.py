"""Origin-destination flows: commute times, the other end of the commute, per-level means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.functions.geo import haversine_km
from stopfield.operators.rollup import positive, weighted_mean
from stopfield.operators.skew import skewed_join, with_totals

# Midpoints in minutes of the twelve travel-time bins, and the range of a tract factor that is believed.
BIN_MINUTES = (2.5, 7.0, 12.0, 17.0, 22.0, 27.0, 32.0, 37.0, 42.0, 52.0, 74.5, 105.0)
TRACT_FACTOR = (0.5, 2.0)
# Minutes before a trip moves, km per minute, shortest and longest distance of a daily commute in km.
START_MINUTES, KM_PER_MINUTE, SHORTEST_KM, LONGEST_KM = 8.0, 0.5, 0.5, 80.0


def bin_mean(bins: Sequence[str], minutes: Sequence[float] = BIN_MINUTES) -> Column:
    zero = F.lit(0.0)
    n = sum((F.coalesce(b, zero) for b in bins), zero)
    top = sum((F.coalesce(b, zero) * F.lit(m) for b, m in zip(bins, minutes)), zero)
    return top / positive(n)


def commute_minutes(groups: DataFrame, tracts: DataFrame, bins: Sequence[str], total: str) -> DataFrame:
    """Mean commute time of block groups from their bins, rescaled to the tract's exact mean where the factor is believable.

    ``groups``: (geoid, bins, total); ``tracts``: (tract, tract_mean).
    """
    g = groups.withColumn("tract", F.substring("geoid", 1, 11)).withColumn("_m", bin_mean(bins))
    n = sum((F.coalesce(b, F.lit(0.0)) for b in bins), F.lit(0.0))
    mean = g.groupBy("tract").agg((F.sum(F.col("_m") * n) / positive(F.sum(total))).alias("_t")).join(tracts, "tract", "left")
    factor = F.col("tract_mean") / positive(F.col("_t"))
    mean = mean.select("tract", F.when((factor > TRACT_FACTOR[0]) & (factor < TRACT_FACTOR[1]), factor).alias("_f"))
    out = skewed_join(g, mean, ["tract"])
    return out.select("geoid", F.when(F.col(total) > 0, F.col("_m") * F.coalesce("_f", F.lit(1.0))).alias("minutes"))


def flow_times(flows: DataFrame, places: DataFrame, longest: float = LONGEST_KM) -> DataFrame:
    """Flows with distance and time: (h, w, n, km, t).

    A flow takes the start minutes plus its distance at a fixed speed, rescaled so that each origin keeps its residents' mean (``minutes``).
    ``places``: (id, lon, lat, minutes).
    """
    home = places.select(F.col("id").alias("h"), F.col("lon").alias("_hx"), F.col("lat").alias("_hy"), F.col("minutes").alias("_res"))
    work = places.select(F.col("id").alias("w"), F.col("lon").alias("_wx"), F.col("lat").alias("_wy"))
    both = skewed_join(skewed_join(flows, home, ["h"], "inner"), work, ["w"], "inner")
    both = both.withColumn("km", haversine_km(F.col("_hx"), F.col("_hy"), F.col("_wx"), F.col("_wy"))).filter(F.col("km") <= longest)
    both = both.withColumn("km", F.greatest("km", F.lit(SHORTEST_KM))).withColumn("_g", START_MINUTES + F.col("km") / KM_PER_MINUTE)
    mean = with_totals(both, ["h"], {"_bar": weighted_mean(F.col("_g"), F.col("n").cast("double"))})
    return mean.select("h", "w", "n", "km", (F.col("_res") * F.col("_g") / F.col("_bar")).alias("t"))


def flow_summary(times: DataFrame, end: str) -> DataFrame:
    """Per home ("h") or work ("w") place: workers, mean time and distance over its flows."""
    n = F.col("n").cast("double")
    return times.groupBy(end).agg(F.sum("n").alias("workers"), weighted_mean(F.col("t"), n).alias("minutes"), weighted_mean(F.col("km"), n).alias("km"))


def other_end(flows: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Mean value at the other end of the commute, both ways: (key, at_work, at_work_n, at_home, at_home_n).

    Flows whose far end has no value are left out of mean and weight.
    """
    v = values.select(F.col(key).alias("_k"), F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    out = []
    for here, there, name in (("h", "w", "at_work"), ("w", "h", "at_home")):
        far = skewed_join(flows.withColumn("_k", F.col(there)), v, ["_k"], "inner")
        out.append(far.groupBy(F.col(here).alias(key)).agg((F.sum(F.col("n") * F.col("_v")) / positive(F.sum("n"))).alias(name), F.sum("n").alias(f"{name}_n")))
    return out[0].join(out[1], key, "full_outer")


def by_level(table: DataFrame, level: Column, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Weighted means of (value, weight) columns by a coarser level."""
    return table.groupBy(level.alias("level")).agg(*[weighted_mean(F.col(v), F.col(w).cast("double")).alias(v) for v, w in pairs])


def tract_sum(df: DataFrame, geoid: str, value: str, name: str, digits: int = 11) -> DataFrame:
    """A tract figure that was spread over its block groups, put together again on every row; null when no part is known."""
    rows = df.withColumn("_t", F.substring(geoid, 1, digits))
    return with_totals(rows, ["_t"], {name: F.sum(value)}).drop("_t")


def group_speed(df: DataFrame, group: str, km: str, hours: Column, weight: str) -> DataFrame:
    """Weighted mean distance over weighted mean hours per group."""
    w = F.col(weight)
    return df.groupBy(group).agg((weighted_mean(F.col(km), w) / positive(weighted_mean(hours, w))).alias("kmh"))

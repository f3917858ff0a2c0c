"""Quality checks as jobs: each returns the rows that break a rule, so an empty result means a sound table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.operators.network import connected_cells

# Accepted relative and absolute gap of totals between levels, and of votes against their reference.
LEVEL_TOLERANCE, LEVEL_SLACK, VOTE_TOLERANCE = 0.002, 1.0, 1e-3


def level_totals(levels: Mapping[int, DataFrame], amounts: Sequence[str], los: str = "los") -> DataFrame:
    """One row per level: totals, rows without a score and scores outside 0-100; each level is aggregated once."""
    out = None
    for res, df in levels.items():
        row = df.agg(
            *[F.coalesce(F.sum(a), F.lit(0.0)).alias(a) for a in amounts],
            F.count_if(F.col(los).isNull()).alias("no_score"), F.count_if((F.col(los) < -1e-9) | (F.col(los) > 100 + 1e-6)).alias("out_of_range"),
        ).withColumn("res", F.lit(res))
        out = row if out is None else out.unionByName(row)
    return out


def level_problems(levels: Mapping[int, DataFrame], amounts: Sequence[str], los: str = "los") -> DataFrame:
    """(res, problem): levels whose totals differ from the finest one's, or with missing or impossible scores."""
    totals = level_totals(levels, amounts, los)
    finest = totals.filter(F.col("res") == max(levels)).select(*[F.col(a).alias(f"_f_{a}") for a in amounts])
    rows = totals.crossJoin(F.broadcast(finest))
    found = [F.when(F.col("no_score") > 0, F.concat(F.col("no_score").cast("string"), F.lit(" cells without score"))), F.when(F.col("out_of_range") > 0, F.lit("score outside 0-100"))]
    for a in amounts:
        gap = F.abs(F.col(a) - F.col(f"_f_{a}")) > LEVEL_TOLERANCE * F.abs(F.col(f"_f_{a}")) + LEVEL_SLACK
        found.append(F.when((F.col(f"_f_{a}") != 0) & gap, F.lit(f"{a} differs from the finest level")))
    return rows.select("res", F.explode(F.array_compact(F.array(*found))).alias("problem"))


def estimate_problems(df: DataFrame, census: str, estimates: Sequence[str], required: Sequence[str], tolerance: float = 0.002) -> DataFrame:
    """(column, problem): estimates whose total misses the census total, and required columns that are absent."""
    missing = [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("problem")) for c in [*estimates, *required] if c not in df.columns]
    present = [c for c in estimates if c in df.columns]
    off = [F.when(F.abs(F.sum(c) - F.sum(census)) > tolerance * F.sum(census), F.struct(F.lit(c).alias("column"), F.lit("total differs from the census").alias("problem"))) for c in present]
    return df.agg(F.array_compact(F.array(*off, *missing)).alias("_r")).select(F.inline("_r"))


def vote_check(levels: Mapping[str, DataFrame], region: str, votes: str, reference: DataFrame, loose: Sequence[str] = ()) -> DataFrame:
    """Per region the worst relative gap of any level's votes to the reference (a tenth for ``loose`` levels) and whether it passes."""
    sums = None
    for name, df in levels.items():
        s = df.groupBy(region).agg(F.sum(votes).alias("_v")).withColumn("_scale", F.lit(10.0 if name in loose else 1.0))
        sums = s if sums is None else sums.unionByName(s)
    gap = F.abs(F.col("_v") / F.when(F.col("reference") != 0, F.col("reference")) - 1) / F.col("_scale")
    worst = sums.join(reference.select(region, "reference"), region).groupBy(region).agg(F.max(gap).alias("worst"))
    return worst.withColumn("ok", F.col("worst") < VOTE_TOLERANCE)


def share_problems(df: DataFrame, shares: Sequence[str], prices: Sequence[str]) -> DataFrame:
    """(column, rows): shares outside 0-1 and negative prices, counted in one pass."""
    rules = [(c, (F.col(c) < 0) | (F.col(c) > 1)) for c in shares] + [(c, F.col(c) < 0) for c in prices]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(bad).alias("rows")) for c, bad in rules])
    return df.agg(rows.alias("_r")).select(F.inline("_r")).filter("rows > 0")


def schema_problems(df: DataFrame, expected: Sequence[str], prefix: str = "") -> DataFrame:
    """(column, problem): expected columns the table lacks or that miss the source's prefix."""
    have = set(df.columns)
    rows = [(c, "missing") for c in expected if c not in have] + [(c, "without prefix") for c in expected if c in have and not c.startswith(prefix)]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")


def underserved_patches(cells: DataFrame, res: int, density: float, score: float, least_people: float) -> DataFrame:
    """Touching dense cells with poor service that together hold enough people: (label, cells, population)."""
    poor = cells.filter((F.col("density") >= density) & (F.coalesce("los", F.lit(0.0)) <= score))
    labels = connected_cells(poor, res)
    sums = poor.join(labels, "cell").groupBy("label").agg(F.count("*").alias("cells"), F.sum("population").alias("population"))
    return sums.filter(F.col("population") >= least_people)

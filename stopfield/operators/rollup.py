"""Roll-ups over the grid, over code prefixes and over memberships: amounts are summed, averages weighted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.functions.grid import parent

BLOCK = 50


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def total(c: str | Column) -> Column:
    """Sum with missing values as nothing; an all-missing group gives 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted over the rows that have a value; null without weight."""
    w = F.when(value.isNotNull(), F.coalesce(weight, F.lit(0.0)))
    return F.sum(value * w) / positive(F.sum(w))


def los_mean(los: Column, population: Column, jobs: Column) -> Column:
    """Aggregate in three tiers: by residents, without residents by jobs, without both the plain mean; a missing score counts as 0."""
    zero = F.lit(0.0)
    s, p, j = F.coalesce(los, zero), F.coalesce(population, zero), F.coalesce(jobs, zero)
    return F.coalesce(F.sum(s * p) / positive(F.sum(p)), F.sum(s * j) / positive(F.sum(j)), F.avg(s))


def measure_aggregates(rules: Mapping[str, str], weight: str, fallback: str | None = None) -> list[Column]:
    """One aggregate per measure: "sum" adds, "mean" weights; ``fallback`` = "plain" or "zero" for means without weight."""
    out = []
    for name, rule in rules.items():
        if rule == "sum":
            out.append(total(name).alias(name))
            continue
        mean = weighted_mean(F.col(name), F.col(weight))
        if fallback == "plain":
            mean = F.coalesce(mean, F.avg(name))
        elif fallback == "zero":
            mean = F.coalesce(mean, F.lit(0.0))
        out.append(mean.alias(name))
    return out


def roll(
    df: DataFrame,
    by: Sequence[str],
    rules: Mapping[str, str],
    weight: str = "population",
    extra: Sequence[Column] = (),
    fallback: str | None = None,
) -> DataFrame:
    """One row per group. Wide tables are aggregated in blocks of columns so that the generated code stays small, then joined on the key."""
    aggregates = [*extra, *measure_aggregates(rules, weight, fallback)]
    blocks = [aggregates[i : i + BLOCK] for i in range(0, len(aggregates), BLOCK)]
    out = df.groupBy(*by).agg(*blocks[0])
    for block in blocks[1:]:
        out = out.join(df.groupBy(*by).agg(*block), list(by))
    return out


def roll_to_parent(df: DataFrame, res: int, to: int, rules: Mapping[str, str], los: str | None = "los", jobs: str = "jobs") -> DataFrame:
    """Cells to their ancestors at resolution ``to``; ``to`` equal to ``res`` merges duplicates of a border onto themselves."""
    up = df.withColumn("cell", parent(F.col("cell"), res, to))
    extra = [los_mean(F.col(los), F.col("population"), F.col(jobs)).alias(los)] if los else []
    return roll(up, ["cell"], rules, extra=extra)


def roll_levels(df: DataFrame, res: int, levels: Sequence[int], rules: Mapping[str, str], los: str = "los", jobs: str = "jobs") -> DataFrame:
    """All coarser levels in one pass: every row counts once per level through the grouping sets of one aggregate."""
    ups = df.withColumn(
        "_levels", F.array(*[F.struct(F.lit(r).alias("res"), parent(F.col("cell"), res, r).alias("cell")) for r in levels])
    )
    rows = ups.drop("cell").select("*", F.inline("_levels")).drop("_levels")
    return roll(rows, ["res", "cell"], rules, extra=[los_mean(F.col(los), F.col("population"), F.col(jobs)).alias(los)])


def coarse_from_children(children: DataFrame, coarse: DataFrame, res: int, to: int) -> DataFrame:
    """Score of coarse cells: sum of child score x residents over max(own residents, children's residents); the plain mean when that is 0,
    0 without children."""
    zero = F.lit(0.0)
    sums = children.withColumn("cell", parent(F.col("cell"), res, to)).groupBy("cell").agg(
        F.sum(F.coalesce(F.col("los"), zero) * F.coalesce(F.col("population"), zero)).alias("_lp"),
        F.sum("population").alias("_p"),
        F.avg(F.coalesce(F.col("los"), zero)).alias("_m"),
    )
    den = F.greatest(F.coalesce(F.col("population"), zero), F.coalesce(F.col("_p"), zero))
    score = F.coalesce(F.col("_lp") / positive(den), F.col("_m"), zero)
    return coarse.join(sums, "cell", "left").withColumn("los", score).drop("_lp", "_p", "_m")


def dissolve(df: DataFrame, levels: Sequence[str], rules: Mapping[str, str], weight: str = "population") -> DataFrame:
    """Every level of a hierarchy and the grand total in one pass; ``level`` counts how many keys are set."""
    aggregates = measure_aggregates(rules, weight)
    depth = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels[1:]), F.grouping(levels[0]).cast("int"))
    return df.rollup(*levels).agg(depth.alias("level"), F.count("*").alias("members"), *aggregates)


def roll_split(units: DataFrame, parts: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Units shared among the districts they overlap. ``parts`` has (unit, district, pop, n): people and points of the unit in the district.

    A unit is split by people, equally per point when it has none; means are weighted by the split residents.
    """
    sums = parts.groupBy("unit", "district").agg(F.sum("pop").alias("pop"), F.sum("n").alias("n"))
    whole = sums.groupBy("unit").agg(F.sum("pop").alias("_tp"), F.sum("n").alias("_tn"))
    split = sums.join(whole, "unit").withColumn("frac", F.coalesce(F.col("pop") / positive(F.col("_tp")), F.col("n") / F.col("_tn")))
    joined = split.select("unit", "district", "frac").join(units, "unit")
    zero = F.lit(0.0)
    people = F.coalesce(F.col("population"), zero) * F.col("frac")
    out = []
    for name, rule in rules.items():
        v = F.coalesce(F.col(name), zero)
        if rule == "sum":
            out.append(F.sum(v * F.col("frac")).alias(name))
        else:
            out.append(F.coalesce(F.sum(v * people) / positive(F.sum(people)), zero).alias(name))
    return joined.groupBy("district").agg(*out)


def state_row(df: DataFrame, rules: Mapping[str, str], exclude: str) -> DataFrame:
    """One row for a whole table without the columns a native source provides (name pattern ``exclude``)."""
    import re

    kept = {c: r for c, r in rules.items() if not re.search(exclude, c)}
    return df.agg(*measure_aggregates(kept, "population", "zero"))


def prefix_levels(df: DataFrame, code: str, lengths: Mapping[str, int], sums: Sequence[str]) -> DataFrame:
    """Sums at every level of a hierarchical code, from one pass over the rows with their own level pre-aggregated first."""
    longest = max(lengths.values())
    base = df.groupBy(F.substring(code, 1, longest).alias("_code")).agg(*[F.sum(c).alias(c) for c in sums])
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.substring("_code", 1, k).alias("code")) for n, k in lengths.items()])
    return base.select(*sums, F.inline(levels)).groupBy("level", "code").agg(*[F.sum(c).alias(c) for c in sums])


def party_totals(df: DataFrame, key: Sequence[str], party: str, votes: str) -> DataFrame:
    """Candidate rows to a total and party shares, party names in any case; other = what is left, not below 0."""
    v = F.coalesce(F.col(votes).try_cast("double"), F.lit(0.0))
    of = lambda p: F.sum(F.when(F.lower(party) == p, v).otherwise(0.0))
    out = df.groupBy(*key).agg(F.sum(v).alias("total_votes"), of("democrat").alias("_d"), of("republican").alias("_r"))
    out = out.filter(F.col("total_votes") > 0)
    d, r = F.col("_d") / F.col("total_votes"), F.col("_r") / F.col("total_votes")
    return out.select(
        *key,
        "total_votes",
        d.alias("democrat_share"),
        r.alias("republican_share"),
        F.greatest(1.0 - d - r, F.lit(0.0)).alias("other_share"),
    )

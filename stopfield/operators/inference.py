"""Resampling tests and skills on result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions.hashing import exponential, poisson_one
from stopfield.operators.skew import exact_quantiles, with_grand_totals

# Number of resamples and level of the tests.
RESAMPLES, ALPHA = 4000, 0.05


def bootstrap_weights(clusters: DataFrame, key: str, replicates: int, kind: str = "poisson", seed: int = 0) -> DataFrame:
    """(key, rep, weight): independent weights of mean 1 per cluster and replicate. Poisson weights stand for multinomial counts."""
    rows = clusters.select(key).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    mark = F.concat_ws("/", F.col(key).cast("string"), F.col("rep").cast("string"))
    draw = poisson_one(mark, seed) if kind == "poisson" else exponential(mark, seed)
    return rows.withColumn("weight", draw.cast("double"))


def paired_bootstrap(units: DataFrame, by: Sequence[str], unit: str, num_a: str, num_b: str, den: str, replicates: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Skill of b minus skill of a and the one-sided p of "b is not better", per ``by``, from paired weights over units."""
    rows = units.groupBy(*by, unit).agg(F.sum(num_a).alias("_a"), F.sum(num_b).alias("_b"), F.sum(den).alias("_d")).filter("_d <> 0")
    diff = rows.groupBy(*by).agg((F.sum(F.col("_a") - F.col("_b")) / F.sum("_d")).alias("difference"))
    weights = bootstrap_weights(rows, unit, replicates, seed=seed)
    sums = rows.join(weights, unit).groupBy(*by, "rep").agg(
        F.sum(F.col("weight") * (F.col("_a") - F.col("_b"))).alias("_n"), F.sum(F.col("weight") * F.col("_d")).alias("_dd"))
    ratio = F.try_divide("_n", "_dd")
    p = sums.groupBy(*by).agg(F.avg((F.coalesce(ratio, F.lit(0.0)) <= 0).cast("double")).alias("p_value"))
    return diff.join(p, list(by)) if by else diff.crossJoin(F.broadcast(p))


def holm(tests: DataFrame, name: str, p: str, alpha: float = ALPHA) -> DataFrame:
    """Step-down over one family: significant while every smaller p passed alpha / (m - rank). A family is a short list of tests."""
    ranked = with_grand_totals(tests, {"_m": F.count("*")})
    w = Window.orderBy(p, name)
    passed = F.col(p) < F.lit(alpha) / (F.col("_m") - F.row_number().over(w) + 1)
    step = ranked.withColumn("_ok", passed)
    return step.withColumn("significant", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok", "_m")


def skill(num: str | Column, den: str | Column) -> Column:
    """Aggregate: 1 - loss / reference loss."""
    d = F.sum(den)
    return 1 - F.sum(num) / F.when(d != 0, d)


def fold_skills(units: DataFrame, by: Sequence[str], fold: str, num: str, den: str) -> DataFrame:
    """Skill per fold and over all folds (null fold), in one pass."""
    sets = units.groupBy(*by, fold).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    both = sets.unionByName(sets.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d")).withColumn(fold, F.lit(None).cast(sets.schema[fold].dataType)))
    return both.select(*by, fold, (1 - F.col("_n") / F.when(F.col("_d") != 0, F.col("_d"))).alias("skill"))


def folds_better(skills: DataFrame, run: str, fold: str, reference: str) -> DataFrame:
    """Per run in how many folds it beats the reference run."""
    known = skills.filter(F.col(fold).isNotNull())
    base = known.filter(F.col(run) == reference).select(fold, F.col("skill").alias("_ref"))
    return known.join(base, fold).groupBy(run).agg(F.count_if(F.col("skill") > F.col("_ref")).alias("better"), F.count("*").alias("folds"))


def group_skills(units: DataFrame, by: str, num: str, den: str) -> tuple[DataFrame, DataFrame]:
    """Skill per group and the median over groups."""
    per = units.groupBy(by).agg(skill(num, den).alias("skill"))
    return per, exact_quantiles(per, [], "skill", [0.5]).select(F.col("value").alias("median_skill"))


def log_loss(hit: Column, p: Column, floor: float) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return -(hit * F.ln(q) + (1 - hit) * F.ln(1 - q))


def threshold_losses(rows: DataFrame, share: Column, weight: Column, thresholds: Sequence[float], probability, by: Sequence[str] = (), floor: float = 1e-6) -> DataFrame:
    """Per threshold the weighted log loss of P(share > threshold), the loss of the base rate and the skill: (threshold, loss, base, skill).

    ``probability(i)`` gives the predicted probability for the i-th threshold; all thresholds share one pass.
    """
    marked = rows.withColumn("_w", weight).withColumn("_s", share)
    aggs = []
    for i, th in enumerate(thresholds):
        hit = (F.col("_s") > F.lit(float(th))).cast("double")
        aggs += [F.sum(F.col("_w") * log_loss(hit, probability(i), floor)).alias(f"_l{i}"), F.sum(F.col("_w") * hit).alias(f"_h{i}")]
    wide = marked.groupBy(*by).agg(F.sum("_w").alias("_sw"), *aggs)
    pairs = F.array(*[F.struct(F.lit(float(th)).alias("threshold"), F.col(f"_l{i}").alias("_l"), F.col(f"_h{i}").alias("_h")) for i, th in enumerate(thresholds)])
    long = wide.select(*by, "_sw", F.inline(pairs))
    p0 = F.least(F.greatest(F.col("_h") / F.col("_sw"), F.lit(floor)), F.lit(1 - floor))
    base = -(p0 * F.ln(p0) + (1 - p0) * F.ln(1 - p0))
    loss = F.col("_l") / F.col("_sw")
    return long.select(*by, "threshold", loss.alias("loss"), base.alias("base"), (1 - loss / base).alias("skill"))


def ordinal_loss(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over thresholds of loss / base loss, every threshold counting equally."""
    return losses.groupBy(*by).agg(F.avg(F.col("loss") / F.col("base")).alias("ordinal_loss"))


def rank_controls(tests: DataFrame, name: str, alpha: float = ALPHA) -> DataFrame:
    """Controls by the skill lost when each is dropped, with their place and whether the loss is significant in the family of losses.

    ``tests``: (name, difference, p_value). Controls whose removal loses nothing are not in the family.
    """
    family = holm(tests.filter("difference > 0"), name, "p_value", alpha).select(name, "significant")
    ranked = tests.withColumn("place", F.row_number().over(Window.orderBy(F.col("difference").desc(), name)))
    return ranked.join(family, name, "left").withColumn("significant", F.coalesce("significant", F.lit(False)))


def smallest_set(sets: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The smallest top-k set that is not significantly worse: (k). ``sets``: (k, difference, p_value) of the full set over the top-k set."""
    fine = ~((F.col("difference") > 0) & (F.col("p_value") < alpha))
    return sets.filter(fine).agg(F.min("k").alias("k"))


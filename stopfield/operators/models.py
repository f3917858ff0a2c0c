"""Small models fitted on tables: every round is one aggregate over the rows, only sums of a fixed number come back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.functions.curves import ScoreCurves
from stopfield.operators.inference import bootstrap_weights
from stopfield.operators.score import SEARCHED_ALONE, best_stops, leading_walks, rescore, rescore_best, rescore_walks
from stopfield.operators.skew import skewed_join
from stopfield.operators.stats import weighted_moments
from stopfield.session import cut_lineage


def logistic_pooled(rows: DataFrame, features: Sequence[str], y: str, n: str, weight: str | None = None, rounds: int = 200) -> tuple[float, list[float]]:
    """Weighted binomial regression of y successes in n on features: (intercept, slopes). Raises if ``rounds`` steps do not converge."""
    w = F.col(n) * (F.lit(1.0) if weight is None else F.col(weight))
    ready = rows.filter(F.col(n) > 0).select(*features, (F.col(y) / F.col(n)).alias("_share"), w.alias("_w")).filter("_w > 0")
    vector = VectorAssembler(inputCols=list(features), outputCol="_x").transform(ready)
    fit = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_share", weightCol="_w", maxIter=rounds, tol=1e-10).fit(vector)
    if fit.summary.numIterations >= rounds:
        raise ArithmeticError(f"no fit after {rounds} steps")
    return float(fit.intercept), [float(v) for v in fit.coefficients]


# Fixed values of the rule: bounds of an intercept and of one step, and the slope change at which the fit ends.
INTERCEPTS, LONGEST_STEP, SLOPE_TOLERANCE = (-25.0, 5.0), 2.0, 1e-7
STEPS = 200
"""Newton steps after which a fit counts as failed. It raises then, as it does for data without a finite optimum."""


def logistic_by_group(rows: DataFrame, group: str, f: str, y: str, n: str, tolerance: float = SLOPE_TOLERANCE) -> tuple[DataFrame, float]:
    """One slope with an intercept per group: ((group, a), b), by joint Newton steps on the slope and all intercepts.

    Rows are summed once per (group, f). A step is one aggregate per group and one over the groups: the slope's step follows from the sums in
    which every group's intercept is already eliminated, then each intercept's from its own. Intercepts are written each step.
    """
    sums = rows.filter(F.col(n) > 0).groupBy(group, F.col(f).cast("double").alias("_f")).agg(F.sum(F.col(y).cast("double")).alias("_y"), F.sum(F.col(n).cast("double")).alias("_n"))
    data = cut_lineage(sums)
    total = data.agg(F.sum("_y").alias("y"), F.sum("_n").alias("n")).first()
    start = float(np.log((total["y"] + 0.5) / (total["n"] - total["y"] + 0.5)))
    a, b = data.select(group).distinct().withColumn("a", F.lit(start)), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + F.exp(-(F.col("a") + F.lit(b) * F.col("_f"))))
        spread = F.col("_n") * p * (1 - p)
        left = F.col("_y") - F.col("_n") * p
        joined = data.join(a, group).select(group, "a", "_f", left.alias("_r"), spread.alias("_w"))
        per = cut_lineage(joined.groupBy(group, "a").agg(
            F.sum("_r").alias("_r1"), F.sum("_w").alias("_w1"), F.sum(F.col("_w") * F.col("_f")).alias("_c1"), F.sum(F.col("_r") * F.col("_f")).alias("_g1"), F.sum(F.col("_w") * F.col("_f") * F.col("_f")).alias("_h1")))
        # a group without spread left (all or none succeed) has no part in the slope's step
        own = F.when(F.col("_w1") > 0, F.col("_c1") / F.col("_w1")).otherwise(0.0)
        whole = per.agg(F.sum(F.col("_g1") - own * F.col("_r1")).alias("g"), F.sum(F.col("_h1") - own * F.col("_c1")).alias("h")).first()
        change = whole["g"] / whole["h"] if whole["h"] and whole["h"] > 0 else 0.0
        change = max(-LONGEST_STEP, min(LONGEST_STEP, change))
        step = F.when(F.col("_w1") > 0, (F.col("_r1") - F.col("_c1") * F.lit(change)) / F.col("_w1")).otherwise(F.signum("_r1") * LONGEST_STEP)
        step = F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), step))
        moved = F.greatest(F.lit(INTERCEPTS[0]), F.least(F.lit(INTERCEPTS[1]), F.col("a") + step))
        a = per.select(group, moved.alias("a"), F.abs(moved - F.col("a")).alias("_d"))
        b += change
        farthest = a.agg(F.max("_d")).first()[0]
        a = a.select(group, "a")
        if abs(change) < tolerance and (farthest or 0.0) < max(tolerance, 1e-6):
            return a, b
    raise ArithmeticError(f"no fit after {STEPS} steps; the last one moved the slope by {change:g}")


def two_part(score: Column, trials: Column, alphas: Sequence[float], slope: float, any_part: tuple[float, float, float]) -> tuple[list[Column], Column]:
    """P(share > threshold k) and P(any): the ordinal probabilities times the probability of any success.

    ``any_part`` = (intercept, coefficient of ln trials, coefficient of the score).
    """
    a0, a1, b = any_part
    sig = lambda x: 1 / (1 + F.exp(-x))
    chance = sig(F.lit(a0) + F.lit(a1) * F.ln(F.greatest(trials, F.lit(1.0))) + F.lit(b) * score)
    return [sig(F.lit(a) + F.lit(slope) * score) * chance for a in alphas], chance


def search_curves(
    items: DataFrame, profiles: DataFrame, start: ScoreCurves, moves: Mapping[str, Sequence[float]], loss, rounds: int = 3, by: Sequence[str] = ()
) -> tuple[ScoreCurves, DataFrame]:
    """Curve parameters with the smallest loss, from coordinate steps that are halved every round; ``rounds`` is the resolution of the search
    (relative steps down to the first ones / 2^(rounds - 1)), not a limit of an iteration.

    ``moves``: parameter -> relative steps; every round scores all candidates of the round in one job. ``loss(scores)`` takes (cell, by, set, los)
    and returns (set, loss). Returns the best curves and the losses of the last round. Walks and patterns are written once and read by every round;
    where only the walk is searched, the best stop score of a station and mode is the same for all candidates and stands for all its patterns.
    """
    items, one_score = cut_lineage(items.select("cell", "station", "dist", *by)), set(moves) <= {"walk_power"}
    profiles = cut_lineage(best_stops(profiles, [start]).select("station", "mode", "_s0") if one_score else profiles)
    best, table = start, None
    for r in range(rounds):
        sets = {"stay": best}
        for name, steps in moves.items():
            for s in steps:
                for sign in (1, -1):
                    value = getattr(best, name) * (1 + sign * s / 2**r)
                    sets[f"{name}:{sign * s / 2**r:+.4f}"] = best.with_(**{name: value})
        if one_score:
            scores = rescore_best(items, profiles.select("station", "mode", *[F.col("_s0").alias(f"_s{i}") for i in range(len(sets))]), sets, by)
        else:
            scores = rescore(items, profiles, sets, by)
        table = cut_lineage(loss(scores))
        # one row per candidate of the round: a list as long as the moves
        ranked = table.groupBy("set").agg(F.sum("loss").alias("loss")).orderBy("loss", "set").limit(1).collect()
        best = sets[ranked[0]["set"]]
    return best, table


# Fixed values of the simplex: reflection, expansion, contractions and shrinking.
_STEPS = (1.0, 2.0, 0.5, -0.5)
_SHRINK = 0.5


def simplex_search(
    evaluate: Callable[[list[np.ndarray]], Sequence[float]], start: Sequence[float], starts: int = 1, spread: float = 0.8, seed: int = 0,
    first_step: float = 0.25, tolerance: float = 1e-6, most_rounds: int = 1000,
) -> list[tuple[float, np.ndarray]]:
    """Minima found from ``starts`` simplexes moved side by side: (value, place) of each start, the given one first.

    Other starts move every number by a normal step of deviation ``spread``. Each round asks for all places that any simplex may go to (reflected,
    expanded, contracted twice, and shrunk) as one table of candidates, so a round is one call of ``evaluate`` whatever the number of starts. A
    simplex is done when its values and corners agree within ``tolerance``; the search raises if one never is.
    """
    d, rng = len(start), np.random.default_rng(seed)
    origins = [np.asarray(start, float)] + [np.asarray(start, float) + rng.normal(0, spread, d) for _ in range(starts - 1)]
    corners = [np.vstack([o, o + first_step * np.eye(d)]) for o in origins]
    flat = list(evaluate([c for simplex in corners for c in simplex]))
    values = [np.array(flat[i * (d + 1) : (i + 1) * (d + 1)], float) for i in range(starts)]

    def done(i: int) -> bool:
        return values[i].max() - values[i].min() <= tolerance and np.abs(corners[i] - corners[i][0]).max() <= max(tolerance, 1e-9) ** 0.5

    for _ in range(most_rounds):
        moving = [i for i in range(starts) if not done(i)]
        if not moving:
            break
        asked: list[np.ndarray] = []
        for i in moving:
            order = np.argsort(values[i], kind="stable")
            corners[i], values[i] = corners[i][order], values[i][order]
            middle, worst = corners[i][:-1].mean(axis=0), corners[i][-1]
            asked += [middle + s * (middle - worst) for s in _STEPS] + [corners[i][0] + _SHRINK * (c - corners[i][0]) for c in corners[i][1:]]
        found = np.asarray(evaluate(asked), float)
        width = len(_STEPS) + d
        for k, i in enumerate(moving):
            places, got = asked[k * width : (k + 1) * width], found[k * width : (k + 1) * width]
            reflected, expanded, outside, inside = got[:4]
            if reflected < values[i][0]:
                take = 1 if expanded < reflected else 0
            elif reflected < values[i][-2]:
                take = 0
            elif reflected < values[i][-1] and outside <= reflected:
                take = 2
            elif inside < values[i][-1]:
                take = 3
            else:
                corners[i][1:], values[i][1:] = places[4:], got[4:]
                continue
            corners[i][-1], values[i][-1] = places[take], got[take]
    else:
        raise RuntimeError(f"simplexes {[i for i in range(starts) if not done(i)]} did not settle in {most_rounds} rounds")
    best = [int(np.argmin(v)) for v in values]
    return [(float(values[i][b]), corners[i][b].copy()) for i, b in enumerate(best)]


def fit_curves(
    items: DataFrame, profiles: DataFrame, start: ScoreCurves, names: Sequence[str], loss, starts: int = 1, spread: float = 0.8, seed: int = 0, tolerance: float = 1e-6
) -> tuple[ScoreCurves, list[tuple[float, dict[str, float]]]]:
    """Score curves of the least loss over several positive parameters at once, from several starts: the best curves, and loss and values by start.

    ``names`` are parameters of ``ScoreCurves``, ``mode:bus`` one of its tables; they are searched by their logarithms. ``loss`` is that of
    ``search_curves``. A round scores all candidates of all starts in one job; only one number a candidate comes back. Where no parameter of headways,
    speeds or weights is searched, walks that can be best under no candidate are left out once, and the others lie by cell for all rounds.
    """

    def value(curves: ScoreCurves, name: str) -> float:
        table, _, key = name.partition(":")
        return getattr(curves, table)[key] if key else getattr(curves, table)

    def curves_at(place: np.ndarray) -> ScoreCurves:
        out = start
        for name, v in zip(names, np.exp(place)):
            table, _, key = name.partition(":")
            out = out.with_(**{table: {**getattr(out, table), key: float(v)} if key else float(v)})
        return out

    falling = start.walk_power > 0 and min(start.walk_scale.values()) > 0 and min(start.mode.values()) >= 0
    if falling and {n.partition(":")[0] for n in names} <= SEARCHED_ALONE:
        walks = cut_lineage(leading_walks(items, profiles, start))  # read by every round
        score = lambda sets: rescore_walks(walks, sets)
    else:
        items, profiles = cut_lineage(items), cut_lineage(profiles)
        score = lambda sets: rescore(items, profiles, sets)

    def evaluate(places: list[np.ndarray]) -> list[float]:
        table = loss(score({f"{i:05d}": curves_at(p) for i, p in enumerate(places)}))
        return [r["loss"] for r in table.groupBy("set").agg(F.sum("loss").alias("loss")).orderBy("set").collect()]

    runs = simplex_search(evaluate, [np.log(value(start, n)) for n in names], starts, spread, seed, tolerance=tolerance)
    best = min(runs, key=lambda r: r[0])
    return curves_at(best[1]), [(v, {n: float(x) for n, x in zip(names, np.exp(p))}) for v, p in runs]


def best_set_per_group(losses: DataFrame, group: str, national: str) -> DataFrame:
    """Per group its own best parameter set next to the national one: (group, best, best_loss, national_loss)."""
    best = losses.groupBy(group).agg(F.min(F.struct("loss", "set")).alias("_b"), F.max(F.when(F.col("set") == national, F.col("loss"))).alias("national_loss"))
    return best.select(group, F.col("_b.set").alias("best"), F.col("_b.loss").alias("best_loss"), "national_loss")


def _matrix(moments, columns: Sequence[str]) -> np.ndarray:
    """Cross moments of one aggregated row as a small square matrix."""
    k = len(columns)
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = moments[f"c_{i}_{j}"]
    return m


def inflation_factors(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """Variance inflation factor of every column from the weighted correlation matrix, whose size is the number of columns squared."""
    c = _matrix(weighted_moments(df, columns, weight).first(), columns)
    sd = np.sqrt(np.diag(c))
    inverse = np.linalg.inv(c / np.outer(sd, sd))
    return df.sparkSession.createDataFrame([(n, float(inverse[i, i])) for i, n in enumerate(columns)], "column string, vif double")


def mediation(df: DataFrame, outcome: str, mediator: str, controls: Sequence[str], weight: str) -> DataFrame:
    """Weighted least squares of the outcome on controls with and without the mediator: its coefficient and both r2, from one set of moments."""
    columns = [outcome, mediator, *controls]
    c = _matrix(weighted_moments(df, columns, weight).first(), columns)

    def fit(idx):
        coef = np.linalg.solve(c[np.ix_(idx, idx)], c[idx, 0])
        return coef, float(coef @ c[idx, 0] / c[0, 0])

    full, r2 = fit(list(range(1, len(columns))))
    r2_controls = fit(list(range(2, len(columns))))[1] if controls else 0.0
    return df.sparkSession.createDataFrame([(float(full[0]), r2, r2_controls)], "coefficient double, r2_with double, r2_controls double")


def non_negative(gram: np.ndarray, target: np.ndarray, sweeps: int = 100_000) -> np.ndarray:
    """Non-negative least squares from its normal equations by coordinate steps. Raises if the sweeps do not settle."""
    x = np.zeros(len(target))
    for _ in range(sweeps):
        before = x.copy()
        for i in range(len(x)):
            if gram[i, i] > 0:
                x[i] = max(0.0, x[i] + (target[i] - gram[i] @ x) / gram[i, i])
        if np.abs(x - before).max() <= 1e-12 * max(1.0, np.abs(x).max()):
            return x
    raise ArithmeticError("the non-negative fit does not settle")


def band_effects(units: DataFrame, cluster: str, features: Sequence[str], outcome: str, weight: str, replicates: int = 30, seed: int = 0) -> DataFrame:
    """Non-negative effect of every feature on the outcome with its spread over resampled clusters: (feature, effect, sd).

    Sums of products are taken per cluster, weighted per replicate and added up in Spark; only one small system per replicate comes back.
    """
    cols = ["_one", *features]
    rows = units.withColumn("_one", F.lit(1.0))
    w = F.col(weight)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = [F.sum(w * F.col(cols[i]) * F.col(cols[j])).alias(f"g_{i}_{j}") for i, j in pairs] + [F.sum(w * F.col(c) * F.col(outcome)).alias(f"t_{i}") for i, c in enumerate(cols)]
    per = rows.groupBy(cluster).agg(*sums)
    names = [f"g_{i}_{j}" for i, j in pairs] + [f"t_{i}" for i in range(len(cols))]
    draws = bootstrap_weights(per, cluster, replicates, seed=seed).unionByName(per.select(cluster, F.lit(-1).alias("rep"), F.lit(1.0).alias("weight")))
    systems = per.join(draws, cluster).groupBy("rep").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names]).collect()
    solved = {}
    for s in systems:
        g = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            g[i, j] = g[j, i] = s[f"g_{i}_{j}"]
        solved[s["rep"]] = non_negative(g, np.array([s[f"t_{i}"] for i in range(len(cols))]))
    spread = np.std([v for r, v in sorted(solved.items()) if r >= 0], axis=0)
    table = [(c if c != "_one" else "baseline", float(solved[-1][i]), float(spread[i])) for i, c in enumerate(cols)]
    return units.sparkSession.createDataFrame(table, "feature string, effect double, sd double")

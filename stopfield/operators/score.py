"""Stop scores, cell scores and what is computed from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions.curves import DEFAULT, ScoreCurves
from stopfield.operators.gtfs import DAY_WINDOW, headways
from stopfield.operators.rollup import positive, weighted_mean
from stopfield.operators.skew import first_row, skewed_join, weighted_quantiles, with_totals
from stopfield.operators.windows import top_k
from stopfield.session import cut_lineage

# The mode tiers, most inclusive first, and the width of a speed step in km/h.
TIERS = (("bus", ("bus", "tram", "rail")), ("tram", ("tram", "rail")), ("rail", ("rail",)))
SPEED_STEP = 2.0
# Best headway within 400 m gives the service class 0 (no stop) to 4 (under 15 minutes).
CLASS_RADIUS = 400.0


def combined_headway(rows: DataFrame, by: Sequence[str], direction: str, headway: str) -> DataFrame:
    """Headways of one direction add up as rates; the better direction counts. Missing or non-positive ones are skipped."""
    good = rows.filter(F.col(headway) > 0)
    each = good.groupBy(*by, direction).agg(F.try_divide(F.lit(1.0), F.sum(F.try_divide(F.lit(1.0), F.col(headway)))).alias("_h"))
    return each.groupBy(*by).agg(F.min("_h").alias("headway"))


def combined_speed(distance: Column, time: Column) -> Column:
    """Aggregate: km/h of all distance over all time, over the rows that know both."""
    known = distance.isNotNull() & (time > 0)
    d, t = F.sum(F.when(known, distance)), F.sum(F.when(known, time))
    return (d / 1000) / positive(t / 3600)


def best_subset(route_headways: DataFrame, speeds: DataFrame | None = None, curves: ScoreCurves = DEFAULT) -> DataFrame:
    """Best combination of a mode tier and a minimum route speed for every station.

    ``route_headways``: (station, route, direction, headway); ``speeds``: (station, route, mode, distance, time), one row per route. Without
    ``speeds``, ``route_headways`` has the three too: the route's mode, and distances and times that add up to the route's. Cut-offs are the
    tier's route speeds floored to 2 km/h; routes at or above the cut-off, and those of unknown speed, are kept.
    Equal scores go to the first tier, then the lowest cut-off; stations without a valid combination are absent.

    The rows are dealt out by station once, and all that follows runs where they are. All cut-offs of a tier are scored together, by sums
    that run from the fastest step down: a busy station costs its rows, not one per pair of route and cut-off.
    """
    rows = _services(route_headways) if speeds is None else _routes_and_headways(route_headways, speeds)
    tiers = F.array(*[F.struct(F.lit(i).alias("ti"), F.lit(n).alias("tier"), F.array(*[F.lit(m) for m in ms]).alias("ms")) for i, (n, ms) in enumerate(TIERS)])
    rows = rows.withColumn("_t", F.explode(F.filter(tiers, lambda x: F.array_contains(x["ms"], F.col("mode"))))).select(
        "station", "direction", "step", "d", "t", "rate", "route_id", F.col("_t.ti").alias("ti"), F.col("_t.tier").alias("tier")
    )
    # null first: routes of unknown speed count at all cut-offs. Equal steps are peers in these windows, so each row has the sums of its cut-off
    down = F.col("step").desc_nulls_first()
    rows = rows.withColumn("_r", F.sum("rate").over(Window.partitionBy("station", "ti", "direction").orderBy(down)))
    # a direction's rate grows as the cut-off falls: the best headway of all rows so far is the best of the directions at the cut-off
    faster = Window.partitionBy("station", "ti").orderBy(down)
    rows = rows.select(
        "station", "ti", "tier", "step", "route_id", ((F.sum("d").over(faster) / 1000) / positive(F.sum("t").over(faster) / 3600)).alias("speed"),
        F.min(F.when(F.col("_r") > 0, F.try_divide(F.lit(1.0), F.col("_r")))).over(faster).alias("headway"),
    )
    fields = {
        "headway": F.col("headway"), "speed": F.col("speed"), "min_speed": F.col("step"), "mode_score": curves.mode_score(F.col("tier")),
        "speed_score": curves.speed_score(F.col("speed")), "frequency_score": curves.headway_score(F.col("headway")),
        "score": curves.stop_score(F.col("tier"), F.col("headway"), F.col("speed")),
    }
    scored = F.struct((-fields["score"]).alias("o"), "ti", F.col("step").alias("at"), "tier", *[c.alias(n) for n, c in fields.items()])
    valid = F.col("step").isNotNull() & F.col("speed").isNotNull() & F.col("headway").isNotNull()
    rows = rows.withColumn("_best", F.min(F.when(valid, scored)).over(Window.partitionBy("station")))
    kept = rows.filter((F.col("ti") == F.col("_best.ti")) & (F.col("step").isNull() | (F.col("step") >= F.col("_best.min_speed"))))
    out = kept.groupBy("station").agg(F.first("_best").alias("_best"), F.sort_array(F.collect_list("route_id")).alias("route_ids"))
    return out.select("station", "_best.tier", *[f"_best.{n}" for n in fields], "route_ids")


def _speed_step(distance: Column, time: Column) -> Column:
    return F.floor((distance / 1000.0) / (time / 3600.0) / SPEED_STEP) * SPEED_STEP


def _services(services: DataFrame) -> DataFrame:
    """The rows of ``best_subset`` by station: mode and speed step of the route, direction, distance, time and rate of the row; the first row of a
    route names it. Distance, time and step are null where the route's speed is unknown, the rate where the headway is not positive."""
    route = Window.partitionBy("station", "route")
    dealt = services.filter(F.col("station").isNotNull()).repartition("station").withColumns(
        {"_d": F.sum("distance").over(route), "_t": F.sum("time").over(route), "_n": F.row_number().over(route.orderBy("direction"))}
    )
    known = F.col("_d").isNotNull() & (F.col("_t") > 0)
    return dealt.select(
        "station", "direction", F.coalesce("mode", F.lit("bus")).alias("mode"), F.when(known, _speed_step(F.col("_d"), F.col("_t"))).alias("step"),
        F.when(known, F.col("distance")).alias("d"), F.when(known, F.col("time")).alias("t"),
        F.when(F.col("route").isNotNull() & (F.col("headway") > 0), F.try_divide(F.lit(1.0), F.col("headway"))).alias("rate"),
        F.when(F.col("_n") == 1, F.col("route").cast("string")).alias("route_id"),
    )


def _routes_and_headways(route_headways: DataFrame, speeds: DataFrame) -> DataFrame:
    """``_services`` of two tables: a row for each route with its distance and time, and a row for each headway of a route with its rate."""
    known = F.col("distance").isNotNull() & (F.col("time") > 0)
    routes = speeds.filter(F.col("station").isNotNull()).select(
        "station", "route", F.coalesce("mode", F.lit("bus")).alias("mode"), F.when(known, _speed_step(F.col("distance"), F.col("time"))).alias("step"),
        F.when(known, F.col("distance")).alias("d"), F.when(known, F.col("time")).alias("t"),
    )
    # a (station, route) pair has a row per direction at most, so the pairs need no salt
    rated = route_headways.filter("headway > 0").join(routes.select("station", "route", "mode", "step"), ["station", "route"])
    rates = rated.select("station", "direction", "mode", "step", F.try_divide(F.lit(1.0), F.col("headway")).alias("rate"))
    named = routes.select("station", "mode", "step", "d", "t", F.col("route").cast("string").alias("route_id"))
    return rates.unionByName(named, allowMissingColumns=True).repartition("station")


def pattern_slots(patterns: DataFrame, order: Sequence[Column], slots: int) -> DataFrame:
    """At most ``slots`` patterns per station, numbered from 0."""
    return top_k(patterns, ["station"], order, slots, slot="slot")


def item_values(items: DataFrame, profiles: DataFrame, curves: ScoreCurves = DEFAULT) -> DataFrame:
    """Walks joined to the patterns of their station, each with its value (score x walk decay)."""
    rows = skewed_join(items, profiles.select("station", "slot", "mode", "h", "v"), ["station"], "inner")
    return rows.withColumn("value", curves.value(F.col("dist"), F.col("mode"), F.col("h"), F.col("v")))


def cell_scores(values: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Best value of every cell times 100, with the station and slot that give it (nearest, then smallest id on ties).

    The best value is an aggregate of its own: where only ``los`` is read the winner is pruned and nothing is sorted.
    """
    best = F.max(F.struct("value", (-F.col("dist")).alias("near"), (-F.col("station")).alias("st"), (-F.col("slot")).alias("sl")))
    out = values.groupBy("cell", *keep).agg(F.max("value").alias("_v"), best.alias("_b"))
    return out.select("cell", *keep, (100 * F.col("_v")).alias("los"), (-F.col("_b.st")).alias("station"), (-F.col("_b.sl")).alias("slot"))


def mode_aggregates(values: DataFrame) -> DataFrame:
    """Per cell and mode: the best item, the sum of all, and the best fully with the others half."""
    v = F.col("value")
    return values.groupBy("cell", "mode").agg(F.max(v).alias("best"), F.sum(v).alias("sum"), (0.5 * (F.sum(v) + F.max(v))).alias("half_sum"))


def mode_columns(values: DataFrame, keep: Sequence[str], modes: Sequence[str] = ("bus", "tram", "rail")) -> DataFrame:
    """Per cell the best over all modes and per mode (0 where it has none)."""
    zero = F.lit(0.0)
    best = lambda m: F.coalesce(F.max(F.when(F.col("mode") == m, F.col("value"))), zero)
    return values.groupBy("cell", *keep).agg(F.max("value").alias("any"), *[best(m).alias(m) for m in modes])


def unit_access(cells: DataFrame, unit: str, columns: Sequence[str], weight: str, census: DataFrame | None = None) -> DataFrame:
    """Weighted mean of cell scores per unit. With a census table (unit, total) people in no cell count as 0."""
    sums = cells.groupBy(unit).agg(*[F.sum(F.col(weight) * F.col(c)).alias(c) for c in columns], F.sum(weight).alias("_w"))
    if census is None:
        return sums.select(unit, *[(F.col(c) / positive(F.col("_w"))).alias(c) for c in columns])
    rows = census.join(sums, unit, "left")
    return rows.select(unit, *[(F.coalesce(c, F.lit(0.0)) / positive(F.col("total"))).alias(c) for c in columns])


def destination_access(cells: DataFrame, flows: DataFrame, unit: str, score: str) -> DataFrame:
    """Job-weighted access of every work unit, carried to the home units by their commuters. ``flows``: (h, w, n)."""
    work = unit_access(cells, unit, [score], "jobs").select(F.col(unit).alias("w"), F.col(score).alias("_a"))
    joined = skewed_join(flows, work, ["w"], "inner")
    return joined.groupBy("h").agg(weighted_mean(F.col("_a"), F.col("n").cast("double")).alias("destination"))


def scaled_scores(cells: DataFrame, score: str, weight: str, share: float = 0.95) -> DataFrame:
    """100 x score over its weighted 95th percentile, at most 100. The cells are written once: the percentile and the rows both read them."""
    cells = cut_lineage(cells)
    top = weighted_quantiles(cells, [], score, weight, {"_p": share})
    return cells.crossJoin(F.broadcast(top)).withColumn("scaled", F.least(100 * F.col(score) / positive(F.col("_p")), F.lit(100.0))).drop("_p")


def scaled_summary(scaled: DataFrame, score: str, weight: str) -> DataFrame:
    w = F.col(weight)
    return scaled.agg(weighted_mean(F.col("scaled"), w).alias("mean"), (F.sum(F.when(F.col(score) <= 0, w).otherwise(0.0)) / positive(F.sum(w))).alias("zero_share"))


def best_stops(patterns: DataFrame, curves: Sequence[ScoreCurves]) -> DataFrame:
    """Per station and mode the best stop score under each set of curves (``_s0``, ``_s1``, ...), the shortest headway and the top speed.

    A walk decays alike for all patterns of a station and mode, so the best of them is known before walks meet it: one row per walk and mode.
    """
    score = lambda c: F.max(c.stop_score(F.col("mode"), F.col("h"), F.col("v")))
    return patterns.groupBy("station", "mode").agg(F.min("h").alias("h"), F.max("v").alias("v"), *[score(c).alias(f"_s{i}") for i, c in enumerate(curves)])


def rescore(items: DataFrame, profiles: DataFrame, sets: Mapping[str, ScoreCurves], keep: Sequence[str] = ()) -> DataFrame:
    """Cell scores under many parameter sets: one aggregate column per set in a single pass, then (cell, set, los) rows."""
    return rescore_best(items, best_stops(profiles, list(sets.values())), sets, keep)


def rescore_best(items: DataFrame, best: DataFrame, sets: Mapping[str, ScoreCurves], keep: Sequence[str] = ()) -> DataFrame:
    """``rescore`` of patterns that ``best_stops`` has reduced: ``best`` has the stop score of each set."""
    rows = skewed_join(items, best, ["station"], "inner")
    value = lambda i, c: F.col(f"_s{i}") * c.walk(F.col("dist"), F.col("mode"))
    wide = rows.groupBy("cell", *keep).agg(*[(100 * F.max(value(i, c))).alias(f"_{i}") for i, c in enumerate(sets.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("set"), F.col(f"_{i}").alias("los")) for i, n in enumerate(sets)])
    return wide.select("cell", *keep, F.inline(pairs))


SEARCHED_ALONE = {"mode", "walk_power", "walk_scale"}
"""Parameters that leave the headway and speed part of a stop score as it is."""


def leading_walks(items: DataFrame, profiles: DataFrame, curves: ScoreCurves) -> DataFrame:
    """The walks (cell, dist, mode, ``base``) of which one is best under any positive walk decay and any mode factors: no other walk of the cell
    and mode is as short and has as good a ``base``, the station's best headway and speed part under ``curves``.

    Unknown and negative figures are left alone. The rows lie by cell, so that the partial aggregate of a later round is one row per cell.
    """
    _, b, c = curves.weights
    part = curves._power(curves.headway_score(F.col("h")), b) * curves._power(curves.speed_score(F.col("v")), c)
    best = profiles.groupBy("station", "mode").agg(F.max(part).alias("base"))
    walks = skewed_join(items.select("cell", "station", "dist"), best, ["station"], "inner").select("cell", "dist", "mode", "base")
    plain = F.coalesce((F.col("dist") >= 0) & ~F.isnan(F.col("dist").cast("double")) & (F.col("base") >= 0), F.lit(False))
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nearer = Window.partitionBy("cell", "mode", "_plain").orderBy("dist", F.col("base").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = walks.withColumn("_plain", plain).repartition(width, "cell").withColumn("_best", F.max("base").over(nearer))
    return ranked.filter(~F.col("_plain") | F.col("_best").isNull() | (F.col("base") > F.col("_best"))).select("cell", "dist", "mode", "base")


def rescore_walks(walks: DataFrame, sets: Mapping[str, ScoreCurves]) -> DataFrame:
    """``rescore`` of ``leading_walks`` under sets that differ in ``SEARCHED_ALONE`` only: (cell, set, los)."""
    value = lambda c: c._power(c.mode_score(F.col("mode")), c.weights[0]) * F.col("base") * c.walk(F.col("dist"), F.col("mode"))
    wide = walks.groupBy("cell").agg(*[(100 * F.max(value(c))).alias(f"_{i}") for i, c in enumerate(sets.values())])
    return wide.select("cell", F.inline(F.array(*[F.struct(F.lit(n).alias("set"), F.col(f"_{i}").alias("los")) for i, n in enumerate(sets)])))


def predicted_at_factors(rows: DataFrame, n: Column, logit_at, factors: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Expected successes when values are multiplied by each factor, relative to the last one: (factor, demand), in one pass."""
    sums = [F.sum(n / (1 + F.exp(-logit_at(f)))).alias(f"_{i}") for i, f in enumerate(factors)]
    wide = rows.groupBy(*by).agg(*sums)
    last = F.col(f"_{len(factors) - 1}")
    pairs = F.array(*[F.struct(F.lit(float(f)).alias("factor"), (F.col(f"_{i}") / last).alias("demand")) for i, f in enumerate(factors)])
    return wide.select(*by, F.inline(pairs))


def first_crossing(curve: DataFrame, by: Sequence[str], x: str, y: str, level: float) -> DataFrame:
    """First x at which a falling curve meets the level, interpolated; null if never. A curve is a short list of points."""
    w = Window.partitionBy(*by).orderBy(x)
    rows = curve.withColumn("_px", F.lag(x).over(w)).withColumn("_py", F.lag(y).over(w)).filter(F.col(y) <= level)
    at = F.when(F.col("_px").isNull() | (F.col("_py") == F.col(y)), F.col(x)).otherwise(
        F.col("_px") + (F.col("_py") - level) / (F.col("_py") - F.col(y)) * (F.col(x) - F.col("_px"))
    )
    hits = rows.groupBy(*by).agg(F.min_by(at, x).alias("crossing")) if by else rows.agg(F.min_by(at, x).alias("crossing"))
    return curve.select(*by).distinct().join(hits, list(by), "left") if by else hits


def catchments(winners: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Per station the cells it wins and the counts that live there."""
    return winners.groupBy("station").agg(F.count("*").alias("cells"), *[F.sum(c).alias(c) for c in sums])


def service_class(headway: Column) -> Column:
    return F.when(headway.isNull(), 0).when(headway >= 60, 1).when(headway >= 30, 2).when(headway >= 15, 3).otherwise(4)


def unit_classes(values: DataFrame, cells: DataFrame, unit: str, radius: float = CLASS_RADIUS) -> DataFrame:
    """Service class with most residents per unit (the lower class on ties); cells without a stop in reach are class 0."""
    best = values.filter(F.col("dist") <= radius).groupBy("cell").agg(F.min("h").alias("_h"))
    per_class = cells.join(best, "cell", "left").groupBy(unit, service_class(F.col("_h")).alias("class")).agg(F.sum("population").alias("_p"))
    return first_row(per_class, [unit], [-F.col("_p"), F.col("class")], ["class"])


def calibration(rows: DataFrame, group: str, y: Column, n: Column, predicted: Column, weight: Column) -> DataFrame:
    """Weight share, observed and predicted share and the share with any success per group."""
    marked = rows.select(F.col(group), y.alias("_y"), n.alias("_n"), predicted.alias("_p"), weight.alias("_w"))
    per = marked.groupBy(group).agg(
        F.sum("_w").alias("_gw"),
        weighted_mean(F.col("_y") / positive(F.col("_n")), F.col("_w")).alias("observed"),
        weighted_mean(F.col("_p"), F.col("_w")).alias("predicted"),
        weighted_mean((F.col("_y") > 0).cast("double"), F.col("_w")).alias("any_observed"),
    )
    whole = per.agg(F.sum("_gw").alias("_tw"))
    return per.crossJoin(F.broadcast(whole)).select(group, (F.col("_gw") / F.col("_tw")).alias("weight_share"), "observed", "predicted", "any_observed")


def agreement(a: DataFrame, b: DataFrame, weight: str, close: float = 10.0) -> DataFrame:
    """How two score tables agree: shares equal and close, mean difference, weighted means, correlation, zeros that differ."""
    joined = a.select("cell", weight, F.col("los").alias("_a")).join(b.select("cell", F.col("los").alias("_b")), "cell", "full_outer")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    share = lambda c: F.avg(c.cast("double"))
    return joined.agg(
        F.count("*").alias("cells"), share(x == y).alias("equal"), share(F.abs(x - y) <= close).alias("close"), F.avg(F.abs(x - y)).alias("mean_difference"),
        weighted_mean(x, F.col(weight)).alias("mean_a"), weighted_mean(y, F.col(weight)).alias("mean_b"), F.corr(x, y).alias("correlation"),
        F.count_if((x == 0) != (y == 0)).alias("zero_mismatches"),
    )


def cap_effect(patterns: DataFrame, order: Sequence[Column], slots: int) -> DataFrame:
    """What keeping ``slots`` patterns per station cuts off: stations cut, patterns lost, best headway and speed kept.

    Counts per station come from an aggregate, the kept patterns from the bounded top-K.
    """
    sizes = patterns.groupBy("station").agg(F.count("*").alias("_n"), F.min("h").alias("_h"), F.max("v").alias("_v"))
    kept = top_k(patterns, ["station"], order, slots).groupBy("station").agg(F.min("h").alias("_kh"), F.max("v").alias("_kv"))
    j = sizes.join(kept, "station")
    share = lambda c: F.avg(c.cast("double"))
    return j.agg(
        F.count("*").alias("stations"), share(F.col("_n") > slots).alias("cut_share"), F.sum(F.greatest(F.col("_n") - slots, F.lit(0))).alias("patterns_lost"),
        share(F.col("_h") == F.col("_kh")).alias("best_headway_kept"), share(F.col("_v") == F.col("_kv")).alias("best_speed_kept"),
    )


def level_weights(df: DataFrame, group: str, weight: str, power: float, by: str | None = None) -> DataFrame:
    """Weights tempered by the total of their group, ``w * total^-power``, and, with ``by``, again by the square root of the class share; sum 1."""
    rows = with_totals(df, [group], {"_g": F.sum(weight)}).withColumn("_w", F.col(weight) * F.pow(F.col("_g"), F.lit(-power)))
    def unit(r):
        return r.crossJoin(F.broadcast(r.agg(F.sum("_w").alias("_s")))).withColumn("_w", F.col("_w") / F.col("_s")).drop("_s")

    rows = unit(rows)
    if by is not None:
        rows = with_totals(rows, [by], {"_c": F.sum("_w")}).withColumn("_w", F.col("_w") * F.pow(F.greatest("_c", F.lit(1e-9)), F.lit(-0.5))).drop("_c")
        rows = unit(rows)
    return rows.withColumn("w", F.col("_w")).select(*df.columns, "w")


def best_subset_merged(calls: DataFrame, curves: ScoreCurves = DEFAULT, window: tuple[int, int] = DAY_WINDOW) -> DataFrame:
    """Best mode tier and minimum trip speed of every station from the departures of all its routes merged per direction.

    ``calls``: (station, direction, sec, mode, distance, time), the last two of the call's trip. Route ids play no role and simultaneous
    departures count once, so a timetable published twice changes nothing. Cut-offs are trip speeds floored to 2 km/h. Before the cut-offs
    multiply them, calls are reduced to one row per second and speed step.
    """
    known = F.col("distance").isNotNull() & (F.col("time") > 0)
    speed = F.when(known, (F.col("distance") / 1000.0) / (F.col("time") / 3600.0))
    inside = calls.filter((F.col("sec") >= window[0]) & (F.col("sec") < window[1]))
    rows = inside.select(
        "station", "direction", "sec", F.coalesce("mode", F.lit("bus")).alias("mode"), (F.floor(speed / SPEED_STEP) * SPEED_STEP).alias("step"),
        F.when(known, F.col("distance")).alias("d"), F.when(known, F.col("time")).alias("t"),
    )
    slots = rows.groupBy("station", "direction", "sec", "mode", "step").agg(F.max("d").alias("d"), F.max("t").alias("t"))
    tiers = F.array(*[F.struct(F.lit(i).alias("ti"), F.lit(n).alias("tier"), F.array(*[F.lit(m) for m in ms]).alias("ms")) for i, (n, ms) in enumerate(TIERS)])
    slots = slots.withColumn("_t", F.explode(F.filter(tiers, lambda x: F.array_contains(x["ms"], F.col("mode")))))
    slots = slots.select("*", F.col("_t.ti").alias("ti"), F.col("_t.tier").alias("tier")).drop("_t")
    # speed steps of a station's tier: a short list that its calls are matched to
    cuts = slots.groupBy("station", "ti").agg(F.sort_array(F.collect_set("step")).alias("_cuts"))
    cuts = cuts.withColumn("_cuts", F.when(F.size("_cuts") > 0, F.col("_cuts")).otherwise(F.array(F.lit(0.0))))
    each = skewed_join(slots, cuts, ["station", "ti"], "inner").withColumn("_keep", F.filter("_cuts", lambda c: F.col("step").isNull() | (c <= F.col("step"))))
    each = each.select("station", "ti", "tier", "direction", "sec", "d", "t", F.explode("_keep").alias("min_speed"))
    key = ["station", "ti", "tier", "min_speed"]
    merged = each.groupBy(*key, "direction", "sec").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    speeds = merged.groupBy(*key).agg(((F.sum("d") / 1000) / positive(F.sum("t") / 3600)).alias("speed"))
    frequent = headways(merged, [*key, "direction"], window).groupBy(*key).agg(F.min("headway").alias("headway"))
    scored = speeds.join(frequent, key).filter("speed is not null").select(
        *key, "headway", "speed", curves.stop_score(F.col("tier"), F.col("headway"), F.col("speed")).alias("score")
    )
    return first_row(scored, ["station"], [-F.col("score"), F.col("ti"), F.col("min_speed")], ["tier", "headway", "speed", "min_speed", "score"])

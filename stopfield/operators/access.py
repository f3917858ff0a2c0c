"""What a cell reaches beyond its stored walks, and what storing fewer of them changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopfield.functions.curves import ScoreCurves
from stopfield.functions.geo import haversine_km
from stopfield.operators.score import best_stops
from stopfield.operators.search import nearest
from stopfield.operators.skew import median, skewed_join

# Walks and straight lines from which the detour is taken, and the detour where there are none.
LEAST_WALK, LEAST_STRAIGHT, DEFAULT_DETOUR = 100.0, 50.0, 1.3
# How far below the uncapped figure still counts as kept (points of the score), and as close.
KEPT_POINTS, CLOSE_POINTS = 0.01, 1.0
# A walk, a headway and a speed still count as close within these factors; walks also within so many metres.
CLOSE_WALK, CLOSE_WALK_METRES, CLOSE_HEADWAY, CLOSE_SPEED = 1.15, 50.0, 1.15, 0.9


def detour_factor(items: DataFrame, cells: DataFrame, stations: DataFrame) -> float:
    """Median of walked over straight distance of the items (cell, station, dist) that are long enough."""
    at = cells.select("cell", F.col("lon").alias("_a"), F.col("lat").alias("_b"))
    to = stations.select("station", F.col("lon").alias("_c"), F.col("lat").alias("_d"))
    straight = haversine_km(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d")) * 1000
    long = items.join(at, "cell").join(to, "station").withColumn("_s", straight).filter((F.col("dist") > LEAST_WALK) & (F.col("_s") > LEAST_STRAIGHT))
    found = median(long.select(F.try_divide("dist", "_s").alias("k")), [], "k").first()
    return DEFAULT_DETOUR if found is None or found["median"] is None else float(found["median"])


def far_items(
    cells: DataFrame, stations: DataFrame, items: DataFrame, score: str, bands: Sequence[tuple[float, float]], reach: float, detour: float | None = None
) -> DataFrame:
    """The nearest station of each score band that a cell does not have among its own items: (cell, band, station, dist).

    ``cells`` (cell, lon, lat), ``stations`` (station, lon, lat, ``score``), ``items`` (cell, station, dist). Bands are half open and numbered from
    0; distances are straight lines times the detour, at most ``reach``. One search serves all bands.
    """
    factor = detour_factor(items, cells, stations) if detour is None else detour
    band = F.coalesce(*[F.when((F.col(score) >= low) & (F.col(score) < high), F.lit(i)) for i, (low, high) in enumerate(bands)])
    strong = stations.select("station", "lon", "lat", band.alias("band")).filter(F.col("band").isNotNull())
    found = nearest(cells.select("cell", "lon", "lat"), strong, "cell", "station", reach / factor, by=["band"])
    return found.join(items.select("cell", "station"), ["cell", "station"], "left_anti").select("cell", "band", "station", (F.col("dist") * factor).alias("dist"))


def cell_cap_metrics(items: DataFrame, patterns: DataFrame, caps: Sequence[int], curves: Mapping[str, ScoreCurves], modes: Sequence[str]) -> DataFrame:
    """What keeping the ``cap`` nearest stations of each cell changes, for all caps at once: one row per cap.

    ``items`` (cell, station, dist), ``patterns`` (station, mode, h, v); ``modes`` in rising order. A station is met with its best value
    under each set of curves, its shortest headway, top speed and top mode; a cell folds its stations, nearest first, into one group of maxima for
    each cap, so the items are shuffled by cell once whatever the number of caps. Stations of a cell are a short list (those within a walk).
    """
    rows = skewed_join(items.select("cell", "station", "dist"), best_stops(patterns, list(curves.values())), ["station"], "inner")
    rank_of = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(modes)])
    best = [F.max(100 * (F.col(f"_s{i}") * c.walk(F.col("dist"), F.col("mode")))).alias(f"s{i}") for i, c in enumerate(curves.values())]
    station = rows.groupBy("cell", "station").agg(F.min("dist").alias("dist"), F.min("h").alias("h"), F.max("v").alias("v"), F.max(rank_of).alias("m"), *best)
    ranked = station.withColumn("_k", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "station")))

    def fold(limit: int | None, tag: str) -> list:
        on = (lambda c: c) if limit is None else (lambda c: F.when(F.col("_k") <= limit, c))
        return [
            F.count(on(F.lit(1))).alias(f"n{tag}"), F.min(on(F.col("h"))).alias(f"h{tag}"), F.max(on(F.col("v"))).alias(f"v{tag}"), F.max(on(F.col("m"))).alias(f"m{tag}"),
            F.min(on(F.col("dist"))).alias(f"d{tag}"), F.count_distinct(on(F.col("m"))).alias(f"k{tag}"), *[F.max(on(F.col(f"s{i}"))).alias(f"s{i}{tag}") for i in range(len(curves))],
        ]

    wide = ranked.groupBy("cell").agg(*fold(None, "_all"), *[x for i, cap in enumerate(caps) for x in fold(cap, f"_{i}")])
    fields = ["n", "h", "v", "m", "d", "k", *[f"s{i}" for i in range(len(curves))]]
    per_cap = F.array(*[F.struct(F.lit(cap).alias("cap"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, cap in enumerate(caps)])
    long = wide.select("cell", *[f"{f}_all" for f in fields], F.inline(per_cap))
    cut = F.col("n_all") > F.col("n")
    among = lambda c: F.coalesce(F.avg(F.when(cut, c.cast("double"))), F.lit(1.0))
    loss = [F.col(f"s{i}_all") - F.col(f"s{i}") for i in range(len(curves))]
    total = lambda parts: sum(parts[1:], parts[0])
    per_set = lambda test: F.avg(total([test(x).cast("double") for x in loss]) / len(loss))
    return long.groupBy("cap").agg(
        F.count("*").alias("cells"),
        F.avg(cut.cast("double")).alias("cut_share"),
        F.coalesce(F.sum(F.when(cut, F.col("n"))) / F.sum(F.when(cut, F.col("n_all"))), F.lit(1.0)).alias("stations_kept"),
        (F.sum("k") / F.sum("k_all")).alias("modes_kept"),
        among(F.col("d") <= F.greatest(CLOSE_WALK * F.col("d_all"), F.col("d_all") + CLOSE_WALK_METRES)).alias("nearest_close"),
        among(F.col("h") == F.col("h_all")).alias("headway_kept"),
        among(F.col("h") <= CLOSE_HEADWAY * F.col("h_all")).alias("headway_close"),
        among(F.col("v") == F.col("v_all")).alias("speed_kept"),
        among(F.col("v") >= CLOSE_SPEED * F.col("v_all")).alias("speed_close"),
        among(F.col("m") == F.col("m_all")).alias("best_mode_kept"),
        per_set(lambda x: x <= KEPT_POINTS).alias("winner_kept"),
        per_set(lambda x: x <= CLOSE_POINTS).alias("within_one_point"),
        F.avg(total(loss) / len(loss)).alias("mean_error"),
    )

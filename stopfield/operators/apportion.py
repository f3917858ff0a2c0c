"""Carrying totals to finer units without losing any: shares, dasymetric weights, rescaling, raking and redistribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.operators.rollup import positive
from stopfield.operators.skew import skewed_join, with_grand_totals, with_totals


def apportion(
    members: DataFrame, source: DataFrame, key: str, weight: str, amounts: Sequence[str], copies: Sequence[str] = ()
) -> DataFrame:
    """Amounts of a group shared among its members by weight, equally where the group has none; ``copies`` are passed on unchanged.

    A member without a group gets nulls.
    """
    whole = with_totals(members, [key], {"_w": F.sum(weight), "_n": F.count("*")})
    frac = F.coalesce(F.col(weight) / positive(F.col("_w")), 1.0 / F.col("_n"))
    joined = skewed_join(whole, source.select(key, *[F.col(c).alias(f"_s_{c}") for c in [*amounts, *copies]]), [key])
    out = [(F.col(f"_s_{c}") * frac).alias(c) for c in amounts] + [F.col(f"_s_{c}").alias(c) for c in copies]
    return joined.select(*members.columns, *out)


def dasymetric(
    pairs: DataFrame, amounts: Mapping[str, str], weights: Sequence[str], lone: DataFrame | None = None
) -> DataFrame:
    """Amounts of polygons split over their cells.

    ``pairs`` has one row per (polygon, cell) with the polygon's amounts and the cell's weights; ``amounts`` maps an amount to the weight it
    follows, falling back to the sum of all ``weights``, then to equal shares. ``lone`` holds polygons without a cell: (cell, amounts).
    """
    everything = sum((F.col(w) for w in weights[1:]), F.col(weights[0]))
    totals = {f"_t_{w}": F.sum(w) for w in weights} | {"_all": F.sum(everything), "_n": F.count("*")}
    rows = with_totals(pairs, ["polygon"], totals)

    def share(w: str) -> Column:
        return F.coalesce(F.col(w) / positive(F.col(f"_t_{w}")), everything / positive(F.col("_all")), 1.0 / F.col("_n"))

    parts = rows.select("cell", *[(F.col(a) * share(w)).alias(a) for a, w in amounts.items()])
    if lone is not None:
        parts = parts.unionByName(lone.select("cell", *amounts))
    return parts.groupBy("cell").agg(*[F.sum(a).alias(a) for a in amounts])


def floor_area(structures: DataFrame, cell: str, use: str, area: str, home: Sequence[str] = ("residential", "mixed")) -> DataFrame:
    """Residential and other floor area per cell."""
    is_home = F.col(use).isin(*home)
    a = F.coalesce(F.col(area), F.lit(0.0))
    return structures.groupBy(cell).agg(
        F.sum(F.when(is_home, a).otherwise(0.0)).alias("home_area"), F.sum(F.when(is_home, 0.0).otherwise(a)).alias("other_area")
    )


def rescale_factors(df: DataFrame, keep: Column, keys: Mapping[str, str], by: Sequence[str] = (), warn: float = 0.05) -> DataFrame:
    """Per column group: the factor that puts dropped rows' mass on the kept ones, and a warning flag above ``warn``.

    ``keys`` maps a group name to the column whose total it keeps.
    """
    rows = []
    for name, c in keys.items():
        whole, kept = F.sum(c), F.sum(F.when(keep, F.col(c)).otherwise(0.0))
        rows.append(F.struct(F.lit(name).alias("group"), whole.alias("total"), kept.alias("kept")))
    agg = F.array(*rows).alias("g")
    table = (df.groupBy(*by).agg(agg) if by else df.agg(agg)).select(*by, F.inline("g"))
    good = (F.col("total") > 0) & (F.col("kept") > 0)
    lost = (F.col("total") - F.col("kept")) / positive(F.col("total"))
    return table.withColumn("factor", F.when(good, F.col("total") / F.col("kept")).otherwise(1.0)).withColumn(
        "warning", F.coalesce(lost > warn, F.lit(False))
    )


def rescale(df: DataFrame, keep: Column, groups: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Kept rows with every group's columns multiplied by its factor; ``groups``: name -> (key column, columns)."""
    factors = rescale_factors(df, keep, {n: key for n, (key, _) in groups.items()})
    one_row = factors.agg(*[F.max(F.when(F.col("group") == n, F.col("factor"))).alias(f"_f_{n}") for n in groups])
    rows = df.filter(keep).crossJoin(F.broadcast(one_row))
    scaled = {c: F.col(c) * F.col(f"_f_{n}") for n, (_, cols) in groups.items() for c in cols}
    return rows.select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns])


def redistribute(cells: DataFrame, moves: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Amounts of donor cells added to their recipients. ``moves`` has (donor, recipient); donors leave the table.

    Donors with no recipient stay out of ``moves``; compare totals with :func:`conservation`.
    """
    donors = moves.join(cells.withColumnRenamed("cell", "donor"), "donor")
    gains = donors.groupBy(F.col("recipient").alias("cell")).agg(*[F.sum(a).alias(f"_g_{a}") for a in amounts])
    left = cells.join(moves.select(F.col("donor").alias("cell")).distinct(), "cell", "left_anti").join(gains, "cell", "left")
    added = {a: F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(f"_g_{a}"), F.lit(0.0)) for a in amounts}
    return left.select(*[added.get(c, F.col(c)).alias(c) for c in cells.columns])


def conservation(before: DataFrame, after: DataFrame, amounts: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """One row per amount: totals before and after and whether they agree."""
    def totals(df, side):
        rows = [F.struct(F.lit(a).alias("amount"), F.coalesce(F.sum(a), F.lit(0.0)).alias(side)) for a in amounts]
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))

    both = totals(before, "before").join(totals(after, "after"), "amount")
    gap = F.abs(F.col("after") - F.col("before"))
    return both.withColumn("ok", gap <= F.greatest(F.abs(F.col("before")), F.lit(1.0)) * tolerance)


def rake(df: DataFrame, control: DataFrame, key: str, columns: Sequence[str], low: float = 1.0, high: float = 3.0, whole: bool = True) -> DataFrame:
    """Scale columns so that each group meets its control total, the factor clipped to [low, high]; then, if asked, the whole table.

    A group without a control, or whose own sum is 0, keeps its values.
    """
    have = {f"_h_{c}": F.sum(c) for c in columns}
    want = control.select(key, *[F.col(c).alias(f"_w_{c}") for c in columns])
    rows = skewed_join(with_totals(df, [key], have), want, [key])
    scaled = {}
    for c in columns:
        raw = F.coalesce(F.col(f"_w_{c}") / positive(F.col(f"_h_{c}")), F.lit(1.0))
        scaled[c] = F.col(c) * F.greatest(F.lit(low), F.least(F.lit(high), raw))
    rows = rows.select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns])
    if not whole:
        return rows
    targets = control.agg(*[F.sum(c).alias(f"_w_{c}") for c in columns])
    rows = with_grand_totals(rows, {f"_h_{c}": F.sum(c) for c in columns}).crossJoin(F.broadcast(targets))
    final = {}
    for c in columns:
        good = (F.col(f"_h_{c}") > 0) & (F.col(f"_w_{c}") > 0)
        final[c] = F.when(good, F.col(c) * F.col(f"_w_{c}") / F.col(f"_h_{c}")).otherwise(F.col(c))
    return rows.select(*[final.get(c, F.col(c)).alias(c) for c in df.columns])


def keep_total(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One factor per column so that its sum equals the reference's."""
    want = reference.agg(*[F.sum(c).alias(f"_w_{c}") for c in columns])
    rows = with_grand_totals(df, {f"_h_{c}": F.sum(c) for c in columns}).crossJoin(F.broadcast(want))
    out = {c: F.col(c) * F.coalesce(F.col(f"_w_{c}") / positive(F.col(f"_h_{c}")), F.lit(1.0)) for c in columns}
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns])

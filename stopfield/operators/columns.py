"""Projections driven by short specification lists: shares, densities, clean-ups, classifications and column bookkeeping."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopfield.functions.numeric import as_number, clip, finite, ratio
from stopfield.operators.skew import exact_quantiles, with_grand_totals

# Marks of column names that hold an average, not an amount.
MEAN_ENDINGS = ("_share", "_rate")
MEAN_MARKS = ("median", "mean_", "_mean", "density", "_index", "_ratio")

# Route types of the rail, bus and ferry families, as inclusive ranges (11, the trolleybus, is both rail and bus).
RAIL_TYPES = ((0, 2), (5, 7), (11, 12), (100, 199), (400, 499), (900, 999), (1300, 1399))
BUS_TYPES = ((3, 3), (11, 11), (200, 299), (700, 899))
FERRY_TYPES = ((4, 4), (1000, 1099))
# Fixed value: the route type that marks bus rapid transit, scored like a tram.
RAPID_BUS_TYPE = 702


def share_column(df: DataFrame, top: str, bottom: str, scale: float = 100.0) -> Column:
    return clip(ratio(as_number(top, df.columns), as_number(bottom, df.columns), scale), 0.0, scale)


def shares(df: DataFrame, specs: Iterable[tuple[str, str, str]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and one 0-100 share per (name, top, bottom); a spec whose source column is absent gives nulls."""
    return df.select(*keep, *[share_column(df, top, bottom).alias(name) for name, top, bottom in specs])


def intensive(df: DataFrame, names: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Rename averages and drop the "no data" codes: only positive values stay."""
    cols = [(as_number(old, df.columns), new) for old, new in names.items()]
    return df.select(*keep, *[F.when(c > 0, c).alias(new) for c, new in cols])


def above(c: Column, threshold: float) -> Column:
    """The value where it is above the sentinel threshold, else null."""
    return F.when(c > threshold, c)


def bounded(c: Column, low: float, high: float) -> Column:
    """The value strictly between two bounds, else null."""
    return F.when((c > low) & (c < high), c)


def band_shares(df: DataFrame, bands: Sequence[str], keep: Sequence[str], scale: float = 100.0, suffix: str = "_share") -> DataFrame:
    """Share of each band in the sum of all bands."""
    total = sum((F.coalesce(F.col(b), F.lit(0.0)) for b in bands[1:]), F.coalesce(F.col(bands[0]), F.lit(0.0)))
    return df.select(*keep, *[ratio(F.col(b), total, scale).alias(b + suffix) for b in bands])


def safe_log(c: Column) -> Column:
    return finite(F.ln(F.when(c > 0, c)))


def map_view(df: DataFrame, percent: str, share: str, positive: str, protect: Sequence[str] = ()) -> DataFrame:
    """0-100 columns to 0-1, shares clipped to 0-1, negative prices to null; the name patterns are regular expressions."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name not in protect and isinstance(f.dataType, T.NumericType):
            if re.search(percent, f.name):
                c = c / 100.0
            if re.search(share, f.name):
                c = clip(c, 0.0, 1.0)
            elif re.search(positive, f.name):
                c = F.when(c >= 0, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def map_report(df: DataFrame, percent: str, share: str, positive: str, protect: Sequence[str] = ()) -> DataFrame:
    """One row per numeric column: how many values :func:`map_view` clips or empties, and whether nothing is left."""
    aggs, names = [], []
    for f in df.schema.fields:
        if f.name in protect or not isinstance(f.dataType, T.NumericType):
            continue
        c = F.col(f.name) / 100.0 if re.search(percent, f.name) else F.col(f.name)
        is_share = re.search(share, f.name) is not None
        clipped = F.count_if((c > 1) | (c < 0)) if is_share else F.lit(0).cast("long")
        negative = F.count_if(c < 0) if not is_share and re.search(positive, f.name) else F.lit(0).cast("long")
        names.append(f.name)
        aggs.append(
            F.struct(F.lit(f.name).alias("column"), clipped.alias("clipped"), negative.alias("negative"), (F.count(c) == 0).alias("dropped"))
        )
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def rule_of(name: str) -> str:
    """"mean" for averages, shares and densities, "sum" for amounts, by the name."""
    low = name.lower()
    return "mean" if low.endswith(MEAN_ENDINGS) or any(m in low for m in MEAN_MARKS) else "sum"


def measure_rules(df: DataFrame, skip: Sequence[str] = (), given: Mapping[str, str] | None = None) -> dict[str, str]:
    """Rule of every numeric column; ``given`` rules win over the name."""
    given = given or {}
    return {
        f.name: given.get(f.name, rule_of(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    }


def rules_table(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """The rules with the number of values each column holds, one row per column."""
    rules = measure_rules(df, skip)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.count(c).alias("values")) for c, r in rules.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def attach(df: DataFrame, source: DataFrame, key: str, prefix: str, on: Column | None = None) -> DataFrame:
    """Left join the columns of a source under a prefix, skipping those the table already has."""
    fresh = [c for c in source.columns if c != key and prefix + c not in df.columns]
    right = source.select(F.col(key).alias("_k"), *[F.col(c).alias(prefix + c) for c in fresh])
    return df.join(right, (F.col(key) if on is None else on) == F.col("_k"), "left").drop("_k")


def merge_sources(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer merge on a key; of a column several sources have, the first source's stays."""
    out = sources[0]
    for s in sources[1:]:
        fresh = [c for c in s.columns if c == key or c not in out.columns]
        out = out.join(s.select(*fresh), key, "full_outer")
    return out


def latest_period(columns: Sequence[str], protect: Sequence[str] = ()) -> list[str]:
    """Of columns that differ only in a year, the ones of the last year; others stay."""
    stems: dict[str, tuple[int, str]] = {}
    for c in columns:
        found = re.search(r"(19|20)\d\d", c)
        if c in protect or not found:
            continue
        stem = c[: found.start()] + "*" + c[found.end():]
        stems[stem] = max(stems.get(stem, (0, "")), (int(found.group()), c))
    last = {c for _, c in stems.values()}
    return [c for c in columns if c in protect or not re.search(r"(19|20)\d\d", c) or c in last]


def active(population: Column, jobs: Column) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(population, zero) > 0) | (F.coalesce(jobs, zero) > 0)


def occupied(activity: Column, area_km2: Column, is_fine: Column, minimum: float = 10.0) -> Column:
    """Fine cells need ``minimum`` residents and jobs per km2, coarse cells anybody."""
    return F.when(is_fine, activity / area_km2 >= minimum).otherwise(activity > 0)


def standardise(df: DataFrame, columns: Sequence[str], missing_share: float = 0.002) -> DataFrame:
    """z-scores (``z_``) with the median in place of missing values, and a centred flag (``m_``) where more than ``missing_share`` miss.

    The flag is 0 everywhere for columns below that share.
    """
    stats: dict[str, Column] = {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    medians = exact_quantiles(df.select(F.inline(pairs)), ["column"], "value", [0.5]).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_med_{c}") for c in columns]
    )
    filled = df.crossJoin(F.broadcast(medians))
    for c in columns:
        filled = filled.withColumn(f"_miss_{c}", F.col(c).isNull().cast("double")).withColumn(
            f"_fill_{c}", F.coalesce(F.col(c), F.col(f"_med_{c}"))
        )
        stats |= {f"_avg_{c}": F.avg(f"_fill_{c}"), f"_sd_{c}": F.stddev_samp(f"_fill_{c}"), f"_ms_{c}": F.avg(f"_miss_{c}")}
    out = with_grand_totals(filled, stats)
    for c in columns:
        sd = F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0)
        out = out.withColumn(f"z_{c}", (F.col(f"_fill_{c}") - F.col(f"_avg_{c}")) / sd).withColumn(
            f"m_{c}", F.when(F.col(f"_ms_{c}") > missing_share, F.col(f"_miss_{c}") - F.col(f"_ms_{c}")).otherwise(0.0)
        )
    return out.select(*df.columns, *[f"{p}_{c}" for c in columns for p in ("z", "m")])


def winsorise(df: DataFrame, column: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """``w_column``: clipped to two quantiles, then centred and scaled again."""
    q = exact_quantiles(df, [], column, [low, high])
    bounds = q.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    cut = df.crossJoin(F.broadcast(bounds)).withColumn("_c", F.greatest("_lo", F.least("_hi", F.col(column))))
    out = with_grand_totals(cut, {"_m": F.avg("_c"), "_s": F.stddev_samp("_c")})
    return out.select(*df.columns, ((F.col("_c") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-9))).alias(f"w_{column}"))


def valid_position(lon: Column, lat: Column) -> Column:
    x, y = lon.try_cast("double"), lat.try_cast("double")
    ok = (F.abs(y) > 0.01) & (F.abs(y) <= 90) & (F.abs(x) <= 180)
    return F.coalesce(ok, F.lit(False))


def _in_ranges(c: Column, ranges) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | c.between(low, high)
    return out


def route_kinds(route_type: Column) -> Column:
    """Array of the families (rail, bus, ferry) a route type belongs to."""
    t = route_type.try_cast("int")
    families = [F.when(_in_ranges(t, r), F.lit(n)) for n, r in (("rail", RAIL_TYPES), ("bus", BUS_TYPES), ("ferry", FERRY_TYPES))]
    return F.array_compact(F.array(*families))


def route_mode(route_type: Column) -> Column:
    """bus, tram or rail; the rapid-bus mark counts as tram, unknown types as bus."""
    t = route_type.try_cast("int")
    tram = (t == RAPID_BUS_TYPE) | t.isin(0, 5) | t.between(900, 999)
    return F.when(tram, "tram").when(_in_ranges(t, RAIL_TYPES) & (t != 11), "rail").otherwise("bus")


def route_class(name: Column, rules: Sequence[tuple[str, str]], numbers: Sequence[tuple[int, int, str]], default: str) -> Column:
    """First class whose pattern the name matches, else the class of the route number's range, else ``default``."""
    number = F.regexp_extract(name, r"(\d{1,4})", 1).try_cast("int")
    out = F.when(F.lit(False), F.lit(""))
    for pattern, label in rules:
        out = out.when(name.rlike(pattern), label)
    for low, high, label in numbers:
        out = out.when(number.between(low, high), label)
    return out.otherwise(default)


def set_votes(df: DataFrame, dem: Column, rep: Column, total: Column, adults: Column, old: Mapping[str, Column] | None = None) -> DataFrame:
    """Eligible voters, total votes, party and other shares and turnout over the voting-age population.

    Rows without known votes keep their ``old`` values; the ratios also need a positive voting-age population.
    """
    old = old or {}
    known = total > 0
    base = F.when(known & (adults > 0), adults)
    new = {
        "eligible_voters": base,
        "total_votes": F.when(known, total),
        "democrat_share": dem / base,
        "republican_share": rep / base,
        "other_share": F.greatest(total - dem - rep, F.lit(0.0)) / base,
        "turnout_rate": total / base,
    }
    keep = [c for c in df.columns if c not in new]
    return df.select(*keep, *[F.coalesce(c, old.get(n, F.lit(None).cast("double"))).alias(n) for n, c in new.items()])


def mean_of_sums(specs: Iterable[tuple[str, str, str, float]]) -> list[Column]:
    """(name, numerator, denominator, scale): the mean a roll-up of helper sums stands for."""
    return [ratio(F.col(num), F.col(den), k).alias(name) for name, num, den, k in specs]


def outcome(df: DataFrame, parts: Sequence[str], trials: str, population: str) -> DataFrame:
    """Rows that enter a fit: people and trials present, every part of the outcome known; ``y`` clipped to [0, n] and its smoothed logit."""
    known = F.lit(True)
    total = F.lit(0.0)
    for p in parts:
        known, total = known & F.col(p).isNotNull(), total + F.col(p)
    n = F.col(trials).cast("double")
    y = F.least(F.greatest(total, F.lit(0.0)), n)
    rows = df.filter((F.col(population) > 0) & (n > 0) & known)
    return rows.withColumn("n", n).withColumn("y", y).withColumn("logit", F.ln((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5)))

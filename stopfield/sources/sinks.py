"""Sinks: atomic layers, feed tables, JSON chunks, summaries and bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopfield.functions import clock
from stopfield.operators.skew import skewed_join
from stopfield.sources.feed_files import FeedFiles

CHUNK_ROWS = 20_000


def overwrite_layer(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Replace a parquet layer; with partitions only those present in the rows are replaced. The commit protocol makes the swap all or nothing."""
    writer = df.write.mode("overwrite")
    if partitions:
        # one shuffle by partition and slice keeps files large without sending a big region to one task
        slices = F.pmod(F.xxhash64(*df.columns), F.lit(8))
        writer = df.repartition(*[F.col(p) for p in partitions], slices).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


def feed_sink(tables: Mapping[str, DataFrame], folder: str, order: Mapping[str, Sequence[str]] | None = None) -> None:
    """Timetable tables (name -> rows with ``feed``) as ``<folder>/<feed>/<name>.txt``, which ``readers.feed_table`` reads back.

    Each table replaces the files of the feeds it holds, all or none; ``order`` names the columns that rows of a table are sorted by within a feed.
    """
    for name, df in tables.items():
        df.sparkSession.dataSource.register(FeedFiles)
        rows = df.repartition("feed").sortWithinPartitions("feed", *(order or {}).get(name, ()))
        rows.write.format("feed_files").option("folder", folder).option("table", name).mode("append").save()


def built_feed(routes: DataFrame, stops: DataFrame, windows: DataFrame, calls: DataFrame, first_day: str, last_day: str, service: str = "ALL") -> dict[str, DataFrame]:
    """Feed tables of assumed services that run every day of a range, by table name.

    ``routes`` (feed, route, agency, name, type), ``stops`` (feed, stop, name, lon, lat), ``windows`` (feed, trip, start, end, headway: seconds),
    ``calls`` (feed, trip, route, direction, seq, stop, sec). Trips are the calls' own; clock times go past 24 hours.
    """
    at = lambda c: clock.text(F.col(c))
    day = lambda d: F.lit(d.replace("-", ""))
    feeds = routes.select("feed").distinct()
    trips = calls.select("feed", "trip", "route", "direction").distinct()
    return {
        "agency": routes.select("feed", F.col("agency").alias("agency_id"), F.col("agency").alias("agency_name")).distinct(),
        "calendar": feeds.select("feed", F.lit(service).alias("service_id"), *[F.lit(1).alias(d) for d in clock.WEEKDAYS], day(first_day).alias("start_date"), day(last_day).alias("end_date")),
        "stops": stops.select("feed", F.col("stop").alias("stop_id"), F.col("name").alias("stop_name"), F.round("lat", 6).alias("stop_lat"), F.round("lon", 6).alias("stop_lon")),
        "routes": routes.select("feed", F.col("route").alias("route_id"), F.col("agency").alias("agency_id"), F.col("name").alias("route_short_name"), F.col("type").alias("route_type")),
        "trips": trips.select("feed", F.col("route").alias("route_id"), F.lit(service).alias("service_id"), F.col("trip").alias("trip_id"), F.col("direction").alias("direction_id")),
        "stop_times": calls.select("feed", F.col("trip").alias("trip_id"), at("sec").alias("arrival_time"), at("sec").alias("departure_time"), F.col("stop").alias("stop_id"), F.col("seq").alias("stop_sequence")),
        "frequencies": windows.select("feed", F.col("trip").alias("trip_id"), at("start").alias("start_time"), at("end").alias("end_time"), F.col("headway").alias("headway_secs"), F.lit(0).alias("exact_times")),
    }


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Numbers rounded, NaN and infinities to null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(F.abs(c) < F.lit(float("inf")), c), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def column_chunks(df: DataFrame, key: str, row: str, digits: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Column-oriented JSON per group: (key, part, rows, chunk), each chunk one object of equally long arrays in row order.

    A group larger than ``chunk_rows`` is cut in parts by the digest of its rows, so no task holds a whole group.
    """
    clean = rounded(df, digits)
    sizes = clean.groupBy(key).agg(F.ceil(F.count("*") / F.lit(chunk_rows)).alias("_parts"))
    placed = skewed_join(clean, sizes, [key], "inner").withColumn("part", F.pmod(F.xxhash64(F.col(row)), F.col("_parts")).cast("int")).drop("_parts")
    fields = [c for c in df.columns if c != key]
    lists = placed.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("_row"), *fields))).alias("_l"))

    def values(name):
        return F.transform("_l", lambda x: x[name]).alias(name)

    arrays = F.struct(*[values(c) for c in fields])
    return lists.select(key, "part", F.size("_l").alias("rows"), F.to_json(arrays, {"ignoreNullFields": "false"}).alias("chunk"))


def write_chunks(chunks: DataFrame, key: str, path: str) -> None:
    """Chunks as compressed text, one folder per group."""
    chunks.select(key, F.col("chunk").alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).option("compression", "gzip").text(path)


def read_chunks(chunks: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Rows back from column-oriented chunks; ``schema`` describes one row."""
    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])
    parsed = chunks.withColumn("_c", F.from_json(column, arrays))
    names = [f.name for f in schema.fields]
    return parsed.select(*[c for c in chunks.columns if c != column], F.inline(F.arrays_zip(*[F.col(f"_c.{n}").alias(n) for n in names])))


def square_key(lon: Column, lat: Column, degrees: float) -> Column:
    """Key of the square of the map a position lies in."""
    return F.concat_ws("_", F.floor(lat / degrees).cast("string"), F.floor(lon / degrees).cast("string"))


def population_squares(cells: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Inhabited cells with the key of their square: (chunk, cell, lat, lon, population, los)."""
    rows = cells.filter(F.coalesce("population", F.lit(0.0)) > 0)
    return rows.select(
        square_key(F.col("lon"), F.col("lat"), degrees).alias("chunk"), "cell", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"),
        F.round("population", 3).alias("population"), F.round(F.coalesce("los", F.lit(0.0)), 3).alias("los"),
    )


def square_index(squares: DataFrame) -> DataFrame:
    return squares.groupBy("chunk").agg(F.count("*").alias("cells"))


def write_squares(squares: DataFrame, path: str) -> None:
    squares.repartition("chunk").write.mode("overwrite").partitionBy("chunk").json(path)


def region_index(cells: DataFrame, region: str, levels: Mapping[str, str], names: DataFrame, vehicle_km: DataFrame) -> DataFrame:
    """One JSON per region: its members of every level with id, name, residents and vehicle-km, and its own totals.

    ``names``: (level, id, name); ``vehicle_km``: (level, id, km). A region's list is as long as its members.
    """
    members = None
    for level, column in levels.items():
        m = cells.filter(F.col(column).isNotNull()).groupBy(region, F.col(column).cast("string").alias("id")).agg(F.sum("population").cast("long").alias("pop")).withColumn("level", F.lit(level))
        members = m if members is None else members.unionByName(m)
    rows = members.join(names, ["level", "id"], "left").join(vehicle_km, ["level", "id"], "left")
    entry = F.struct(F.coalesce("name", F.concat_ws(" ", F.initcap("level"), "id")).alias("name"), F.col("id"), F.col("pop"), F.round(F.coalesce("km", F.lit(0.0)), 0).cast("long").alias("vkm"))
    listed = [F.sort_array(F.collect_list(F.when(F.col("level") == level, entry))).alias(level) for level in levels]
    lists = rows.groupBy(region).agg(*listed)
    totals = cells.groupBy(region).agg(F.count("*").alias("n"), F.sum("population").cast("long").alias("pop"))
    joined = lists.join(totals, region)
    return joined.select(region, F.to_json(F.struct(F.col(region).alias("key"), *levels, "n", "pop")).alias("entry"))


def write_summary(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A short result table as one CSV or JSON file; the caller passes aggregated rows only."""
    writer = df.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def bundle(levels: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Every level as parquet under one folder and a manifest of the levels present: (level, columns)."""
    spark = next(iter(levels.values())).sparkSession
    rows = []
    for name, df in levels.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, len(df.columns)))
    manifest = spark.createDataFrame(rows, "level string, columns int")
    write_summary(manifest, f"{path}/manifest", "json")
    return manifest


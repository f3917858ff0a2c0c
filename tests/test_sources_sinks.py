import gzip
import json
import os

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopfield.operators import checks
from stopfield.plans.params import StudyParams
from stopfield.sources import readers, sinks


def write(path, text, zipped=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open(path, "wt", encoding="utf-8") if zipped else open(path, "w", encoding="utf-8")) as f:
        f.write(text)


def test_feed_tables_tolerate_marks_padding_and_ragged_rows(spark, tmp_path):
    write(f"{tmp_path}/a/stops.txt", "﻿stop_id, stop_name ,stop_lat,stop_lon\n 1 ,First ,40.0,-74.0\n2,Second,40.01\n")
    write(f"{tmp_path}/b/stops.txt", "stop_id,stop_lat\n9,41.0\n")
    df = readers.feed_tables(spark, str(tmp_path), "stops", ["a", "b"])
    got = {r["stop_id"]: r.asDict() for r in df.collect()}
    assert set(got) == {"1", "2", "9"} and got["1"]["stop_name"] == "First" and got["9"]["feed"] == "b" and got["9"]["stop_lon"] is None and got["2"]["stop_lon"] is None


def test_feeds_whose_headers_are_in_another_order(spark, tmp_path):
    write(f"{tmp_path}/a/stops.txt", "stop_id,stop_name,stop_lat,stop_lon\n1,Alpha,41.0,-3.7\n")
    write(f"{tmp_path}/b/stops.txt", "stop_lon,stop_lat,stop_id,stop_name\n9,-3.5,7,Beta\n")
    write(f"{tmp_path}/c/stops.txt", "stop_id,stop_name,stop_lat,stop_lon\r\n3,Gamma,42.0,-3.8\r\n")
    got = {r["feed"]: (r["stop_id"], r["stop_name"], r["stop_lat"], r["stop_lon"]) for r in readers.feed_table(spark, str(tmp_path), "stops").collect()}
    assert got == {"a": ("1", "Alpha", "41.0", "-3.7"), "b": ("7", "Beta", "-3.5", "9"), "c": ("3", "Gamma", "42.0", "-3.8")}


def test_flows_from_compressed_csv(spark, rows, tmp_path):
    write(f"{tmp_path}/x_od.csv.gz", "w_geocode,h_geocode,S000,other\n360610001001000,360470002002000,3,1\n360610001001001,360470002002009,4,1\n", True)
    assert rows(readers.od_flows(spark, str(tmp_path))) == [("360470002002", "360610001001", 7)]


def test_missing_columns_and_nan_are_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, v double").write.parquet(f"{tmp_path}/t")
    got = {r["id"]: (r["v"], r["absent"]) for r in readers.parquet_columns(spark, f"{tmp_path}/t", {"id": "int", "v": "double", "absent": "double"}).collect()}
    assert got == {1: (None, None), 2: (3.0, None)}


def test_region_folder_becomes_a_column(spark, rows, tmp_path):
    for name in ("North", "South"):
        spark.createDataFrame([(1,)], "n int").coalesce(1).write.parquet(f"{tmp_path}/{name}/cells")
    out = readers.region_folders(spark, f"{tmp_path}/*/cells", level=2)
    assert rows(out, "region") == [("North",), ("South",)]


def test_layer_overwrite_replaces_only_its_partitions(spark, rows, tmp_path):
    path = f"{tmp_path}/layer"
    sinks.overwrite_layer(spark.createDataFrame([("a", 1), ("b", 2)], "s string, v int"), path, ["s"])
    sinks.overwrite_layer(spark.createDataFrame([("b", 9)], "s string, v int"), path, ["s"])
    assert rows(spark.read.parquet(path), "s", "v") == [("a", 1), ("b", 9)]


def test_chunks_round_trip_through_files(spark, rows, tmp_path):
    df = spark.createDataFrame([("x", i, float(i) / 3 if i % 4 else float("nan")) for i in range(50)], "g string, id long, v double")
    chunks = sinks.column_chunks(df, "g", "id", chunk_rows=8)
    assert chunks.count() > 3
    sinks.write_chunks(chunks, "g", f"{tmp_path}/c")
    back = sinks.read_chunks(spark.read.text(f"{tmp_path}/c"), "value", T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())]))
    want = sorted(((i, round(i / 3, 2) if i % 4 else None) for i in range(50)), key=str)
    assert sorted(((r["id"], r["v"]) for r in back.select("id", "v").collect()), key=str) == want


def test_feed_sink_and_fingerprints(spark, tmp_path):
    sinks.feed_sink({"stops": spark.createDataFrame([("f", "1", "A")], "feed string, stop_id string, stop_name string")}, f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out/f") == ["stops.txt"] and open(f"{tmp_path}/out/f/stops.txt").read() == "stop_id,stop_name\n1,A\n"
    for feed, text in (("a", "x"), ("b", "x"), ("c", "y")):
        write(f"{tmp_path}/feeds/{feed}/stops.txt", text)
    marks = {r["feed"]: r["mark"] for r in readers.feed_fingerprints(spark, f"{tmp_path}/feeds").collect()}
    assert marks["a"] == marks["b"] != marks["c"]


def test_index_version_follows_sizes(spark, tmp_path):
    write(f"{tmp_path}/w/s/meta.json", "{}")
    first = readers.index_version(spark, f"{tmp_path}/w").first()["version"]
    write(f"{tmp_path}/w/s/meta.json", "{ }")
    assert readers.index_version(spark, f"{tmp_path}/w").first()["version"] != first


def test_squares_index_and_summary(spark, rows, tmp_path):
    cells = spark.createDataFrame([(1, 2.5, 41.5, 3.0, None), (2, 2.6, 41.4, 0.0, 5.0), (3, -1.5, 41.2, 1.0, 7.0)], "cell long, lon double, lat double, population double, los double")
    squares = sinks.population_squares(cells)
    assert rows(sinks.square_index(squares)) == [("41_-2", 1), ("41_2", 1)]
    sinks.write_squares(squares, f"{tmp_path}/sq")
    assert spark.read.json(f"{tmp_path}/sq").count() == 2
    sinks.write_summary(sinks.square_index(squares), f"{tmp_path}/sum")
    assert len([f for f in os.listdir(f"{tmp_path}/sum") if f.endswith(".csv")]) == 1


def test_bundle_manifest(spark, tmp_path):
    sinks.bundle({"county": spark.range(3), "state": spark.range(1)}, f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b/manifest").count() == 2 and spark.read.parquet(f"{tmp_path}/b/county").count() == 3


def test_census_answers_in_batches(spark, rows):
    answer = lambda *r: (json.dumps([list(x) for x in r]),)
    a = spark.createDataFrame([answer(("B1", "state", "tract"), ("5", "36", "001"), ("-666666666", "36", "002"))], "t string")
    b = spark.createDataFrame([answer(("B2", "tract", "state"), ("7", "001", "36"))], "t string")
    one, two = readers.census_arrays(a, "t", ["state", "tract"], ["B1"]), readers.census_arrays(b, "t", ["state", "tract"], ["B2"])
    assert rows(readers.join_batches([one, two], "GEOID"), "GEOID", "B1", "B2") == [("36001", 5.0, 7.0), ("36002", None, None)]


def test_html_rows(spark):
    page = "<table><style>x</style><tr><th>71</th><td>A<br>B</td></tr><tr><td> </td></tr></table>"
    got = readers.html_rows(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h").collect()
    assert [r["cells"] for r in got] == [["71", "A B"]]


def test_source_fallback(spark):
    readers.loader("empty")(lambda **k: spark.range(0))
    readers.loader("full")(lambda **k: spark.range(2))
    assert readers.load_first(["empty", "full"]).count() == 2


def test_schema_guard_and_level_checks(spark):
    df = spark.createDataFrame([(1, 50.0, 10.0)], "cell int, los double, population double")
    assert {r["column"] for r in checks.schema_problems(df, ["cell", "jobs"]).collect()} == {"jobs"}
    bad = df.withColumn("population", F.lit(99.0)).withColumn("los", F.lit(120.0))
    got = {r["problem"] for r in checks.level_problems({9: df, 7: bad}, ["population"]).collect()}
    assert got == {"score outside 0-100", "population differs from the finest level"}
    assert checks.level_problems({9: df, 7: df}, ["population"]).count() == 0


def test_params_are_immutable():
    import dataclasses

    p = dataclasses.replace(StudyParams(), min_density_km2=50.0)
    assert p.min_density_km2 == 50.0 and StudyParams().min_density_km2 == 10.0


def test_a_feed_is_read_back_as_written(spark, rows, tmp_path):
    out = f"{tmp_path}/feeds"
    stops = spark.createDataFrame([(f"f{i % 5}", f"s{i}", None if i == 3 else 'Plaça "Major", 1' if i == 7 else f"Stop {i}", 2.0 + i / 100, 41.0) for i in range(60)], "feed string, stop string, name string, lon double, lat double")
    routes = spark.createDataFrame([(f"f{i}", "r", "Town", "R1", 3) for i in range(5)], "feed string, route string, agency string, name string, type int")
    calls = spark.createDataFrame([(f"f{i % 5}", f"t{i}", "r", i % 2, k + 1, f"s{(i + k) % 60}", 86_000 + 600 * k) for i in range(20) for k in range(3)], "feed string, trip string, route string, direction int, seq int, stop string, sec int")
    windows = spark.createDataFrame([("f0", "t0", 21_600, 93_600, 600)], "feed string, trip string, start int, end int, headway int")
    tables = sinks.built_feed(routes, stops, windows, calls, "2026-01-01", "2027-12-31")
    for _ in range(2):  # a second run replaces the first
        sinks.feed_sink(tables, out, {"stop_times": ["trip_id", "stop_sequence"]})
    assert sorted(os.listdir(out)) == [f"f{i}" for i in range(5)]
    assert sorted(os.listdir(f"{out}/f0")) == ["agency.txt", "calendar.txt", "frequencies.txt", "routes.txt", "stop_times.txt", "stops.txt", "trips.txt"]
    assert not os.path.exists(f"{out}/f1/frequencies.txt")
    for name, df in tables.items():
        back = readers.feed_table(spark, out, name)
        assert rows(back.select(*df.columns)) == rows(df.select(*[F.col(c).cast("string") for c in df.columns])), name
    times = readers.feed_table(spark, out, "stop_times").filter("feed = 'f0' AND trip_id = 't0'").collect()
    assert [(r.stop_sequence, r.departure_time) for r in times] == [("1", "23:53:20"), ("2", "24:03:20"), ("3", "24:13:20")]


def test_a_failed_feed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a", "1"), ("b/c", "2")], "feed string, stop_id string")
    with pytest.raises(Exception, match="no folder can be named"):
        sinks.feed_sink({"stops": bad}, f"{tmp_path}/out")
    left = [f for _, _, names in os.walk(f"{tmp_path}/out") for f in names]
    assert left == []

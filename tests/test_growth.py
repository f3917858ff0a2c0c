"""What one task holds and how often a costly expression is computed do not grow with the input: checked on plans and settings."""

from pyspark.sql import functions as F

from stopfield.functions.curves import DEFAULT
from stopfield.operators import match, models, score, search, skew, spatial, timetable
from stopfield.session import tune


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_ring_of_a_centroid_is_computed_a_bounded_number_of_times(spark):
    corner = lambda dx, dy: F.struct((F.col("lon") + dx * 0.0625).alias("lon"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(corner(0, 0), corner(2, 0), corner(2, 1), corner(0, 1), corner(0, 0))
    blocks = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 5.0)], "id int, lon double, lat double").select("id", ring.alias("ring"))
    out = spatial.representative_points(blocks, "id")
    assert sorted((r.id, round(r.lon, 9), round(r.lat, 9)) for r in out.collect()) == [(1, 0.0625, 0.5), (2, 10.0625, 5.5)]
    assert plan(out).count("element_at") == 0 and plan(out).count("aggregate(") <= 2


def test_centroid_of_odd_rings_is_null(spark):
    p = lambda x, y: {"lon": x, "lat": y}
    rings = [(1, None), (2, [p(0.0, 0.0), p(1.0, 1.0), p(0.0, 0.0)]), (3, [p(0.0, 0.0), None, p(1.0, 1.0), p(0.0, 0.0)])]
    blocks = spark.createDataFrame(rings, "id int, ring array<struct<lon double, lat double>>")
    assert {r.id: (r.lon, r.lat) for r in spatial.representative_points(blocks, "id").collect()} == {1: (None, None), 2: (None, None), 3: (None, None)}


def test_names_of_a_match_score_are_computed_once(spark):
    rows = [("Metro Valley River", "MVR"), ("Red Line", "Red Line Airport"), ("Harbor Hill", "harborx"), (None, "a"), ("Metro Valley", "MeVal"), ("Metro Valley", "MVZ")]
    df = spark.createDataFrame(rows, "a string, b string")
    marked = match.match_score(F.concat(F.col("a"), F.lit("")), F.repeat(F.col("b"), 1))
    out = df.select("a", "b", marked.alias("s"))
    assert [r.s for r in out.collect()] == [0.9, 0.0, 0.6, 0.0, 0.9, 0.0]
    assert plan(out, "analyzed").count("repeat(") == 1


def test_segments_of_a_zone_are_not_gathered(spark):
    segments = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("zone"), (F.col("id") % 7 + 1).cast("double").alias("km"), (F.lit(10.0) + F.col("id") % 5).alias("kmh"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = timetable.calibrate_speeds(segments, {"O": 11.0, "F": 13.0})
        text = plan(out, "executedPlan")
        assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
        assert {r.zone: round(r.k, 2) for r in out.collect()} == {"O": 0.93, "F": 1.1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scores_without_their_stations_are_not_sorted(spark):
    rows = [("a", 1, 0, 5.0, 0.5), ("a", 2, 0, 4.0, 0.5), ("a", 3, 1, 9.0, 0.25), ("b", 1, 0, 1.0, None)]
    cells = score.cell_scores(spark.createDataFrame(rows, "cell string, station int, slot int, dist double, value double"))
    assert {r.cell: (r.los, r.station) for r in cells.collect()} == {"a": (50.0, 2), "b": (None, 1)}
    only = cells.select("cell", "los")
    assert "max(struct" not in plan(only) and "SortAggregate" not in plan(only, "executedPlan")


def test_walks_meet_one_row_per_mode_of_a_station(spark):
    patterns = spark.createDataFrame([(1, 0, "bus", 5.0, 30.0), (1, 1, "bus", 20.0, 60.0), (1, 2, "rail", 60.0, 5.0), (1, 3, "rail", 30.0, None)], "station int, slot int, mode string, h double, v double")
    curves = [DEFAULT, DEFAULT.with_(walk_power=3.0, weights=(0.0, 1.0, 1.0))]
    assert score.best_stops(patterns, curves).count() == 2
    items = spark.createDataFrame([("a", 1, 100.0), ("b", 1, 900.0), ("b", 1, None)], "cell string, station int, dist double")
    got = {(r.cell, r.set): r.los for r in score.rescore(items, patterns, {str(i): c for i, c in enumerate(curves)}).collect()}
    for i, c in enumerate(curves):
        for r in score.item_values(items, patterns, c).groupBy("cell").agg((100 * F.max("value")).alias("los")).collect():
            assert got[r.cell, str(i)] == r.los


def test_shuffle_sizes_are_set_only_where_the_cluster_has_none(spark):
    first, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other = spark.newSession()
    tune(other)
    assert (other.conf.get(first), other.conf.get(size)) == ("1024", "16m")
    own = spark.newSession()
    own.conf.set(first, "7")
    own.conf.set(size, "5m")
    tune(own)
    assert (own.conf.get(first), own.conf.get(size)) == ("7", "5m")
    many = spark.newSession()
    many.conf.set("spark.sql.shuffle.partitions", "5000")
    tune(many)
    assert many.conf.get(first, None) is None


def test_cells_of_a_scaled_score_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r

    schema = "cell string, population double, los double"
    cells = spark.createDataFrame(spark.createDataFrame([("a", 1.0, 50.0), ("b", 1.0, 10.0)], schema).rdd.mapPartitions(count), schema)
    assert {r.cell: r.scaled for r in score.scaled_scores(cells, "los", "population").collect()} == {"a": 100.0, "b": 20.0}
    assert seen.value == 2



def test_a_curve_search_reads_walks_that_are_written_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            read.add(1)
            yield r

    schema = "cell string, station int, dist double"
    items = spark.createDataFrame(spark.createDataFrame([("a", 1, 100.0), ("b", 1, 900.0)], schema).rdd.mapPartitions(count), schema)
    patterns = spark.createDataFrame([(1, 0, "bus", 5.0, 30.0)], "station int, slot int, mode string, h double, v double")
    loss = lambda scores: scores.groupBy("set").agg(F.sum("los").alias("loss"))
    best, table = models.search_curves(items, patterns, DEFAULT, {"walk_power": [0.4, 0.2]}, loss, rounds=2)
    assert table.count() == 5 and best.walk_power > 1.5
    assert read.value == 2


def test_rounds_of_a_fit_join_nothing(spark):
    items = spark.createDataFrame([(c, s, float((c * 13 + s * 7) % 100 * 25)) for c in range(40) for s in range(20)] + [(50, 1, None), (51, 21, 10.0), (1, 22, 5.0)], "cell int, station int, dist double")
    patterns = [(s, i, ["bus", "tram", "rail"][s % 3], float((s * 11 + i * 17) % 59 + 2), float((s * 5 + i * 3) % 45 + 5)) for s in range(20) for i in range(2)]
    profiles = spark.createDataFrame(patterns + [(21, 0, None, 5.0, 30.0), (22, 0, "bus", None, 30.0)], "station int, slot int, mode string, h double, v double")
    sets = {"a": DEFAULT, "b": DEFAULT.with_(walk_power=0.3, mode={**DEFAULT.mode, "tram": 0.1}), "c": DEFAULT.with_(walk_power=3.0, walk_scale={**DEFAULT.walk_scale, "bus": 50.0})}
    walks = score.leading_walks(items, profiles, DEFAULT)
    flat = lambda df: sorted((r.cell, r.set, None if r.los is None else round(r.los, 9)) for r in df.collect())
    assert flat(score.rescore_walks(walks, sets)) == flat(score.rescore(items, profiles, sets)) and walks.count() < items.count() / 2
    plans = []

    def loss(scores):
        plans.append(plan(scores, "executedPlan"))
        return scores.groupBy("set").agg(F.sum("los").alias("loss"))

    models.fit_curves(items, profiles, DEFAULT, ["walk_power"], loss, tolerance=5.0)
    assert plans and not any("Join" in p for p in plans)


def test_bounds_of_order_buckets_are_not_copied_with_each_row(spark):
    values = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("v"), F.lit(1).alias("w")).groupBy("v").agg(F.sum("w").alias("w"))
    out = skew.with_order_bucket(values, "v", "w", "b", buckets=16)
    assert plan(out).count("aggregate(") == 0
    found = sorted((r.v, r.b) for r in out.collect())
    assert all(a[1] <= b[1] for a, b in zip(found, found[1:])) and 15 <= len({b for _, b in found}) <= 17
    odd = spark.createDataFrame([(None, 1), (float("nan"), 1), (1.0, None), (2.0, 1), (3.0, 1)], "v double, w int")
    assert sorted((str(r.v), r.b) for r in skew.with_order_bucket(odd, "v", "w", "b").collect()) == [("1.0", 0), ("2.0", 1), ("3.0", 2), ("None", 0), ("nan", 2)]


def test_pairs_of_cubes_are_dealt_out_before_they_are_multiplied(spark):
    tune(spark)
    at = lambda n, seed: search.with_axes(spark.range(n).select((F.rand(seed) * 10).alias("lon"), (F.lit(30.0) + F.rand(seed + 1) * 10).alias("lat"), (F.col("id") % 2).alias("k")))
    where, places = at(400, 1).drop("k").cache(), at(300, 3).cache()
    side = search.EARTH_M
    coarse = search._start(where, places, side, ["k"])
    fine = search._finer(coarse, where, places, side, side / 64, ["k"])
    cube = lambda r, s: tuple(int(r[a] // s) for a in search.AXES)
    own, others = {cube(r, side / 64) for r in where.collect()}, {(cube(r, side / 64), r.k) for r in places.collect()}
    assert {(tuple(r.p), (tuple(r.f), r.k)) for r in fine.collect()} == {(a, b) for a in own for b in others} and fine.count() == len(own) * len(others)
    assert fine.select(F.spark_partition_id().alias("i")).distinct().count() > 1

import math

from pyspark.sql import functions as F

from stopfield.functions import clock, geo, grid, numeric, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_parent_of_child_and_children_of_parent(spark):
    c = grid.cell(F.lit(-73.9), F.lit(40.7), 14)
    kids = one(spark, grid.children(grid.parent(c, 14, 11), 11, 14))
    assert len(set(kids)) == 64 and one(spark, c) in kids
    assert one(spark, grid.resolution(c)) == 14


def test_centre_lies_in_its_cell_and_disk_is_symmetric(spark):
    c = grid.cell(F.lit(2.17), F.lit(41.38), 16)
    assert one(spark, grid.cell(grid.centre_lon(c, 16), grid.centre_lat(c, 16), 16)) == one(spark, c)
    disk = one(spark, grid.disk(c, 16, 2))
    assert len(set(disk)) == 25 and one(spark, c) in disk


def test_h3_parent_bits(spark):
    assert one(spark, grid.h3_parent(F.lit(0x8928308280FFFFF), 8)) == 0x8828308281FFFFF


def test_haversine_of_one_degree(spark):
    assert abs(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) - 6371 * math.pi / 180) < 1e-9


def test_ring_area_and_centroid(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))])
    area = one(spark, geo.ring_area_km2(ring))
    assert abs(area - (grid.METRES_PER_DEGREE / 1000) ** 2 * math.cos(math.radians(0.5))) < 1e-6
    c = one(spark, geo.ring_centroid(ring))
    assert abs(c["lon"] - 0.5) < 1e-12 and abs(c["lat"] - 0.5) < 1e-12


def test_clock_passes_midnight(spark):
    assert one(spark, clock.seconds(F.lit(" 25:10:05"))) == 25 * 3600 + 605
    assert one(spark, clock.text(F.lit(90605))) == "25:10:05"
    assert one(spark, clock.seconds(F.lit("soon"))) is None
    assert one(spark, clock.compact_minutes(F.lit("530"))) == 330


def test_interpolation_is_clamped(spark):
    c = lambda v: one(spark, numeric.interpolate(F.lit(v), (1.0, 10.0), (1.0, 0.0)))
    assert c(0.0) == 1.0 and c(99.0) == 0.0 and abs(c(5.5) - 0.5) < 1e-12


def test_snap_rounds_half_to_even(spark):
    assert one(spark, numeric.snap(F.lit(12.5), 5.0)) == 10.0
    assert one(spark, numeric.snap(F.lit(17.5), 5.0)) == 20.0
    assert one(spark, numeric.snap(F.lit(None).cast("double"), 5.0)) is None


def test_t_distribution_known_values(spark):
    p = lambda t, v: spark.createDataFrame([(t, v)], "t double, v double").select(numeric.t_two_sided(F.col("t"), F.col("v"))).first()[0]
    assert abs(p(2.0, 10.0) - 0.0733880348) < 1e-8
    assert abs(p(5.0, 1.0) - 0.1256659164) < 1e-8
    assert abs(p(1.959963985, 1e8) - 0.05) < 1e-6


def test_tokens_and_slug(spark):
    assert sorted(one(spark, text.tokens(F.lit("The Metro Transit of Valley Línea")))) == ["linea", "valley"]
    assert one(spark, text.slug(F.lit(" São João / Feed "))) == "sao_joao_feed"

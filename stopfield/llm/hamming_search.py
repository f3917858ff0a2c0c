"""Exact top-k search on binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and an index lists the codes by the value of each. A query probes the index with all values that differ from
its own segment in r bits, for growing r, segment after segment. When segments 0..s have been probed up to r bits and the others up
to r - 1, every code within segments x r + s bits has been met: if a code were missed it would differ in more than r bits in each of the first
ones and in at least r in the others. A query ends when its k-th verified distance is that small. No distance is guessed and no list is cut.

Equal codes are one entry with the k + 1 least ids, which is all that a result can need; equal queries are searched once.

Defined cases: rows without a vector have no code and are neither found nor searched for; null and missing elements count as 0 bits; an item is not
among its own results; of equal distances the least id comes first; fewer than k other items give them all; repeated ids count once each;
empty tables give an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.llm.common import landed

BITS = 64
SEGMENTS = 4
TOP = 10
WHOLE = 3
"""Radii below this are probed in all segments before the results are looked at; from here on two segments at a time."""
EVERY = 50


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i of the code is set if element i of the vector is above zero. A vector of more than 64 elements is an error."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector_col, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    code = F.when(F.size(vector_col) <= BITS, code).otherwise(F.raise_error(F.concat(F.size(vector_col).cast("string"), F.lit(f" elements; codes have {BITS} bits"))).cast("long"))
    return vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code.alias("code"))


def _segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _met(queries: DataFrame, index: DataFrame, radius: int, s: int, segments: int) -> DataFrame:
    """(q, code) pairs whose segment ``s`` differs in exactly ``radius`` bits, that no earlier step has met and that are not farther than the
    k-th verified distance so far (``bound`` of the query)."""
    width = BITS // segments
    # one row with the C(width, radius) values of that weight
    masks = queries.sparkSession.range(0, 1 << width, 1, 1).filter(F.bit_count("id") == radius).agg(F.collect_list("id").alias("masks"))
    probes = queries.crossJoin(F.broadcast(masks)).select("q", "bound", F.explode("masks").alias("mask")).select("q", "bound", _segment(F.col("q"), s, width).bitwiseXOR(F.col("mask")).alias("probe"))
    new = _apart(F.col("q"), F.col("code")) <= F.col("bound")
    for other in range(segments):
        if other != s:
            apart = _apart(_segment(F.col("q"), other, width), _segment(F.col("code"), other, width))
            new = new & ((apart > radius) if other < s else (apart >= radius))
    # a merge join: the probes look small to the planner, which cannot see how many values a query makes, and must not be broadcast
    return probes.hint("merge").join(index.filter(F.col("s") == s), (F.col("probe") == F.col("value")) & new).select("q", "code", "first", "n")


def nearest_codes(items: DataFrame, queries: DataFrame, k: int = TOP, segments: int = SEGMENTS) -> DataFrame:
    """Per row of ``queries`` (id, code) the ``k`` nearest rows of ``items`` (id, code): query_id, rank, id, distance."""
    width, keep = BITS // segments, k + 1
    by_code = Window.partitionBy("code").orderBy("id")
    listed = items.withColumn("nth", F.row_number().over(by_code)).filter(F.col("nth") <= keep)
    entries = landed(listed.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = items.count()
    spread = entries.select("code", F.get("ids", F.lit(0)).alias("first"), F.size("ids").alias("n"), F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("code"), s, width).alias("value")) for s in range(segments)])).alias("x"))
    index = landed(spread.select("code", "first", "n", "x.s", "x.value"))
    active = landed(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)))
    best = None
    by_distance = Window.partitionBy("q").orderBy("distance", "first", "code")
    steps = [(r, [*range(segments)]) for r in range(WHOLE)] + [(r, [*range(s, min(s + 2, segments))]) for r in range(WHOLE, width + 1) for s in range(0, segments, 2)]
    for radius, probed in steps:
        covered = segments * radius + probed[-1]
        met = reduce(DataFrame.unionByName, [_met(active, index, radius, s, segments) for s in probed])
        met = met.withColumn("distance", _apart(F.col("q"), F.col("code")))
        both = met if best is None else best.unionByName(met)
        best = landed(both.withColumn("nth", F.row_number().over(by_distance)).filter(F.col("nth") <= keep).drop("nth"))
        so_far = best.withColumn("sum", F.sum("n").over(by_distance.rowsBetween(Window.unboundedPreceding, 0)))
        sure = so_far.groupBy("q").agg(F.min(F.when(F.col("sum") >= keep, F.col("distance"))).alias("kth"), F.max("sum").alias("found"))
        sure = sure.select(F.col("q").alias("d"), F.coalesce("kth", F.lit(BITS)).alias("kth"), (F.coalesce(F.col("kth") <= covered, F.lit(False)) | (F.col("found") >= total)).alias("done"))
        open_ones = active.join(sure, F.col("q") == F.col("d"), "left").filter(~F.coalesce("done", F.lit(False)))
        active = landed(open_ones.select("q", F.coalesce("kth", F.lit(BITS)).alias("bound")))
        if active.isEmpty():
            break
    wide = best.join(entries.withColumnRenamed("code", "of"), F.col("code") == F.col("of")).select("q", "distance", F.explode("ids").alias("id"))
    ranked = wide.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).filter(F.col("nth") <= keep).drop("nth")
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).distinct()
    results = asked.join(ranked, F.col("asked") == F.col("q")).filter(~F.col("id").eqNullSafe(F.col("query_id")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return results.select("query_id", place.alias("rank"), "id", "distance").filter(F.col("rank") <= k)


def vector_search(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, distance (differing sign bits)."""
    items = landed(sign_codes(vectors))
    found = nearest_codes(items, items.filter(F.col("id") % every == 0), k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


SQL = """
WITH coded AS (
  SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END)), lambda a, b: a | b) AS code
  FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code)::BIT)::INT AS distance
  FROM coded q JOIN coded v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

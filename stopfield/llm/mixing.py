"""Mixing sources to target weights: tokens per source, repetition rates, whole copies plus one seeded Bernoulli copy.

The rate of a source is its target over its size. A document of that source is taken floor(rate) times and once more with the probability of
the fraction; the draw is a digest of the seed and the document's id, so a second run, or a rerun of a lost task, takes the same copies.

Defined cases: a null or empty text has size 0; null sources form one source that comes last; rows that repeat an id share its draw; sources
without any word have rate 0; an empty table gives an empty result; other columns of the input are not read (``mixed`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopfield.llm.common import WORD, utf8

MOST_TIMES = 3.0
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
DRAW_DIGITS = 13
"""Hexadecimal digits of the draw: 52 bits, exact in a double."""


def words_in(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(utf8(text), F.lit(WORD))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform value in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / float(16**DRAW_DIGITS)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """Per source of ``sized`` (source, size): ``source_size`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at ``most`` times its
    source's size and the excess is shared again by weight until none is above. That end state is one level L with target = min(cap, L x
    weight): with the sources in order of cap / weight, L is the first, which is the largest, (total - caps before) / (weights from here on) that does not pass
    the next cap / weight. The windows run over one row per source, the list of a mixing recipe, never over documents; they are one task, so sources that
    are as many as documents (host names, say) should be grouped before.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    levelled = (
        ranked.withColumn("level", (F.sum("source_size").over(everything) - before) / onward)
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("held", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("held") * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with ``size``, ``source_size``, ``target`` and ``copies``, the times it is taken.

    ``keep`` names further columns to carry along.
    """
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep or [])]
    sized = docs.select("doc_id", "source", words_in(F.col("text")).cast("long").alias("size"), *kept)
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(rate)
    times = whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", times.cast("long").alias("copies"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep or [])])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES, seed: str = SEED) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, all columns of ``docs`` kept."""
    carried = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]  # no name of the input meets one of the mix
    rows = docs.select("doc_id", "source", "text", *carried)
    taken = copies(rows, weights, most, seed, keep=[f"in_{i}" for i in range(len(docs.columns))])
    repeated = taken.filter(F.col("copies") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words the mix takes of it, repeats counted."""
    taken = copies(docs)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM sources
), filled AS (
  SELECT *, sum(source_size) OVER () AS total, cap / weight AS fill,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM ranked
), levelled AS (
  SELECT *, max(CASE WHEN (total - before) / onward <= fill THEN (total - before) / onward END) OVER () AS held FROM filled
), targets AS (
  SELECT source, source_size, least(cap, coalesce(held * weight, cap)) AS target FROM levelled
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""

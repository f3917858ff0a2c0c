"""The registered queries of the text operators, each over its whole table, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopfield.llm import bpe, conversation_repair, hamming_search, html_extract, language_id, line_dedup, mixing, order_minhash, periodic_runs, quality, simhash_dedup, suffix_dedup, url_filter
from stopfield.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(read_table(spark, sf_dir, "documents"))


@register("op2_line_dedup", line_dedup.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_lines(read_table(spark, sf_dir, "documents"))


@register("op3_hamming_search", hamming_search.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.vector_search(read_table(spark, sf_dir, "embeddings"))


@register("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(read_table(spark, sf_dir, "documents"))


@register("op5_html_extract")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read_table(spark, sf_dir, "pages"))


@register("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_report(read_table(spark, sf_dir, "documents"))


@register("op7_source_mix", mixing.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


@register("op8_quality_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op9_bpe_tokens")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), byte_vocabulary())


@register("op10_url_filter", url_filter.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), rules)


@register("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(read_table(spark, sf_dir, "documents"))


@register("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(conversations), conversations)


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(read_table(spark, sf_dir, "documents"))

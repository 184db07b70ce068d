"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import oracle
from tidewell.llm.scratch import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import quality

    rows = quality.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import chosen_path

    return chosen_path.link(table(spark, sf_dir, "documents"), width=2)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import mixing

    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import direct_codes

    docs = table(spark, sf_dir, "documents")
    return direct_codes.digest(direct_codes.write(docs, direct_codes.new_folder(spark)))


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import merge_dropout

    return merge_dropout.digest(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import warc

    return warc.digest(table(spark, sf_dir, "pages"))


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import transport_stream

    return transport_stream.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import toxicity

    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import fuzzy_lines

    return fuzzy_lines.digest(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm import secrets

    return secrets.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op1_near_dedup": op1_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op10_secrets": op10_secrets,
    "op3_warc": op3_warc,
    "op5_transport_stream": op5_transport_stream,
    "op2_merge_dropout": op2_merge_dropout,
    "op4_source_mix": op4_source_mix,
    "op8_direct_codes": op8_direct_codes,
    "op7_quality_rules": op7_quality_rules,
}
ORACLE_SQL = oracle.SQL

"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the docs of the next
one. All but the last return the columns of ``documents``; the last adds ``piece_ids`` and ``lossless``, which tells whether they
decode to the text again, and leaves ``text`` out. Stages work on whole
texts and on every row that their predecessor kept. A document drawn twice by the mix is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import chosen_path, fuzzy_lines, merge_dropout, mixing, quality
from tidewell.llm.scratch import drop, keep, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go. Null text has no words and goes, null lang and source are groups of their own; repeated
    rows are judged alike and all stay or go; extra columns pass through; an empty table stays empty."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of alike lines stays, in the document of the smallest doc_id (null last; several texts of one doc_id
    by their hashes); a document without lines left goes. Null and empty texts and lines without words stay as they are; rows
    equal in doc_id and text lose the same lines; extra columns pass through; an empty table stays empty."""
    small_batches(spark)
    return fuzzy_lines.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id: five-word shingles, similarity 0.8. Texts without words and rows without
    doc_id stay; rows that repeat the doc_id that stays stay too; extra columns pass through; an empty table stays empty."""
    small_batches(spark)
    return chosen_path.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives words up to its target: a row is drawn 0, 1 or 2 times. Null text and texts without words are never drawn, null
    source is a source, rows with equal doc_id are drawn one by one; extra columns pass through; an empty table stays empty."""
    return mixing.mixed_rows(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it. Null text encodes and decodes as the empty text; repeated rows encode
    alike; extra columns pass through but for ``text``; an empty table stays empty."""
    small_batches(spark)
    return merge_dropout.encode_checked(docs).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("piece_encoding", piece_encoding),
]

#: Components, sketches and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

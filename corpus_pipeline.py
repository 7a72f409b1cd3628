"""Corpus pipeline: quality, language, near-duplicates, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last
return the columns of ``docs`` as they were; the last gives the ids of each remaining document. ``run``
writes every stage to the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm.common import read_table, saved
from tierflow.llm.decontaminate import remove_matches
from tierflow.llm.language import keep_languages
from tierflow.llm.ngram_join import keep_one_of_each
from tierflow.llm.pieces import encode_pieces
from tierflow.llm.quality_model import keep_quality
from tierflow.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score above the learned quantile stay."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents clearly in one of the learned languages stay, whichever it is."""
    return keep_languages(docs, min_score=0.5, typical=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that mostly consist of them go."""
    return remove_matches(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, verified against the SentencePiece library."""
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# The learned models and the tokenizer cannot be expressed in SQL; tests/llm compares the stages with
# plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

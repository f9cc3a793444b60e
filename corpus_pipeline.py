"""The corpus pipeline: what is kept of documents, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of documents. An empty table gives an empty
one in every stage, whole texts of any length are read, extra columns pass
through, whatever their names. Rows with a null doc_id stay until the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mdmill.llm import bpe, exact_dedup, language, mixing, ngram_join
from mdmill.session import save, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: null, empty and letterless texts, and texts far from every centroid.

    Of the latter, rows with a null id stay; rows that repeat an id go together.
    """
    return language.drop_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the smallest doc_id stays, and one of rows that repeat it. Rows with a null id stay."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8), the one with the smallest doc_id.

    Texts without words are in no group. Of rows that repeat an id and its text one stays. Rows with a null id stay.
    """
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that every source has the same weight; some go. A null source is one of its own, null ids share one draw."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy; a null text counts as empty, a null id passes through."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("poisson_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

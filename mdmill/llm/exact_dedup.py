"""Exact dedup by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import drop_ids, maybe_in, membership_bitmap, one_row_each, text_of
from mdmill.session import save, table

#: Code points that the second level hashes.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def find_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False
) -> DataFrame:
    """(id, n_chars, text_sha256, keep_id, group_size, kept), a row for each row of docs.

    Texts are equal when their normalised forms are. Level 1 counts rows by
    length, level 2 rows by length and the hash of a prefix, level 3 rows by
    the SHA-256 of the whole text, which is read only for rows whose length and
    prefix another row shares. The keys that are shared reach the scan as a
    bitmap of fixed size, so no text is ever shuffled. Every count aggregates
    before it shuffles, and the last join can split a hot group.

    A null text counts as empty. Of equal texts the smallest id stays; null ids
    sort last. A row that repeats another row's id and text has the same
    keep_id and the same `kept`. An empty table gives an empty result. Other
    columns of docs are ignored. text_sha256 is null for texts that no other
    row can equal, unless hash_all asks for all of them.
    """
    text = normalised(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).select(
        "doc_id",
        "norm",
        F.length("norm").alias("n_chars"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"),
    )
    lengths = rows.groupBy("n_chars", "prefix").agg(F.count("*").alias("n"))
    shared_length = lengths.groupBy("n_chars").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    shared = lengths.where("n > 1").join(shared_length, "n_chars", "left_semi")
    key = F.xxhash64("n_chars", "prefix")
    bitmap = membership_bitmap(shared, key)
    full = F.sha2("norm", 256)
    hashed = maybe_in(rows, bitmap, key, "suspect").select(
        "doc_id",
        "n_chars",
        "suspect",
        (full if hash_all else F.when(F.col("suspect"), full)).alias("text_sha256"),
    )
    hashed, _ = save(hashed, "hashed")
    groups = (
        hashed.where("suspect")
        .groupBy(F.col("text_sha256").alias("sha"))
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        .where("n > 1")
    )
    return hashed.join(
        groups, F.col("suspect") & (F.col("text_sha256") == F.col("sha")), "left"
    ).select(
        "doc_id",
        "n_chars",
        "text_sha256",
        F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("sha").isNull(), True)
        .otherwise(F.col("doc_id").eqNullSafe(F.col("least")))
        .alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a smaller id has; all columns stay.

    Ids must identify texts. Of rows that repeat an id and its text one stays;
    rows with a null id stay.
    """
    kept = drop_ids(docs, find_copies(docs, id_col, text_col).where(~F.col("kept")).select("doc_id"), id_col)
    return one_row_each(kept, F.sha2(normalised(text_of(text_col)), 256), id_col=id_col)


def op3_exact_dedup(spark, sf_dir):
    return find_copies(table(spark, sf_dir, "documents"), hash_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

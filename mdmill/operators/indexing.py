"""Searches of a vector index, new vectors for a version, and vectors of a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdmill.functions import rules, text
from mdmill.functions.semantics import DIMENSION, bare, pieces, sparse_vectors
from mdmill.operators.knowledge import build_index
from mdmill.operators.vectors import build_cells, search_cells
from mdmill.session import save, spread


def dense_vectors(items: DataFrame, words: Column, dimension: int = DIMENSION) -> DataFrame:
    """(id, vector): sparse_vectors as whole arrays; text without pieces has no row."""
    sparse = sparse_vectors(items, words, dimension).withColumn("m", F.map_from_arrays("idx", "w"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return sparse.select("id", whole.alias("vector"))


def search_index(queries: DataFrame, index: DataFrame, k: int = 5, namespace: str | None = None, plant: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k rows of the index with the largest cosine to each query, ties by key.

    queries (query_id, text), index as build_index makes it. namespace keeps
    its rows; plant keeps rows whose array plant_codes names it or GROUP (the
    plant GROUP sees all). A query without letters scores 0 everywhere.
    """
    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50")
    rows = index if namespace is None else index.where(F.col("namespace") == namespace)
    if plant is not None and plant != "GROUP":
        rows = rows.where(F.array_contains("plant_codes", plant) | F.array_contains("plant_codes", "GROUP"))
    asked = queries.groupBy("text").agg(F.min("query_id").alias("id"))
    vectors = dense_vectors(asked.select("id", "text"), pieces(bare(F.col("text"))))
    asked, _ = save(asked.join(vectors, "id", "left"), "asked")
    cells = build_cells(rows.select("key", "idx", "w"), DIMENSION)
    found = search_cells(asked.select(F.col("id").alias("query_id"), "vector"), cells, k, DIMENSION)
    known = queries.join(asked.select("text", F.col("id").alias("of")), "text").select("query_id", "of")
    return known.join(found.withColumnRenamed("query_id", "of"), "of").select("query_id", "key", "score", "rank")


def standard_index(spark: SparkSession) -> DataFrame:
    """The vector index of the standard's categories, as build_index makes it."""
    rows = [(i, " ".join((category, title, words, prefix))) for i, category, prefix, title, words in rules.STANDARDS]
    return build_index(spark.createDataFrame(rows, "key string, content string"), namespace="standard_kb")


def standard_search(queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, key, score, rank): the k categories of the standard nearest to each standardised query text (query_id, text)."""
    standard = queries.select("query_id", text.standardize(F.col("text")).alias("text"))
    return search_index(standard, standard_index(queries.sparkSession), k, "standard_kb")


def reindex(chunks: DataFrame, current: DataFrame, version, dimension: int) -> DataFrame:
    """(chunk_id, version_id, dimension, content_hash, idx, w): current with the vectors of one version made anew at a dimension.

    chunks (chunk_id, version_id, content, content_hash). Rows of other
    versions stay; of the version, the rows are those of chunks. Equal texts
    are computed once.
    """
    fresh = chunks.where(F.col("version_id") == version)
    texts = fresh.select(F.col("content_hash").alias("id"), "content").dropDuplicates(["id"])
    vectors = sparse_vectors(spread(texts), pieces(bare(F.col("content"))), dimension)
    part = lambda f, kind: F.coalesce(f, F.array().cast(f"array<{kind}>")).alias(f)
    made = fresh.join(vectors, F.col("content_hash") == F.col("id"), "left").select(
        "chunk_id", "version_id", F.lit(dimension).alias("dimension"), "content_hash", part("idx", "int"), part("w", "double")
    )
    return current.where(~F.col("version_id").eqNullSafe(F.lit(version))).select(made.columns).unionByName(made)


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int, provider: str = "model", batch: int = 10) -> DataFrame:
    """(id, provider, vector): vectors of texts (id, text, allowed) by a user's model, or hashed locally.

    The model gets lists of at most `batch` distinct non-blank texts that may
    leave (allowed is true). A list on which it fails, and each vector of
    another length or with a number that is not finite, falls back to the local
    vector, as blank texts do (all zeros). The vectors are written once, so a
    model that varies is asked once a text.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                words = frame["text"].iloc[i : i + batch].tolist()
                try:
                    found = [None if v is None else [float(x) for x in v] for v in model(words)]
                except Exception:  # whatever a user's model raises, its texts are hashed locally
                    found = []
                yield pd.DataFrame({"text": words, "vector": found if len(found) == len(words) else [None] * len(words)})

    rows, _ = save(texts.select("id", text.clean(F.col("text")).alias("text"), F.coalesce("allowed", F.lit(False)).alias("allowed")), "texts")
    leaving = rows.where("allowed AND text <> ''").select("text").distinct()
    made, _ = save(leaving.mapInPandas(ask, "text string, vector array<double>"), "vectors")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = made.where((F.size("vector") == dimension) & finite).select("text", F.col("vector").alias("made"), F.lit(True).alias("allowed"))
    served, _ = save(rows.join(good, ["text", "allowed"], "left"), "served")
    rest = served.where("made IS NULL").select("text", F.col("text").alias("id")).distinct()
    local = dense_vectors(rest, pieces(bare(F.col("text")))).select(F.col("id").alias("text"), F.col("vector").alias("own"))
    zero = F.array_repeat(F.lit(0.0), DIMENSION)
    return served.join(local, "text", "left").select(
        "id", F.when(F.col("made").isNotNull(), provider).otherwise("local").alias("provider"), F.coalesce("made", "own", zero).alias("vector")
    )

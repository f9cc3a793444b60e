"""Language ID: the nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import drop_ids, in_arrow, text_of
from mdmill.session import table

#: Hashed dimensions of the byte 3-gram vectors, and centroids per language.
DIMENSIONS, CLUSTERS = 4096, 4
#: Labelled rows per language that the centroids are fitted on (about; drawn by hash).
FIT_ROWS = 2000
#: Clusters with a smaller share of a language's fitted rows are merged into the nearest other one.
LEAST_CLUSTER = 0.02
#: A text of 2^REJECT_BITS bytes or more is rejected when its cosine is below this share of the
#: cosine that 99 of 100 fitted rows of the language reach. Short texts have few 3-grams and low
#: cosines in any language, so the bar falls with the power 1.5 of the logarithm of the length.
REJECT_SHARE, REJECT_BITS = 0.6, 13
#: Bytes and documents that are turned into vectors together.
BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 128

#: ASCII letters in lower case, bytes of other scripts as they are, all else a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte 3-grams of each text, with a space on either side."""
    rows = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    data = np.frombuffer(b"".join(b" %b " % t.translate(_LOWER) for t in texts), np.uint8).astype(np.uint32)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    same = (rows[:-2] == rows[2:]) & (code != 0x202020)
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    flat = rows[:-2][same] * DIMENSIONS + slot[same]
    return np.bincount(flat, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(np.float32)


def _text_blocks(batch, column: int):
    """(start, texts) over a record batch; a long text is a block of its own and counted in pieces."""
    block, start, size = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = (value.as_py() or "").encode()
        if block and (size + len(text) > BLOCK_BYTES or len(block) == BLOCK_ROWS):
            yield start, block
            block, start, size = [], i, 0
        block.append(text)
        size += len(text)
    if block:
        yield start, block


def _counts(texts: list[bytes]) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
        pieces = (texts[0][i : i + BLOCK_BYTES + 2] for i in range(0, len(texts[0]), BLOCK_BYTES))
        return sum(gram_counts([p]) for p in pieces)
    return gram_counts(texts)


def _vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(_counts(texts)) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(slot, n): in how many of all rows' texts each dimension occurs; a task sends one row a dimension."""

    def run(batches):
        found = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for _, texts in _text_blocks(batch, 0):
                found[:-1] += (_counts(texts) > 0).sum(axis=0)
                found[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1), pa.int32()), pa.array(found)], names=["slot", "n"])

    counts = in_arrow(rows.select("text"), run, "slot int, n long")
    return counts.groupBy("slot").agg(F.sum("n").alias("n"))


def spherical_clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """k-means by cosine from the farthest-first rows; the centroids and each row's centroid."""
    picks = [0]
    while len(picks) < min(k, len(vectors)):
        picks.append(int((vectors @ vectors[picks].T).max(axis=1).argmin()))
    centroids = vectors[picks].copy()
    for _ in range(rounds):
        at = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (at == c).any():
                mean = vectors[at == c].mean(axis=0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def fit(docs: DataFrame, train: Column | None = None):
    """(languages, centroids, least cosines, idf), small arrays.

    Document frequencies cover every labelled training row; the centroids are
    fitted on about FIT_ROWS rows a language, drawn by a hash of id and text, which
    bounds what a language's task holds (FIT_ROWS x DIMENSIONS numbers).
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(train) if train is not None else rows
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    frequency = np.zeros(DIMENSIONS + 1)
    for r in document_frequencies(rows).collect():
        frequency[r["slot"]] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])).astype(np.float32) + np.float32(0.1)
    if not n:
        return [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), idf
    share = F.create_map(*(F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, FIT_ROWS / k))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def to_vectors(batches):
        for batch in batches:
            for start, texts in _text_blocks(batch, 1):
                v = _vectors(texts, idf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(list(v), pa.list_(pa.float32()))], names=["lang", "v"]
                )

    def cluster(pdf):
        vectors = np.stack(pdf["v"].to_numpy())
        centroids, at = spherical_clusters(vectors, CLUSTERS)
        held = np.bincount(at, minlength=len(centroids))
        centroids = centroids[held >= min(LEAST_CLUSTER * len(vectors), held.max())]
        least = float(np.quantile((vectors @ centroids.T).max(axis=1), 0.01))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(centroids), "least": least})

    found = (
        in_arrow(drawn.select("lang", "text"), to_vectors, "lang string, v array<float>")
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, centroid array<float>, least double")
        .orderBy("lang", "least")
        .collect()
    )
    centroids = np.array([r["centroid"] for r in found], np.float32).reshape(-1, DIMENSIONS)
    return [r["lang"] for r in found], centroids, np.array([r["least"] for r in found]), idf


def reject_bars(least: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The cosine under which each text is rejected, from the least cosine of its language."""
    bits = np.log2([len(t) + 1 for t in texts])
    return REJECT_SHARE * least * np.minimum(bits / REJECT_BITS, 1.0) ** 1.5


def predict(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row for each row of docs.

    lang_pred is the language of the nearest centroid by cosine, the cosine is
    the score. A text with no letter, or null, is `und`, score 0, rejected; so
    is every text when no language was learned, though not rejected. rejected
    marks texts that lie far from every centroid for their length. Ties go to the language that
    sorts first. Repeated rows and null ids pass through; other columns are
    ignored. Long texts are counted in pieces, so a task holds one block.
    """
    languages, centroids, least, idf = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, centroids, least, idf))

    def run(batches):
        languages, centroids, least, idf = shared.value
        for batch in batches:
            lang, score, far = [], [], []
            for _, texts in _text_blocks(batch, 1):
                near = _vectors(texts, idf) @ centroids.T
                best = near.argmax(axis=1)
                top = near[np.arange(len(texts)), best]
                lang += [languages[i] for i in best]
                score += np.clip(top, 0.0, 1.0).astype(float).tolist()
                far += (top < reject_bars(least[best], texts)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
                names=["doc_id", "lettered", "lang_pred", "score", "rejected"],
            )

    rows = docs.select("doc_id", text_of().alias("text")).withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    if not languages:
        return rows.select(
            "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), (~F.col("lettered")).alias("rejected")
        )
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = in_arrow(rows, run, f"doc_id {kind}, lettered boolean, lang_pred string, score double, rejected boolean")
    return found.select(
        "doc_id",
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
        (~F.col("lettered") | F.col("rejected")).alias("rejected"),
    )


def drop_unknown(docs: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay.

    Texts without a letter go by themselves, texts far from every language by
    id; of the latter, rows with a null id stay.
    """
    rejected = predict(docs, fit(docs, ~is_held_out())).where("rejected").select("doc_id")
    return drop_ids(docs.where(text_of().rlike(r"\p{L}")), rejected)


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, ~is_held_out()))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")

"""Target-distribution importance resampling: documents that look like the target's are drawn more often.

Words and their offsets come from an untrained pre-tokeniser of the tokenizers
library, a Regex Split. A feature is a window of consecutive offset pairs; its
CRC-32 gives its bucket. Two histograms of buckets give each bucket a gain, a
document's weight is the mean gain of its features, and a Gumbel number from
the document's id turns weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from mdmill.llm.common import in_arrow, text_of
from mdmill.session import drop, save, table

#: A word: digits, lower-case letters and all that is not ASCII.
WORD = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer words are not drawn; of the others this share is, in hundredths.
LEAST_WORDS, PERCENT = 20, 10
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Features(NamedTuple):
    """(*kept, n_words, n_features, packed) rows, packed holding the buckets as 4-byte numbers, and their folder."""

    rows: DataFrame
    path: str


def bucketed(docs: DataFrame, kept: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> Features:
    """The buckets of each text's features, stored, so that texts are cut into words once.

    Features are all runs of 1 to `longest` consecutive words, joined by one
    space, repeats counted. Null texts have none.
    """

    def run(batches):
        split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        for batch in batches:
            words, features, packed = [], [], []
            for value in batch.column(len(kept)):
                text = (value.as_py() or "").encode().translate(_LOWER)
                cut = PreTokenizedString(text.decode())
                split.pre_tokenize(cut)
                at = [pair for _, pair, _ in cut.get_splits("original", "byte")]
                found = [zlib.crc32(text[a:b]) % buckets for a, b in at]
                for n in range(2, longest + 1):
                    for i in range(len(at) - n + 1):
                        found.append(zlib.crc32(b" ".join(text[a:b] for a, b in at[i : i + n])) % buckets)
                words.append(len(at))
                features.append(len(found))
                packed.append(np.array(found, np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())],
                names=[*kept, "n_words", "n_features", "packed"],
            )

    texts = docs.select(*(F.col(f"`{c}`") for c in kept), text_of().alias("__text"))
    schema = StructType([*texts.drop("__text").schema.fields]).add("n_words", "long").add("n_features", "long").add("packed", "binary")
    return Features(*save(in_arrow(texts, run, schema), "features"))


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. A task sends a row a bucket, the driver gets as many."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts += np.bincount(np.frombuffer(value.as_py(), np.uint32), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in in_arrow(features.select("packed"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: thousand times the log of how much likelier the target holds it, add-one smoothed, floored."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, gain, kept: list[str]) -> DataFrame:
    """(*kept, n_words, n_features, weight): the floored mean gain of each document's features, 0 without features."""

    def run(batches):
        of = gain.value
        for batch in batches:
            sums = [int(of[np.frombuffer(v.as_py(), np.uint32)].sum()) for v in batch.column(len(kept) + 2)]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column(len(kept) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 2], pa.array(weight, pa.int64())], names=[*kept, "n_words", "n_features", "weight"])

    return in_arrow(features, run, StructType([*features.drop("packed").schema.fields]).add("weight", "long"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousand times a Gumbel number from a SHA-256 of seed and id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(unit)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs; rank is null where a row is not drawn.

    Of the rows with at least `least_words` words, the floor of `percent` in a
    hundred with the highest scores are drawn; ties go to the smaller doc_id.

    Scores are whole numbers in a range that the formula bounds (some 10^5
    values, however many rows), so the driver holds a count for each and finds
    where the draw ends; ranks are then counted inside one score. Rows that
    are equal in all columns are one row with a count there, so no key holds
    more than the distinct ids of one score.

    Null texts have no features and weight 0; a null doc_id counts as the id
    `null` and comes last in ties; rows that repeat an id and a text get
    ranks one after another. An empty target leaves the gains to the source's
    histogram alone, empty docs give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    of_docs, of_target = bucketed(docs, ["doc_id"], longest, buckets), bucketed(target, [], longest, buckets)
    gain = spark.sparkContext.broadcast(gains(histogram(of_docs.rows, buckets), histogram(of_target.rows, buckets)))
    scored, _ = save(
        weighted(of_docs.rows, gain, ["doc_id"])
        .groupBy("doc_id", "n_words", "n_features", "weight")
        .agg(F.count("*").alias("n"))
        .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)),
        "scored",
    )
    drop(spark, of_docs.path, of_target.path)
    gain.destroy()

    able = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.sum("n").alias("n")).collect()), reverse=True)
    drawn, before, starts = sum(n for _, n in counts) * percent // 100, 0, []
    for score, n in counts:
        if before >= drawn:
            break
        starts.append((score, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "at long, before long"))

    in_score = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = scored.where(able).join(starts, F.col("score") == F.col("at"))
    placed = placed.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(in_score), F.lit(0)))
    rest = scored.join(starts, able & (F.col("score") == F.col("at")), "left_anti").withColumn("before", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "before", "n"]
    each = placed.select(*columns).unionByName(rest.select(*columns)).withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rank = F.col("before") + F.col("place")
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with all their columns; see resample.

    Of rows that repeat an id all stay when one is drawn; rows with a null id go.
    """
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col("__drawn"), "left_semi")


def op11_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 is written out: a table of its 256 remainders, then a step a byte.
OP11_SQL = r"""
WITH RECURSIVE rem(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS g(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM rem WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM rem WHERE k = 8),
cut AS (
  SELECT true AS of_docs, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents
  UNION ALL SELECT false, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')
  FROM benchmark),
w AS (SELECT of_docs, doc_id, unnest(words) AS word FROM cut),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(word))) + 1, 2), lambda p: ('0x' || substr(hex(encode(word)), p, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, step[xor(a & 255, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), crc),
h AS (SELECT bucket, count(*) FILTER (of_docs) AS s, count(*) FILTER (NOT of_docs) AS t FROM w JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM h) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM h) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM h),
d AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE of_docs GROUP BY doc_id),
s AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM cut LEFT JOIN d USING (doc_id) WHERE of_docs),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM s LEFT JOIN r USING (doc_id)
"""

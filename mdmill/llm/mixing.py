"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.session import save, table

SEED = "mix-1"
#: Bytes of the mix as a multiple of the bytes of the input.
EPOCHS = 1.0
#: Up to so many sources their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Means above this are drawn as a sum of smaller ones, so that exp(-mean) is above zero.
LARGEST_MEAN = 500.0


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(mean: Column, unit: Column) -> Column:
    """Invert the Poisson distribution: how many k have P(X <= k) <= unit."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("cdf"), F.lit(0).alias("n"))

    def step(acc, k):
        cdf = acc["cdf"] + acc["p"]
        return F.struct(
            (acc["p"] * mean / k).alias("p"), cdf.alias("cdf"), (acc["n"] + (cdf <= unit).cast("int")).alias("n")
        )

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["n"])


def repetition_counts(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """docs (doc_id, source, size) with `rate` and `copies`.

    A source's rate is the bytes that its weight asks for over the bytes it
    has; copies is Poisson with that mean, from a hash of seed and doc_id. No
    weights: every source gets the same. A source without a weight gets none.
    Sums per source aggregate before they shuffle.
    """
    totals = docs.groupBy("source").agg(F.sum("size").alias("bytes"))
    totals, _ = save(totals, "totals")
    n, total = totals.agg(F.count("*"), F.sum("bytes")).first()
    if weights is None:
        weight = F.lit(1.0 / max(n, 1))
    elif weights:
        whole = sum(weights.values())
        known = F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, w / whole)))
        weight = F.coalesce(known[F.col("source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    rates = totals.select(
        F.col("source").alias("of"),
        F.when(F.col("bytes") > 0, F.lit(epochs * float(total or 0)) * weight / F.col("bytes"))
        .otherwise(0.0)
        .alias("rate"),
    )
    rates = F.broadcast(rates) if n <= BROADCAST_SOURCES else rates
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    one = lambda i: poisson(
        F.col("rate") / parts, hash_unit(F.lit(seed), doc, i.cast("string"))
    )
    copies = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + one(i))
    return docs.join(rates, F.col("source") == F.col("of")).drop("of").withColumn("copies", copies)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "source": F.coalesce(F.col("source"), F.lit("")),
            "size": F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"),
        }
    )


def mix_order(seed: str = SEED) -> Column:
    """The place of a copy in the global shuffle: copies sorted by it are in random order."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.sha2(F.concat_ws(":", F.lit(seed), F.lit("place"), doc, F.col("copy").cast("string")), 256)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs, each row as often as its copies say, in a random order over all partitions.

    Copies are dealt by the hash of their place, which is a hash itself, and
    sorted by it, so the order is random throughout and no pass has to sample
    the places first.

    The rows have docs' columns. Copies of a row are equal. Rows with 0 copies
    are left out: their source has more bytes than its weight asks for. A null
    source counts as the source ''. A source of only empty texts has no bytes
    and gets no copies. Rows that repeat a doc_id get the same copies each. An
    empty table gives an empty one. Clashing column names: a column `size`,
    `rate`, `copies` or `copy` of docs is kept as it is.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = _sized(docs.select(kept, "doc_id", "source", "text")).drop("text")
    drawn = repetition_counts(rows, weights, epochs, seed).where("copies > 0")
    spread = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return (
        spread.withColumn("__place", mix_order(seed))
        .repartition("__place")
        .sortWithinPartitions("__place")
        .select("__row.*")
    )


def op5_poisson_mix(spark, sf_dir):
    """One row for each copy: doc_id, source, copy, copies, place (its sort key in the global order)."""
    rows = _sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    drawn = repetition_counts(rows).where("copies > 0")
    return (
        drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select("doc_id", "source", "copy", "copies", mix_order().alias("place"))
        .repartition("place")
        .sortWithinPartitions("place")
    )


OP5_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, '')) AS size,
         ('0x' || substr(sha256(concat('mix-1:', doc_id, ':1')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
t AS (SELECT source, sum(size)::DOUBLE AS bytes FROM d GROUP BY source),
r AS (SELECT source, (SELECT sum(bytes) FROM t) * (1.0 / (SELECT count(*) FROM t)) / bytes AS rate FROM t WHERE bytes > 0),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 120) AS g(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
n AS (SELECT doc_id, source, (SELECT count(*) FROM c WHERE c.source = d.source AND c.cdf <= d.u) AS copies
      FROM d JOIN r USING (source))
SELECT doc_id, source, g.k::INT AS copy, copies::INT AS copies,
       sha256(concat('mix-1:place:', doc_id, ':', g.k)) AS place
FROM n, range(1, 120) AS g(k) WHERE g.k <= copies
"""

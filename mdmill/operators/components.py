"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.session import drop, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): component is the smallest id reachable over the edges.

    Alternates two shrinking steps over (node, smaller neighbour) pairs until
    nothing changes: every node hangs its larger neighbours under its smallest
    one, then every node hangs all its smaller neighbours under the smallest.
    The number of rounds grows with the logarithm of the longest chain. Each
    step groups by node with a partial minimum and joins that minimum back, so
    a hub is never gathered into one row; AQE splits a hub's partition in the
    join. Nodes without an edge to another node do not appear. Null ends and
    self loops are ignored.
    """
    spark = edges.sparkSession
    pairs, path = save(
        edges.select(
            F.greatest(src, dst).alias("a"),
            F.least(src, dst).alias("b"),
        )
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    while True:
        old_path, before = path, _signature(pairs)
        both = pairs.union(pairs.select(F.col("b"), F.col("a")).toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m")
        )
        hung = (
            both.where("b > a")
            .join(low, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        low2 = hung.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        flat = hung.join(low2, F.col("a") == F.col("n")).select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        pairs, path = save(flat.select("e.*").where("a <> b").distinct(), "edges")
        drop(spark, old_path)
        if _signature(pairs) == before:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )


def _signature(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*").alias("n"),
        F.sum(F.hash("a", "b").cast("long")).alias("h"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x"),
    ).first()
    return tuple(row)

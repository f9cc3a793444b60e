"""Batch sinks and small text functions, with nulls and empty tables."""

from pyspark.sql import functions as F

from mdmill.functions import text
from mdmill.session import scratch_root
from mdmill.sources import sinks


def test_batches_replace_themselves(spark, tmp_path):
    path = f"{scratch_root(spark)}/{tmp_path.name}"
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch_id long, v string")
    sinks.write_batches(first, path)
    sinks.write_batches(first.where("batch_id = 1").limit(1), path)
    sinks.write_batches(first.limit(0), path)
    assert {r["batch_id"]: r["n"] for r in spark.read.parquet(path).groupBy("batch_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 1}
    sinks.clear(first, path)
    left = spark.read.parquet(path)
    assert left.count() == 0 and left.columns == ["batch_id", "v"]


def test_text_functions(spark):
    rows = [(1, "1.6MPa", [" a", "A", ""], '{"k": 1}', [1.0, 2.0]), (2, "x", [], "no", [1.0]), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, p string, w array<string>, j string, v array<float>")
    found = df.select(
        "id",
        text.pressure_number(F.col("p")).alias("p"),
        text.access_list(F.col("w"), "GROUP").alias("w"),
        text.parsed_map(F.col("j")).alias("j"),
        text.checked_vector(F.col("v"), 2).alias("v"),
    )
    assert [tuple(r) for r in found.sort("id").collect()] == [
        (1, 1.6, ["A"], {"k": "1"}, [1.0, 2.0]),
        (2, None, ["GROUP"], {}, []),
        (3, None, ["GROUP"], {}, []),
    ]

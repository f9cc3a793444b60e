"""Sinks of governed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_batches(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Write whole batches under path, a folder each; a batch written again replaces its earlier rows, others stay.

    Rows are rebalanced by batch, and a batch far larger than others is cut
    into several files, so no task writes all of a hot one.
    """
    rows = df.hint("rebalance", batch)
    rows.write.partitionBy(batch).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def clear(df: DataFrame, path: str) -> None:
    """Leave an empty table with the columns of df under path."""
    df.where("false").write.mode("overwrite").parquet(path)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.session import drop, save

#: Bits of a membership bitmap for each key, and its least and most bits.
KEY_BITS, BITMAP_BITS = 16, (1 << 20, 1 << 29)


#: Bytes of text that reach a Python worker at a time; a session's own lower bound stands.
BATCH_BYTES, BATCH_BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of at most BATCH_BYTES (or one row).

    Texts differ in length by orders of magnitude, so a bound on rows does not
    bound memory. The bound is a setting of the session, which stays. At the
    end of a task the worker hands Arrow's free memory back.
    """
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_BYTES_KEY).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


class Bitmap(NamedTuple):
    """(bucket, bits) rows of 4 KB, and how many bits there are in all."""

    rows: DataFrame
    size: int


def membership_bitmap(keys: DataFrame, hashed: Column) -> Bitmap:
    """A saved bitmap of the hashed keys, with KEY_BITS bits a key.

    It has BITMAP_BITS[1] bits (64 MB) at most, so it may be broadcast. A key
    that is in it always tests true; another key does so only by a clash, and
    the exact join that follows sorts those out. Beyond some 10^9 keys most
    keys clash, and that join sees most rows.
    """
    hashes, path = save(keys.select(hashed.alias("h")), "keys")
    size = 1 << int(max(hashes.count() * KEY_BITS, 1)).bit_length()
    size = min(max(size, BITMAP_BITS[0]), BITMAP_BITS[1])
    slots = hashes.select(F.pmod("h", F.lit(size)).alias("slot"))
    rows, _ = save(
        slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")),
        "bitmap",
    )
    drop(keys.sparkSession, path)
    return Bitmap(rows, size)


def maybe_in(df: DataFrame, bitmap: Bitmap, hashed: Column, flag: str) -> DataFrame:
    """df with the boolean column `flag`: may the row's key be in the bitmap?"""
    slot = F.pmod(hashed, F.lit(bitmap.size))
    bits = bitmap.rows.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    return (
        df.withColumns(
            {"__slot": F.bitmap_bucket_number(slot), "__pos": F.bitmap_bit_position(slot)}
        )
        .join(F.broadcast(bits), F.col("__slot") == F.col("__bucket"), "left")
        .withColumn(
            flag,
            F.expr(
                "__bits IS NOT NULL AND getbit(cast(conv(hex(substring(__bits,"
                " cast(__pos div 8 AS int) + 1, 1)), 16, 10) AS int), cast(__pos % 8 AS int)) = 1"
            ),
        )
        .drop("__slot", "__pos", "__bucket", "__bits")
    )


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (one column); rows with a null id stay.

    Only rows that a bitmap of ids lets through are joined, so the texts of
    nearly all rows that stay are not shuffled.
    """
    gone, _ = save(ids.toDF("__gone").where("__gone IS NOT NULL").distinct(), "gone")
    bitmap = membership_bitmap(gone, F.xxhash64("__gone"))
    flagged = maybe_in(docs, bitmap, F.xxhash64(F.col(id_col)), "__maybe")
    rest = flagged.where("__maybe").join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    return flagged.where(~F.col("__maybe")).unionByName(rest).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_row_each(docs: DataFrame, *also: Column, id_col: str = "doc_id") -> DataFrame:
    """docs with one of the rows that have the same id and the same `also`; rows with a null id and all columns stay.

    Only rows that a bitmap of repeated ids lets through are shuffled.
    """
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1")
    bitmap = membership_bitmap(again, F.xxhash64(F.col(id_col)))
    flagged = maybe_in(docs, bitmap, F.xxhash64(F.col(id_col)), "__maybe")
    several = F.col("__maybe") & F.col(id_col).isNotNull()
    keys = {f"__key{i}": c for i, c in enumerate(also)}
    once = flagged.where(several).withColumns(keys).dropDuplicates([id_col, *keys])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return flagged.where(~several).select(*columns).unionByName(once.select(*columns))

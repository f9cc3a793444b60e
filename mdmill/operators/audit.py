"""Hash-chained audit ledgers: append and verify."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def ledger(events: DataFrame) -> DataFrame:
    """(chain, ts, event_id, payload_hash) of an event table; user_id is the chain."""
    value = F.format_string("%.4f", F.col("value").cast("double"))
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", value)
    return events.select(F.col("user_id").alias("chain"), "ts", "event_id", F.sha2(payload, 256).alias("payload_hash"))


def _extend(frames):
    """Chain sorted rows; what is carried from frame to frame is the last block of one chain."""
    chain, height, last = object(), 0, GENESIS
    for pdf in frames:
        heights, previous, own = [], [], []
        for key, payload, top, head in zip(pdf["chain"], pdf["payload_hash"], pdf.pop("__height"), pdf.pop("__head")):
            if key != chain:
                chain, height, last = key, int(top), head
            height += 1
            previous.append(last)
            last = hashlib.sha256(f"{height}|{last}|{payload}".encode()).hexdigest()
            heights.append(height)
            own.append(last)
        yield pdf.assign(height=heights, previous_hash=previous, block_hash=own)


def append_blocks(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain the rows of each key by (ts, event_id), behind the last block that heads (chain, height, block_hash) holds.

    The only sequential step: a task reads whole chains in order and holds one
    batch of rows, however long a chain is. A chain without a head starts at
    height 1 behind GENESIS. An empty table gives an empty one.
    """
    schema = T.StructType([*rows.schema.fields])
    schema.add("height", "long").add("previous_hash", "string").add("block_hash", "string")
    start = {"__height": F.lit(0).cast("long"), "__head": F.lit(GENESIS)}
    if heads is not None:
        tops = heads.select(F.col("chain").alias("__chain"), F.col("height").alias("__h"), F.col("block_hash").alias("__b"))
        rows = rows.join(tops, F.col("chain") == F.col("__chain"), "left").drop("__chain")
        start = {"__height": F.coalesce("__h", F.lit(0)), "__head": F.coalesce("__b", F.lit(GENESIS))}
    sorted_rows = rows.withColumns(start).repartition("chain").sortWithinPartitions("chain", "ts", "event_id")
    return sorted_rows.select(*(f.name for f in schema.fields[:-3]), "__height", "__head").mapInPandas(_extend, schema)


def heads(blocks: DataFrame) -> DataFrame:
    """(chain, height, block_hash): the last block of each chain."""
    return blocks.groupBy("chain").agg(F.max("height").alias("height"), F.max_by("block_hash", "height").alias("block_hash"))


def sign(blocks: DataFrame, key: bytes) -> DataFrame:
    """blocks with `signature`: the HMAC of the block hash."""
    return blocks.withColumn("signature", hmac_sha256(key, F.col("block_hash")))


def verify_signed(blocks: DataFrame, key: bytes) -> DataFrame:
    """verify, with bad_signature."""
    return verify(blocks).withColumn("bad_signature", hmac_sha256(key, F.col("block_hash")) != F.col("signature"))


def verify(blocks: DataFrame) -> DataFrame:
    """blocks with the boolean columns bad_height, bad_link, bad_hash; all rows are checked in parallel."""
    order = Window.partitionBy("chain").orderBy("height", "event_id")
    text = F.concat_ws("|", F.col("height").cast("string"), "previous_hash", "payload_hash")
    return blocks.select(
        "*",
        (F.col("height") != F.row_number().over(order)).alias("bad_height"),
        (F.col("previous_hash") != F.lag("block_hash", 1, GENESIS).over(order)).alias("bad_link"),
        (F.sha2(text, 256) != F.col("block_hash")).alias("bad_hash"),
    )


def hmac_sha256(key: bytes, message):
    """HMAC of a string column, from two SHA-256 (keys up to 64 bytes)."""
    pad = lambda x: bytes(b ^ x for b in key.ljust(64, b"\0"))
    inner = F.unhex(F.sha2(F.concat(F.lit(pad(0x36)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(pad(0x5C)), inner), 256)

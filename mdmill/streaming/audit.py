"""Streaming forms: audit blocks of arriving events, pending feedback of arriving deliveries."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mdmill.operators.audit import GENESIS
from mdmill.session import save, scratch_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files that one trigger reads, and rows of a frame that a chain gives out at a time.
FILES_PER_TRIGGER, ROWS = 64, 10_000
BLOCK = "chain long, event_id long, height long, previous_hash string, payload_hash string, block_hash string"


class _Chain(StatefulProcessor):
    """The height and last hash of a chain; a chain that was stored before starts behind its head."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "height long, last string")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.head.update((int(initial["height"].iloc[0]), str(initial["block_hash"].iloc[0])))

    def handleInputRows(self, key, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        height, last = self.head.get() if self.head.exists() else (0, GENESIS)
        rows = pd.concat([f[["ts", "event_id", "payload_hash"]] for f in frames])  # of one trigger, see FILES_PER_TRIGGER
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        for i in range(0, len(rows), ROWS):
            some, out = rows.iloc[i : i + ROWS], []
            for event, payload in zip(some["event_id"], some["payload_hash"]):
                height, before = height + 1, last
                last = hashlib.sha256(f"{height}|{before}|{payload}".encode()).hexdigest()
                out.append((key[0], event, height, before, payload, last))
            yield pd.DataFrame(out, columns=["chain", "event_id", "height", "previous_hash", "payload_hash", "block_hash"])
        self.head.update((height, last))

    def close(self) -> None:
        pass


def stream_blocks(ledger: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Append a stream (chain, ts, event_id, payload_hash) to its chains, behind heads (chain, height, block_hash) of stored ones.

    State is the height and last hash of a chain, in RocksDB. What arrives
    between two triggers is chained by time; a later event is appended, never
    inserted.
    """
    ledger.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    first = heads.select("chain", "height", "block_hash").groupBy("chain") if heads is not None else None
    return ledger.groupBy("chain").transformWithStateInPandas(_Chain(), BLOCK, "Append", "None", first)


def blocks_through_stream(ledger: DataFrame, folder: str, heads: DataFrame | None = None, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Run a ledger through a one-shot stream of its Parquet files in order of time, a bounded number of files a trigger; the blocks it wrote."""
    spark = ledger.sparkSession
    path = f"{scratch_root(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(path)
    query = (
        stream_blocks(spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), heads)
        .writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/blocks")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/blocks")


def feedback_through_stream(deliveries: DataFrame, folder: str) -> DataFrame:
    """(plant_code, mdm_code, delivered, accepted) after a stream (plant_code, mdm_code, accepted).

    Each micro-batch adds one aggregated row a pair to the log of its own
    number, so a repeated micro-batch overwrites itself; the log is summed when read.
    """
    spark = deliveries.sparkSession
    source, path = save(deliveries, "feedback")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("plant_code", "mdm_code").agg(F.count("*").alias("delivered"), F.count_if("accepted").alias("accepted")).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    stream = spark.readStream.schema(source.schema).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/log").groupBy("plant_code", "mdm_code").agg(F.sum("delivered").alias("delivered"), F.sum("accepted").alias("accepted"))

"""Streaming governance: records that arrive become quality issues, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.operators.quality import record_issues
from mdmill.session import save
from mdmill.sources import stored

#: How late a record may come after the newest one seen; dedup state is kept as long.
DELAY = "1 hour"
CODE_KEY = ["batch_id", "system_source", "plant_code", "material_code"]
ISSUE = ["issue_id", "batch_id", "row_id", "code", "field", "severity"]


def stream_issues(records: DataFrame, keys=("row_id", "code"), time: str | None = None, delay: str = DELAY) -> DataFrame:
    """The issues of a stream of records, each once.

    With `time`, an event-time column, state is kept for `delay` behind the
    newest record only: a record that comes later than that is dropped, and a
    duplicate within it is. Without one every key is remembered for good.
    """
    if time is None:
        return record_issues(records).dropDuplicates(list(keys))
    timed = records.withWatermark(time, delay)
    found = record_issues(timed.withColumn("row_id", F.struct("row_id", time)))
    flat = found.select(F.col("row_id.row_id").alias("row_id"), F.col(f"row_id.{time}").alias(time), "code", "field", "severity")
    return flat.dropDuplicatesWithinWatermark(list(keys)).drop(time)


def issue_id(batch: Column, row: Column, code: Column) -> Column:
    return F.concat(F.lit("DQI-"), F.upper(F.substring(F.sha2(F.concat_ws("|", batch.cast("string"), row.cast("string"), code), 256), 1, 16)))


def capture(records: DataFrame, codes: DataFrame) -> DataFrame:
    """The issues of a micro-batch of records, codes they share with any record of their batch included.

    codes holds (batch_id, system_source, plant_code, material_code, row_id) of
    all records so far, these too. A code that is now taken twice gives an issue
    to every record that has it, earlier ones as well.
    """
    own = record_issues(records.withColumn("row_id", F.struct("batch_id", "row_id"))).select("row_id.*", "code", "field", "severity")
    here = records.where("coalesce(material_code, '') <> ''").select(*CODE_KEY).distinct()
    same = codes.join(here, CODE_KEY, "left_semi")
    twice = same.join(same.groupBy(*CODE_KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n"), CODE_KEY)
    shared = twice.select("batch_id", "row_id", F.lit("DUPLICATE_CODE").alias("code"), F.lit("material_code").alias("field"), F.lit("HIGH").alias("severity"))
    return own.unionByName(shared).select(issue_id(F.col("batch_id"), F.col("row_id"), F.col("code")).alias("issue_id"), *ISSUE[1:])


def start_governance(records: DataFrame, root: str, time: str = "arrived", delay: str = DELAY, trigger: dict | None = None):
    """Start a query that writes the issues of a stream of records to the stored table root/issues, and returns it.

    Records (batch_id, row_id, the record's fields, `time`) that repeat within
    `delay`, or come later than that, are dropped by the watermark, so the
    stream's state has a bound. Each micro-batch adds its codes to root/codes
    and inserts issues that are not there yet, whatever their state is now;
    a micro-batch that runs again changes nothing.
    """
    spark = records.sparkSession
    codes, issues = f"{root}/codes", f"{root}/issues"
    fields = {f.name: f.dataType for f in records.schema.fields}
    if not _exists(spark, f"{codes}/_layout"):
        ids = ", ".join(f"{c} {fields[c].simpleString()}" for c in ("batch_id", "system_source", "plant_code", "material_code", "row_id"))
        stored.create(spark.createDataFrame([], ids), codes, [*CODE_KEY, "row_id"])
        kinds = f"issue_id string, batch_id {fields['batch_id'].simpleString()}, row_id {fields['row_id'].simpleString()}, code string, field string, severity string, status string"
        stored.create(spark.createDataFrame([], kinds), issues, ["issue_id"])

    def govern(batch: DataFrame, _: int) -> None:
        rows, _path = save(batch, "arrived")
        stored.merge(spark, codes, rows.where("coalesce(material_code, '') <> ''").select(*CODE_KEY, "row_id"), None)
        found = capture(rows, stored.read(spark, codes)).withColumn("status", F.lit("OPEN"))
        stored.merge(spark, issues, found.dropDuplicates(["issue_id"]), None)

    once = records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["batch_id", "row_id"])
    return once.writeStream.foreachBatch(govern).option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark, path: str) -> bool:
    fs, target = stored._path(spark, path)
    return fs.exists(target)


def issues_through_stream(records: DataFrame, checkpoint: str) -> DataFrame:
    """Run records (with an event time `arrived`) through a one-shot stream of Parquet files and return the issues it stored."""
    spark = records.sparkSession
    source, _ = save(records, "arrivals")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    start_governance(stream, checkpoint).awaitTermination()
    return stored.read(spark, f"{checkpoint}/issues")

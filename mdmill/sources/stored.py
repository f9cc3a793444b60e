"""Tables that change after they are written: upserts, removals, retention, batches of several tables, added columns.

A stored table is cut into buckets by a hash of its key. A change rewrites
only the buckets that hold one of its keys and whose rows it alters, by
dynamic partition overwrite, from a copy in the shared folder; so it may be
repeated after a failure, and repeating it writes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mdmill.session import drop, save

BUCKETS = 64
#: The word that confirms a removal by retention.
CONFIRM = "DELETE_EXPIRED_BATCHES"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write df as a stored table with these keys, by which it is cut; an earlier one is replaced."""
    spark = df.sparkSession
    rows = df.withColumn("bucket", _bucket(keys, buckets))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
    _write_text(spark, f"{path}/_layout/layout.json", json.dumps({"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue()}))


def read(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path)[0].drop("bucket")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], int]:
    layout = json.loads(_read_text(spark, f"{path}/_layout/layout.json"))
    schema = StructType.fromJson(layout["schema"]).add("bucket", "integer")
    return spark.read.schema(schema).parquet(path), layout["keys"], layout["buckets"]


def _signatures(df: DataFrame) -> DataFrame:
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if c != "bucket"))
    return df.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h"))


def _replace(spark: SparkSession, path: str, old: DataFrame, new: DataFrame) -> list[int]:
    """Put the rows `new` of some buckets in place of `old`, where they differ; the buckets written."""
    new, copy = save(new, "changed")
    was, now = _signatures(old), _signatures(new).toDF("b", "n2", "h2")
    both = was.join(now, F.col("bucket") == F.col("b"), "full").where(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("h").eqNullSafe(F.col("h2"))))
    differ = both.select(F.coalesce("bucket", "b").alias("bucket"), F.col("n2").isNull().alias("gone")).collect()  # a row a bucket at most
    some = [r["bucket"] for r in differ if not r["gone"]]
    if some:
        rows = new.where(F.col("bucket").isin(some)).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    drop(spark, copy, *(f"{path}/bucket={r['bucket']}" for r in differ if r["gone"]))
    return sorted(r["bucket"] for r in differ)


def merge(spark: SparkSession, path: str, changes: DataFrame, newest: str | None) -> list[int]:
    """Upsert changes by the table's keys; the row with the greatest `newest` stays, on equal ones that of changes, and of those the greatest.

    Without a `newest` rows are inserted where their key is absent; stored rows stay.

    Returns the buckets that were rewritten. Columns that changes lack become
    null in new rows; columns that the table lacks are an error. Null keys are
    keys like others.
    """
    table, keys, buckets = _read(spark, path)
    own = [c for c in table.columns if c != "bucket"]
    if extra := set(changes.columns) - set(own):
        raise ValueError(f"the table has no columns {sorted(extra)}")
    fresh, copy = save(changes.withColumn("bucket", _bucket(keys, buckets)), "changes")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return []
    old = table.where(F.col("bucket").isin(touched))
    both = old.withColumn("__from", F.lit(0)).unionByName(fresh.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    values = [c for c in own if c not in keys]
    order = F.struct(*([newest, "__from"] if newest else [-F.col("__from")]), F.xxhash64(*values)) if values else None
    best = F.max_by(F.struct(*values), order) if values else F.lit(None)
    merged = both.groupBy("bucket", *keys).agg(best.alias("__row"))
    merged = merged.select(*(F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in own), "bucket")
    changed = _replace(spark, path, old, merged)
    drop(spark, copy)
    return changed


def remove(spark: SparkSession, path: str, gone: DataFrame) -> list[int]:
    """Remove the rows whose keys stand in gone (the table's key columns); the buckets rewritten."""
    table, keys, buckets = _read(spark, path)
    ids, copy = save(gone.select(*keys).distinct().withColumn("bucket", _bucket(keys, buckets)), "gone")
    touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]
    old = table.where(F.col("bucket").isin(touched))
    same = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"g.`{k}`")) for k in keys]
    kept = old.alias("t").join(ids.alias("g"), [F.col("t.bucket") == F.col("g.bucket"), *same], "left_anti")
    changed = _replace(spark, path, old, kept) if touched else []
    drop(spark, copy)
    return changed


def retain(spark: SparkSession, batches: str, children: dict[str, str], now, dry_run: bool = True, confirm: str | None = None) -> DataFrame:
    """(table_name, batch_id, action, n): what retention removes, or would remove, in each stored table.

    batches is a stored table (batch_id, retention_until, held, ...) with key
    batch_id, children are stored tables with key batch_id, by name. Batches
    whose retention_until is at or before `now` are removed from all, children
    first and batches last, so a run that broke off can be repeated; held ones
    are listed as HELD and stay. A run that removes needs the word CONFIRM.
    """
    if not dry_run and confirm != CONFIRM:
        raise ValueError("the confirmation word is required")
    due = read(spark, batches).where(F.col("retention_until").isNotNull() & (F.col("retention_until") <= F.lit(now)))
    due, _ = save(due.select("batch_id", F.when(F.coalesce("held", F.lit(False)), "HELD").otherwise("DELETE").alias("action")), "due")
    counted = due.select(F.lit("batches").alias("table_name"), "batch_id", "action", F.lit(1).cast("long").alias("n"))
    for name, path in sorted(children.items()):
        n = read(spark, path).groupBy("batch_id").agg(F.count("*").alias("n"))
        counted = counted.unionByName(due.join(n, "batch_id").select(F.lit(name).alias("table_name"), "batch_id", "action", "n"))
    report, _ = save(counted, "report")
    if not dry_run:
        gone = due.where("action = 'DELETE'")
        for path in [*children.values(), batches]:
            remove(spark, path, gone)
    return report


def publish(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame], expect: dict[str, int] | None = None) -> dict[str, int]:
    """Write the tables of a batch as one unit; rows of each.

    Each table goes to a new folder; when all are written and their rows, read
    back, are as many as went in (and as `expect` says), the batch's manifest is
    put in place by one rename. A reader sees the batch as it was before, or
    whole. Publishing a batch again replaces it.
    """
    folders, rows = {}, {}
    for name, df in tables.items():
        seen, folder = Observation(f"{name}-{uuid.uuid4().hex}"), f"{root}/data/{name}/{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        written = spark.read.schema(df.schema).parquet(folder).count()
        if written != seen.get["n"] or written != (expect or {}).get(name, written):
            raise ValueError(f"{name}: {written} rows were written of {(expect or {}).get(name, seen.get['n'])}")
        folders[name], rows[name] = folder, written
    manifest = {"batch": batch, "folders": folders, "rows": rows, "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}}
    _write_text(spark, f"{root}/manifest/{uuid.uuid5(uuid.NAMESPACE_OID, batch).hex}.json", json.dumps(manifest))
    return rows


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of the published batches, a small file each."""
    fs, path = _path(spark, f"{root}/manifest")
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path)]
    return [json.loads(_read_text(spark, p)) for p in sorted(found) if p.endswith(".json")]


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table over all published batches, with a column `unit` that names the batch."""
    parts = [(m["batch"], m["folders"][name], StructType.fromJson(m["schemas"][name])) for m in manifests(spark, root) if name in m["folders"]]
    if not parts:
        raise ValueError(f"no published batch has a table {name}")
    by_schema: dict[str, list] = {}
    for batch, folder, schema in parts:
        by_schema.setdefault(schema.json(), []).append((batch, folder))
    out = None
    for schema, some in by_schema.items():
        names = {folder.rstrip("/").rsplit("/", 1)[1]: batch for batch, folder in some}
        units = spark.createDataFrame(list(names.items()), "__folder string, unit string")
        rows = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f for _, f in some))
        # A row a published batch, as the manifests are: broadcast, as a shuffle by folder brings a whole unit into one task.
        rows = rows.withColumn("__folder", F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/[^/]*$", 1)).join(F.broadcast(units), "__folder").drop("__folder")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete folders that no manifest names (of replaced batches, or of writes that broke off); no writer may be at work."""
    named = {f.rsplit("/", 1)[1] for m in manifests(spark, root) for f in m["folders"].values()}
    fs, path = _path(spark, f"{root}/data")
    gone = [s.getPath() for t in (fs.listStatus(path) if fs.exists(path) else []) for s in fs.listStatus(t.getPath()) if s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def evolve(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the columns of schema that it lacks, fields of structs too, and nulls of columns in `defaults` filled.

    Defaults are by column, `struct.field` for a field of a struct (filled where
    the struct is not null). Columns that schema lacks stay, at the end.
    """
    none = df.sparkSession.createDataFrame([], schema)
    out = none.unionByName(df, allowMissingColumns=True)
    for name, value in (defaults or {}).items():
        top, _, field = name.partition(".")
        if field:
            out = out.withColumn(top, F.when(F.col(top).isNotNull(), F.col(top).withField(field, F.coalesce(F.col(f"{top}.{field}"), F.lit(value)))))
        else:
            out = out.withColumn(top, F.coalesce(F.col(f"`{top}`"), F.lit(value)))
    return out


def union_evolved(tables: list[DataFrame], defaults: dict[str, object] | None = None) -> DataFrame:
    """The union of tables of different ages: every column and struct field that any has, defaults as in evolve."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return evolve(out, out.schema, defaults)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: written beside its place and renamed over it."""
    jvm = spark.sparkContext._jvm
    fs, target = _path(spark, path)
    fs.mkdirs(target.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(beside), fs.makeQualified(target), options
    )


def _read_text(spark: SparkSession, path: str) -> str:
    fs, target = _path(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()

"""Session, table loading and scratch tables shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Settings for local runs and tests; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: int | str = "*", app: str = "mdmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a folder of its
    own; on a cluster other machines would not see it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def save(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def gather(parts) -> DataFrame:
    """The union of parts; more than one are written to one scratch table one after another, so no plan grows with their number."""
    parts = list(parts)
    if len(parts) == 1:
        return parts[0]
    spark = parts[0].sparkSession
    path = f"{scratch_root(spark)}/parts-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to a task for each core: for few rows that cost much each, which would else be put together in one task.

    Not to more, as each task has to compile long expressions anew.
    """
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism))


def worked_out_once(rows: DataFrame, keys: dict[str, Column], made: dict[str, Column]) -> DataFrame:
    """rows with the columns `made`, which depend on `keys` (never null) alone: they are worked out once for all rows of equal keys."""
    keyed = rows.withColumns(keys).drop(*made)
    kinds, _ = save(spread(keyed.select(*keys).distinct()).withColumns(made), "kinds")
    return keyed.join(kinds, list(keys)).drop(*keys)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

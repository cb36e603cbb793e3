"""Log and manifest files in a shared folder, written and read by Spark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes for the jobs inside, unless the session has a bound of its own: workers hold a few at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if before.rstrip("b") != str(64 << 20):
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder all executors share; in local mode without one, in a folder of this machine."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or f"file://{tempfile.gettempdir()}/siltstone-files"
    return f"{root.rstrip('/')}/siltstone-tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(table: DataFrame, label: str) -> DataFrame:
    """``table`` written as Parquet to a new shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_folder(table.sparkSession, label)
    with bounded_batches(table.sparkSession, 4 << 20):
        table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def remove_tables(spark: SparkSession) -> bool:
    """Delete the tables and files that this application put below the shared folder; for when no result of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, "x").rsplit("/", 1)[0])
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_plan(plan: DataFrame, path: str) -> None:
    """Manifests as JSON lines."""
    plan.write.json(path)


def load_plan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_versioned(table: DataFrame, path: str, version: int) -> None:
    """An index or journal as Parquet that carries its format version."""
    from pyspark.sql import functions as F

    table.withColumn("format_version", F.lit(version)).write.parquet(path)


def load_versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table without its version column; another version is an error when the rows are read."""
    from pyspark.sql import functions as F

    held = spark.read.parquet(path)
    if "format_version" not in held.columns:
        raise ValueError(f"{path} has no format version")
    good = F.assert_true(F.col("format_version") == version, F.lit(f"format version is not {version}"))
    return held.where(good.isNull()).drop("format_version")

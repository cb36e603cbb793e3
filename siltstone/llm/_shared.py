"""Helpers that several operators of this subpackage use.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (shared by driver and executors, any Hadoop file
system). Only in local mode without that setting, as in tests, a folder below
the local temp directory is used; a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.audit_files import bounded_batches

#: The white space of the contracts: space and \t \n \v \f \r.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: the session's, or in local mode without one a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/siltstone-shared"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the application's own part of the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/siltstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with bounded_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application, no other's; for when no result of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/siltstone/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to all cores if it has fewer parts than there are, as with one small file; else as it is.

    For scans only: of other plans, counting the parts would run the shuffles.
    """
    parts, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 16 * max(1, parts))) if parts < cores else df


#: No more keys than this can each hold a larger share of the rows than its inverse.
HOT_KEYS = 1000


def join_with_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each key and in ``count`` how often ``rows`` has it, of ``total``.

    Keys with more than a thousandth of the rows are at most ``HOT_KEYS``:
    they are broadcast, and their rows stay where they are. The rest is
    shuffled, and no key of it fills a task.
    """
    hot = keyed.where(F.col(count) > total / HOT_KEYS)
    cold = keyed.where(F.col(count) <= total / HOT_KEYS)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(others)


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the table ``documents``, a scan dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def slices(batches: Iterator[pa.RecordBatch], column: int | Callable[[pa.RecordBatch], pa.Array], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``max_bytes`` of the given string or binary column.

    ``column`` is its number, or gives it from a batch. One document larger than the limit makes a slice of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        held_in = batch.column(column) if isinstance(column, int) else column(batch)
        lengths = pa.compute.fill_null(pa.compute.binary_length(held_in), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if held and held + int(lengths[i]) > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(lengths[i])
        yield batch.slice(start, n - start)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` under a name that reads well at the call."""
    return df.mapInArrow(function, schema)

"""Scans of an ordered table that end early, when a callback says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.audit_files import written

#: A step reads at most so many files, each a plan of its own.
MOST = 256


class Scan(NamedTuple):
    """Rows visited, the last of them the one that ended the scan; how many files were read, of how many; whether it was ended."""

    rows: DataFrame
    files_read: int
    files: int
    ended: bool


def save_ordered(table: DataFrame, path: str, order: list[str], parts: int) -> None:
    """``table`` as Parquet in files that follow each other in the order of the columns."""
    table.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)


def ordered_files(spark: SparkSession, path: str) -> list[str]:
    """A table's files in the order of their names, which is that in which ``save_ordered`` wrote them."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath() for s in held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(held)]
    return sorted(p.toString() for p in names if p.getName().startswith("part-"))


def scan_until(spark: SparkSession, path: str, keep_going: Callable[[pd.DataFrame], pd.Series], first: int = 1, growth: int = 4, condition: str | None = None) -> Scan:
    """Visit the rows of ``save_ordered``'s table in order, up to the first for which ``keep_going`` is false.

    The callback is given frames of rows and tells for each of their rows, by
    that row alone, whether to go on. Files are read in steps, ``first`` of them
    and then ``growth`` times as many in each step; a task ends its file or split at its first
    stop. So a scan that is ended early reads few files, and one that is not
    takes few steps. ``condition`` leaves out rows before the callback, in the
    scan itself.
    """
    names = ordered_files(spark, path)
    schema = spark.read.parquet(path).schema
    out = T.StructType([*schema.fields, T.StructField("__file", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__go", T.BooleanType())])

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            go = np.asarray(keep_going(frame.drop(columns=["__file", "__row"])), bool)
            stops = np.flatnonzero(~go)
            end = stops[0] + 1 if len(stops) else len(frame)
            yield frame.head(end).assign(__go=go[:end])
            if len(stops):
                return

    steps, at, size = [], 0, first
    while at < len(names):
        step = None
        for n, name in enumerate(names[at : at + size], at):
            rows = spark.read.schema(schema).parquet(name)
            rows = rows.select("*", F.lit(n).cast("long").alias("__file"), F.col("_metadata.row_index").alias("__row"))
            rows = rows.where(condition) if condition else rows
            step = rows if step is None else step.unionByName(rows)
        at = min(at + size, len(names))
        size = min(size * growth, MOST)
        held = written(step.mapInPandas(visit, out), "early-scan")
        stop = held.where("not `__go`").agg(F.min(F.struct("__file", "__row")).alias("at")).first()["at"]
        if stop is not None:
            steps.append(held.where((F.col("__file") < stop["__file"]) | ((F.col("__file") == stop["__file"]) & (F.col("__row") <= stop["__row"]))))
            break
        steps.append(held)
    else:
        stop = None
    if not steps:
        return Scan(spark.createDataFrame([], schema), 0, 0, False)
    rows = steps[0]
    for more in steps[1:]:
        rows = rows.unionByName(more)
    return Scan(rows.select(*schema.names), at, len(names), stop is not None)

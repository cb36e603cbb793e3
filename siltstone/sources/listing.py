"""Listings of files as DataFrames, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (below the root), size, modified; with ``content`` its bytes. Unread columns are pruned, bytes included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    columns = [relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*columns, *(["content"] if content else []))


def hidden(path: Column) -> Column:
    """Any component starts with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def listed(files: DataFrame, recursive: bool = True, max_depth: int | None = None, include_hidden: bool = False, max_entries: int | None = None) -> DataFrame:
    """A listing under options; ``max_entries`` is exact and takes the first paths."""
    depth = F.size(F.split("path", "/"))
    limit = 1 if not recursive else max_depth
    rows = files.where(depth <= limit) if limit is not None else files
    rows = rows if include_hidden else rows.where(~hidden(F.col("path")))
    return rows.orderBy("path").limit(max_entries) if max_entries is not None else rows


def head(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` bytes of every file."""
    return files.select("path", F.substring("content", 1, n).alias("head"))


def range_hash(content: Column, offset: int, length: int) -> Column:
    """SHA-256 of a range of bytes."""
    return F.sha2(F.substring(content, offset + 1, length), 256)

"""Object-store listings and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import object_glob


def list_matching(objects: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Objects whose key matches; the pattern's literal start is a prefix test that scans can use."""
    return objects.where(object_glob(F.col(key), pattern))


def usage(objects: DataFrame) -> DataFrame:
    """By storage class (STANDARD when absent): objects, bytes, delete markers."""
    marker = F.coalesce(F.col("is_delete_marker"), F.lit(False))
    return objects.groupBy(F.coalesce("storage_class", F.lit("STANDARD")).alias("storage_class")).agg(
        F.count_if(~marker).alias("objects"),
        F.coalesce(F.sum(F.when(~marker, F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(marker).alias("delete_markers"),
    )


def version_totals(versions: DataFrame) -> DataFrame:
    """By key: versions, total_size, latest_version, is_deleted (its latest entry is a delete marker)."""
    marker = F.coalesce(F.col("is_delete_marker"), F.lit(False))
    return versions.groupBy("key").agg(
        F.count_if(~marker).alias("versions"),
        F.coalesce(F.sum(F.when(~marker, F.col("size"))), F.lit(0)).cast("long").alias("total_size"),
        F.max(F.when(~marker & F.col("is_latest"), F.col("version_id"))).alias("latest_version"),
        F.bool_or(marker & F.col("is_latest")).alias("is_deleted"),
    )


def versions_sorted(versions: DataFrame) -> DataFrame:
    return versions.orderBy("key", F.col("last_modified").desc(), "version_id")


def compare_versions(a: Column, b: Column) -> Column:
    """Structs (version_id, size, at, etag) compared: size_diff, time_diff, same_etag, identical, newer (the first on a tie)."""
    same = a["etag"] == b["etag"]
    return F.struct(
        (b["size"] - a["size"]).alias("size_diff"),
        F.abs(b["at"] - a["at"]).alias("time_diff"),
        same.alias("same_etag"),
        (same & (a["size"] == b["size"])).alias("identical"),
        F.when(b["at"] > a["at"], b["version_id"]).otherwise(a["version_id"]).alias("newer"),
    )


def batch_progress(batches: DataFrame) -> DataFrame:
    """Batches (batch_id, completed, failed, total, bytes, elapsed_ms): percentage, operations and MiB a second.

    The result's throughput is 0 while the elapsed time is under a second.
    """
    done = F.col("completed") + F.col("failed")
    seconds = F.col("elapsed_ms") / 1000.0
    return batches.select(
        "batch_id",
        F.round(F.when(F.col("total") > 0, done / F.col("total") * 100.0).otherwise(0.0), 6).alias("percent"),
        F.round(F.when(seconds > 0, done / seconds).otherwise(0.0), 6).alias("ops_per_s"),
        F.round(F.when(seconds > 0, F.col("bytes") / 1048576.0 / seconds).otherwise(0.0), 6).alias("mib_per_s"),
        F.round(F.when(F.floor(seconds) >= 1, done / F.floor(seconds)).otherwise(0.0), 6).alias("result_throughput"),
    )

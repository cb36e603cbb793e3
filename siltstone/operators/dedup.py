"""Deduplication statistics over a chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stats(locations: DataFrame, key: str = "content_id") -> DataFrame:
    """One row: unique and total references, deduplicated keys, most references, ratio and percentage saved.

    Ratios count references, not bytes, and are 0 for an empty index.
    """
    per = locations.groupBy(key).agg(F.count("*").alias("n"))
    sums = per.agg(
        F.count("*").cast("long").alias("unique_chunks"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_references"),
        F.coalesce(F.count_if(F.col("n") > 1), F.lit(0)).cast("long").alias("deduplicated_chunks"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_references"),
    )
    ratio = F.when(F.col("total_references") > 0, (F.col("total_references") - F.col("unique_chunks")) / F.col("total_references")).otherwise(F.lit(0.0))
    return sums.withColumn("dedup_ratio", F.round(ratio, 9)).withColumn("space_savings_pct", F.round(ratio * 100, 6))

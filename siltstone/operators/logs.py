"""Audit, history, telemetry and provenance logs: readers, aggregates, classes of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_ENTRY = "timestamp string, source string, destination string, bytes_copied long, duration_ms long, checksum string, compression_ratio double, status string, attempts int, error string"
PROVENANCE = "ts string, event_type string, job_id string, chunk_hash string, source_star string, source_path string, dest_star string, dest_path string, bytes long, duration_ms long, error string, context map<string,string>"

#: Event types by class, fixed values.
CHUNK_EVENTS = ("chunk_created", "chunk_deduplicated", "chunk_transferred", "chunk_verified", "chunk_healed", "chunk_penalized", "chunk_dead_lettered", "chunk_packed")
FILE_EVENTS = ("file_renamed", "file_skipped", "file_started", "file_completed")
JOB_EVENTS = ("job_created", "job_resumed", "job_completed", "job_failed")
STAR_EVENTS = ("star_registered", "star_scheduled", "star_draining", "star_deregistered")

#: Error kinds: (kind, category, fatal, transient, exit code class), fixed values.
ERRORS = (
    ("source_not_found", "validation", True, False, "fatal"),
    ("invalid_path", "validation", True, False, "fatal"),
    ("io", "io_error", False, True, "partial"),
    ("io_permanent", "io_error", False, False, "partial"),
    ("insufficient_disk_space", "resource", True, False, "fatal"),
    ("config", "configuration", True, False, "fatal"),
    ("compression", "codec", False, False, "partial"),
    ("decompression", "codec", False, False, "partial"),
    ("resume", "resume", False, False, "partial"),
    ("checksum_mismatch", "integrity", True, False, "integrity"),
    ("symlink", "filesystem", False, False, "partial"),
    ("parallel", "concurrency", False, False, "partial"),
    ("retries_exhausted", "retry", True, False, "partial"),
    ("zero_copy_unsupported", "optimization", False, False, "partial"),
    ("protocol", "network", False, True, "partial"),
    ("authentication", "security", True, False, "fatal"),
    ("metadata_failed", "metadata", False, True, "partial"),
    ("audit_log", "audit", False, False, "partial"),
    ("other", "unknown", False, False, "partial"),
)


def classify_errors(rows: DataFrame, kind: str = "error_kind") -> DataFrame:
    """Rows with category, is_fatal, is_transient and exit_class of their error kind; a broadcast of one row a kind."""
    known = rows.sparkSession.createDataFrame(list(ERRORS), "error_key string, category string, is_fatal boolean, is_transient boolean, exit_class string")
    return rows.join(F.broadcast(known), F.col(kind) == F.col("error_key"), "left").drop("error_key")


def is_chunk_event(kind: Column) -> Column:
    return kind.isin(*CHUNK_EVENTS)


def is_job_event(kind: Column) -> Column:
    return kind.isin(*JOB_EVENTS)


def read_audit_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON Lines log; lines that do not parse, or lack a required field, are dropped."""
    rows = spark.read.schema(AUDIT_ENTRY).option("mode", "DROPMALFORMED").json(path)
    return rows.dropna(subset=["timestamp", "source", "destination", "bytes_copied", "duration_ms", "status", "attempts"])


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV log: the header is skipped, quoted commas and doubled quotes are understood."""
    return spark.read.schema(AUDIT_ENTRY).option("header", True).option("enforceSchema", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path)


def write_audit(entries: DataFrame, path: str, form: str = "json") -> None:
    """Append entries; CSV fields are guarded against formulas."""
    from ..functions.scalars import csv_field

    if form == "json":
        entries.write.mode("append").json(path)
        return
    # the writer quotes; only the guard against formulas is ours
    guarded = [F.when(F.col(f.name).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(f.name))).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in entries.schema]
    del csv_field
    entries.select(*guarded).write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Provenance events; blank lines and lines that are no such events are skipped."""
    rows = spark.read.schema(PROVENANCE).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("event_type").isin(*CHUNK_EVENTS, *FILE_EVENTS, *JOB_EVENTS, *STAR_EVENTS))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of which any bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def history(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of history lines (value, line_no): key aliases, defaults, lines that are no JSON object dropped.

    The first alias that is present counts, even when its value has another
    type; then the field has its default.
    """
    text = F.regexp_replace(F.col(value), "^﻿", "")
    parsed = F.try_parse_json(text)
    rows = lines.select("line_no", parsed.alias("v")).where("schema_of_variant(v) like 'OBJECT%'")

    def pick(names: tuple[str, ...], kinds: tuple[str, ...], cast: str) -> Column:
        case = None
        for n in names:
            held = F.try_variant_get("v", f"$.{n}", "variant")
            kind = F.schema_of_variant(held)
            found = F.when(kind.isin(*kinds) | (F.lit("DECIMAL" in kinds) & kind.startswith("DECIMAL")), F.try_variant_get("v", f"$.{n}", cast))
            case = F.when(held.isNotNull(), found) if case is None else case.when(held.isNotNull(), found)
        return case

    whole = ("BIGINT",)
    number = ("BIGINT", "DOUBLE", "DECIMAL")

    def count(names: tuple[str, ...]) -> Column:
        found = pick(names, whole, "bigint")
        return F.when(found >= 0, found)

    return rows.select(
        "line_no",
        F.coalesce(pick(("timestamp", "time", "ts"), ("STRING",), "string"), F.lit("unknown")).alias("timestamp"),
        F.coalesce(pick(("source", "src", "source_path"), ("STRING",), "string"), F.lit("-")).alias("source"),
        F.coalesce(pick(("destination", "dest", "dest_path"), ("STRING",), "string"), F.lit("-")).alias("dest"),
        count(("bytes_copied", "bytes", "total_bytes")).alias("bytes"),
        count(("files_copied", "files", "total_files")).alias("files"),
        pick(("duration_secs", "duration", "elapsed"), number, "double").alias("duration_secs"),
        F.coalesce(pick(("status", "result", "outcome"), ("STRING",), "string"), F.lit("ok")).alias("status"),
    )


def last_lines(rows: DataFrame, limit: int = 20, order: str = "line_no") -> DataFrame:
    """The last ``limit`` rows in file order."""
    return rows.orderBy(F.col(order).desc()).limit(limit).orderBy(order)


def transfer_stats(entries: DataFrame, order: str = "line_no") -> DataFrame:
    """One row over audit entries: counts by status, sums, speeds, mean compression ratio, the last line's source.

    Speeds are of entries with a duration; the slowest leaves speeds of 0 out
    and is 0 if none is left.
    """
    speed = F.when(F.col("duration_ms") > 0, F.col("bytes_copied") / F.col("duration_ms") * 1000.0)
    status = lambda s: F.count_if(F.col("status") == s)
    return entries.agg(
        F.count("*").alias("total_operations"),
        status("success").alias("successful"),
        status("failed").alias("failed"),
        status("skipped").alias("skipped"),
        F.coalesce(F.sum("bytes_copied"), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_duration_ms"),
        F.count("compression_ratio").alias("with_compression"),
        F.round(F.coalesce(F.avg("compression_ratio"), F.lit(0.0)), 6).alias("mean_compression_ratio"),
        F.round(F.coalesce(F.max(speed), F.lit(0.0)), 6).alias("fastest_bps"),
        F.round(F.coalesce(F.min(F.when(speed > 0, speed)), F.lit(0.0)), 6).alias("slowest_bps"),
        F.max_by("source", order).alias("most_recent"),
    )


def printed_stats(stats: DataFrame) -> DataFrame:
    """Derived figures: whole average bytes, average speed, share with compression, space saved."""
    ratio = F.col("mean_compression_ratio")
    saved = F.col("total_bytes") / (1.0 - ratio / 100.0) - F.col("total_bytes")
    return stats.select(
        F.when(F.col("total_operations") > 0, F.expr("total_bytes div total_operations")).alias("average_bytes"),
        F.round(F.when(F.col("total_duration_ms") > 0, F.col("total_bytes") / F.col("total_duration_ms") * 1000.0), 6).alias("average_bps"),
        F.round(F.when(F.col("with_compression") > 0, F.col("with_compression") / F.col("total_operations") * 100.0), 6).alias("compressed_pct"),
        F.round(F.when((F.col("with_compression") > 0) & (ratio != 100.0), saved), 3).alias("saved_bytes"),
    )


def operation_stats(attempts: DataFrame) -> DataFrame:
    """One row over operations (succeeded, retries): success_rate, avg and max retries."""
    return attempts.agg(
        F.count("*").alias("operations"),
        F.count_if("succeeded").alias("succeeded"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.round(F.coalesce(F.count_if("succeeded") / F.nullif(F.count("*"), F.lit(0)) * 100.0, F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg("retries"), F.lit(0.0)), 6).alias("avg_retries"),
        F.coalesce(F.max("retries"), F.lit(0)).alias("max_retries"),
    )


def errors_by_category(rows: DataFrame) -> DataFrame:
    return classify_errors(rows).groupBy("category").agg(F.count("*").alias("errors"))


def events_for(rows: DataFrame, column: str, value) -> DataFrame:
    """Events of one job or trace, or any other key."""
    return rows.where(F.col(column) == F.lit(value))


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative buckets: (by..., le, count, sum); the last bucket is all."""
    ups = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    counts = F.array(*[F.count_if(F.col(value) <= b) for b in bounds], F.count(value))
    grouped = rows.groupBy(*by).agg(counts.alias("c"), F.sum(value).alias("sum"))
    return grouped.select(*by, F.posexplode("c").alias("i", "count"), "sum").withColumn("le", F.get(ups, F.col("i"))).select(*by, F.col("le").cast("string").alias("le"), "count", F.round("sum", 4).alias("sum"))


def labelled_totals(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """A counter's total for each combination of labels."""
    return rows.groupBy(*by).agg(F.count("*").alias("events"), F.sum(value).cast("long").alias("total"))


def level_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Counts of lines that hold [ERROR], [WARN], [INFO]."""
    return lines.agg(*[F.count_if(F.col(value).contains(f"[{n.upper()}]")).alias(f"{n}s") for n in ("error", "warn", "info")])


def metrics_report(runs: DataFrame) -> DataFrame:
    """Runs (run_id, bytes, total_ms, scan_ms, copy_ms, verify_ms, errors) with throughput, phase shares and messages."""
    share = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col("total_ms"), F.lit(0)) * 100.0, F.lit(0.0)), 4)
    rate = F.round(F.when(F.col("total_ms") > 0, F.col("bytes") / 1048576.0 / (F.col("total_ms") / 1000.0)).otherwise(0.0), 4)
    messages = F.array_compact(F.array(F.when(F.col("errors") > 0, "errors"), F.when(rate < 1.0, "slow"), F.when(share("verify_ms") > 30, "verification")))
    return runs.select("run_id", rate.alias("mib_per_s"), share("scan_ms").alias("scan_pct"), share("copy_ms").alias("copy_pct"), share("verify_ms").alias("verify_pct"), messages.alias("messages"))


def instantaneous_rates(samples: DataFrame) -> DataFrame:
    """Samples (op_id, at_ms, bytes) with the rate since the previous one and the remaining time to ``total``."""
    w = W.partitionBy("op_id").orderBy("at_ms")
    gap = F.col("at_ms") - F.lag("at_ms").over(w)
    rate = F.when(gap > 0, (F.col("bytes") - F.lag("bytes").over(w)) / gap * 1000.0)
    overall = F.when(F.col("at_ms") > F.min("at_ms").over(w), F.col("bytes") / (F.col("at_ms") - F.min("at_ms").over(w)) * 1000.0)
    left = F.when(overall > 0, (F.col("total") - F.col("bytes")) / overall)
    return samples.select("op_id", "at_ms", F.round(rate, 6).alias("rate"), F.round(left, 6).alias("eta_s"))


def spans(events: DataFrame) -> DataFrame:
    """Span start and end events (span_id, kind, at_ms) as one row a span: started, ended, duration_ms (null while open)."""
    start = F.min(F.when(F.col("kind") == "start", F.col("at_ms")))
    end = F.max(F.when(F.col("kind") == "end", F.col("at_ms")))
    return events.groupBy("span_id").agg(start.alias("started"), end.alias("ended"), (end - start).alias("duration_ms"))

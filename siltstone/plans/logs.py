"""Queries over logs, scalars and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import chains, logs
from ..sources import audit_files
from ..streaming import states

KEY = b"chain-key"


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit entries."""
    e = events(spark, d)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("success")
    return e.select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("source"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes_copied"),
        (F.col("event_id") % 50).alias("duration_ms"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("double")).alias("compression_ratio"),
        status.alias("status"),
    )


ENTRIES_SQL = """en AS (SELECT event_id AS line_no, 'user/' || user_id::VARCHAR AS source, floor(value * 1000)::BIGINT AS bytes_copied, event_id % 50 AS duration_ms,
 CASE WHEN event_id % 3 = 0 THEN (event_id % 90)::DOUBLE END AS compression_ratio, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status FROM events)"""

_STATS_SQL = """st AS (SELECT count(*) AS total_operations, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
 sum(bytes_copied)::BIGINT AS total_bytes, sum(duration_ms)::BIGINT AS total_duration_ms, count(compression_ratio) AS with_compression, round(coalesce(avg(compression_ratio), 0.0), 6) AS mean_compression_ratio,
 round(coalesce(max(CASE WHEN duration_ms > 0 THEN bytes_copied / duration_ms::DOUBLE * 1000.0 END), 0.0), 6) AS fastest_bps,
 round(coalesce(min(CASE WHEN duration_ms > 0 AND bytes_copied > 0 THEN bytes_copied / duration_ms::DOUBLE * 1000.0 END), 0.0), 6) AS slowest_bps, arg_max(source, line_no) AS most_recent FROM en)"""


def _history_lines(spark, d):
    """JSON lines with aliases, wrong types, a byte order mark, and lines that are no objects."""
    e = events(spark, d)
    k = F.col("event_id")
    q = lambda s: F.lit(f'"{s}"')
    name = lambda a, b, c: F.when(k % 3 == 0, q(a)).when(k % 3 == 1, q(b)).otherwise(q(c))
    body = F.concat(
        F.lit("{"), name("timestamp", "time", "ts"), F.lit(': "t'), k.cast("string"), F.lit('", '),
        name("source", "src", "source_path"), F.lit(': "/a/'), F.col("user_id").cast("string"), F.lit('", '),
        name("bytes_copied", "bytes", "total_bytes"), F.lit(": "), F.when(k % 5 == 0, F.lit('"many"')).otherwise((k * 7).cast("string")), F.lit(", "),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(name("duration_secs", "duration", "elapsed"), F.lit(": "), (k % 10).cast("string"), F.lit(".5, "))),
        name("status", "result", "outcome"), F.lit(': "'), F.col("event_type"), F.lit('"}'),
    )
    line = F.when(k % 11 == 0, "not json").when(k % 13 == 0, "[1, 2]").when(k % 17 == 0, F.concat(F.lit("﻿"), body)).otherwise(body)
    return e.select(k.alias("line_no"), line.alias("value"))


def _errors(spark, d):
    kinds = F.array(*[F.lit(x[0]) for x in logs.ERRORS])
    return events(spark, d).select("event_id", F.element_at(kinds, (F.col("event_id") % len(logs.ERRORS) + 1).cast("int")).alias("error_kind"))


ERRORS_SQL = "er(error_kind, category, is_fatal, is_transient, exit_class) AS (VALUES " + ", ".join(f"('{k}', '{c}', {str(f).lower()}, {str(t).lower()}, '{x}')" for k, c, f, t, x in logs.ERRORS) + "), ev AS (SELECT event_id, ([" + ", ".join(f"'{x[0]}'" for x in logs.ERRORS) + f"])[(event_id % {len(logs.ERRORS)} + 1)::INT] AS error_kind FROM events)"

_TYPES = logs.CHUNK_EVENTS + logs.FILE_EVENTS + logs.JOB_EVENTS + logs.STAR_EVENTS


def _provenance(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % 20 + 1).cast("int"))
    rows = events(spark, d).select(kind.alias("event_type"), "value")
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", logs.is_chunk_event(F.col("event_type")).alias("is_chunk"), logs.is_job_event(F.col("event_type")).alias("is_job"))


def signed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as signed chains of log lines, some of them then altered, stripped or dropped."""
    rows = events(spark, d).select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chain"), "event_id", "event_type")
    rows = rows.withColumn("sequence", (F.row_number().over(W.partitionBy("chain").orderBy("event_id")) - 1).cast("long"))
    canonical = F.concat(F.lit('{"sequence":'), F.col("sequence").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    signed = chains.sign(rows.select("chain", "sequence", canonical.alias("canonical")), KEY)
    line = F.concat(F.lit('{"integrity_hash":"'), F.col("integrity_hash"), F.lit('",'), F.substring("canonical", F.lit(2), F.length("canonical")))
    text = (
        F.when((F.col("chain") == "c3") & (F.col("sequence") == 2), F.replace(line, F.lit('"type":"'), F.lit('"type":"x')))
        .when((F.col("chain") == "c5") & (F.col("sequence") == 1), F.col("canonical"))
        .otherwise(line)
    )
    kept = signed.where(~((F.col("chain") == "c7") & (F.col("sequence") == 4)))
    return kept.select("chain", F.col("sequence").alias("line_no"), text.alias("value"))


def _chain_report(spark, d):
    lines = signed_lines(spark, d)
    return chains.report(lines, chains.all_failures(lines, KEY))


def _hmac(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", scalars.hmac_sha256(KEY, F.encode("text", "UTF-8")).alias("mac"))


#: HMAC spelled out with two SHA-256 calls over the padded key.
_IPAD = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex()


def _attempts(spark, d):
    e = events(spark, d)
    op = (F.col("event_id") / 4).cast("long")
    kind = F.when(F.col("event_id") % 7 == 0, "config").when(F.col("event_type") == "error", "io").when(F.col("event_id") % 3 == 0, "protocol")
    mode = F.when(op % 3 == 0, "skip").when(op % 3 == 1, "partial").otherwise("abort")
    return e.select(op.alias("op_id"), (F.col("event_id") % 4 + 1).alias("attempt"), kind.alias("error_kind"), F.coalesce(kind.isin("io", "protocol"), F.lit(False)).alias("is_transient"), mode.alias("mode"))


ATTEMPTS_SQL = """att AS (SELECT event_id // 4 AS op_id, event_id % 4 + 1 AS attempt, CASE WHEN event_id % 7 = 0 THEN 'config' WHEN event_type = 'error' THEN 'io' WHEN event_id % 3 = 0 THEN 'protocol' END AS kind, event_id // 4 % 3 AS m FROM events)"""


def _breaker_rows(spark, d):
    e = events(spark, d)
    return e.select((F.col("user_id") % 10).alias("endpoint"), F.col("event_id").alias("ordinal"), (F.col("event_id") * 700).alias("at_ms"), (F.col("event_type") != "error").alias("succeeded"))


#: The stream's events come in portions of about so many, since a worker holds the rows of all timers that end in a micro-batch.
PORTION = 4_000_000


def _breaker_stream(spark, d):
    """The breaker's events as files in the order of time, followed as a stream that is stopped and started between portions; a far event moves the watermark past all others."""
    source, sink, state = (audit_files.fresh_folder(spark, f"breaker-{x}") for x in ("source", "sink", "state"))
    rows = _breaker_rows(spark, d).withColumn("at_ms", F.col("at_ms") + 1)  # times are positive
    found = rows.agg(F.count("*").alias("n"), F.max("at_ms").alias("last")).first()
    last = spark.range(1).select(F.lit(-1).cast("long").alias("endpoint"), F.lit(0).cast("long").alias("ordinal"), (F.lit(found["last"]).cast("long") + 1_000_000).alias("at_ms"), F.lit(True).alias("succeeded"))
    portions = max(1, -(-found["n"] // PORTION))
    # ranges of time do not overlap, so no event of a later portion is behind the watermark
    held = audit_files.written(rows.unionByName(last).repartitionByRange(portions, "at_ms").withColumn("portion", F.spark_partition_id()), "breaker-portions")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, states.ROCKS)
    try:
        for portion in range(portions):
            held.where(F.col("portion") == portion).drop("portion").write.mode("append").json(source)
            found = states.circuit_breaker_stream(spark.readStream.schema(rows.schema).json(source), 2, 5000, tick_ms=60_000)
            found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(found.schema).parquet(sink).where("endpoint >= 0").withColumn("at_ms", F.col("at_ms") - 1)


def _formats(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    size = (F.col("o_totalprice").cast("long") * F.pow(F.lit(37.0), F.col("o_orderkey") % 7).cast("long"))
    return o.select("o_orderkey", scalars.format_size(size).alias("size_text"), scalars.format_bytes(size).alias("bytes_text"))


def _texts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.lit("dir a/"), F.col("p_name"), F.lit("."), F.col("p_type"))
    return p.select(
        "p_partkey",
        scalars.case_transform(F.col("p_name"), "title").alias("title"),
        scalars.apply_transform(path, r"rename:s/([a-z]+)/<$1>/,case:upper,strip:xattrs").alias("transformed"),
        scalars.truncate_path(path, 12).alias("shown"),
        scalars.manifest_file_name(path).alias("file_name"),
        scalars.csv_field(F.concat(F.when(F.col("p_partkey") % 3 == 0, "=").otherwise(""), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, ',"x"').otherwise(""))).alias("csv"),
    )


def _backoff(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    strategy = F.element_at(F.array(*map(F.lit, ("fixed", "linear", "exponential", "exponential_jitter"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", scalars.retry_delay_ms(F.col("l_linenumber"), 5000).alias("delay_ms"), scalars.object_retry_delay_ms(F.col("l_linenumber"), strategy, 200, 3000).alias("object_delay_ms"))


def _trace(spark, d):
    e = events(spark, d)
    head = F.when(F.col("event_id") % 5 == 0, F.lit("01-a-b-c")).when(F.col("event_id") % 7 == 0, F.lit("00-a-b")).otherwise(scalars.format_traceparent(F.md5(F.col("event_id").cast("string")), F.substring(F.md5(F.col("user_id").cast("string")), 1, 16)))
    return e.select("event_id", scalars.parse_traceparent(head).alias("p")).select("event_id", "p.trace_id", "p.span_id", "p.flags")


KNOWN = ["customer", "supplier", "lineitem", "orders", "region"]


def _nearest(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    typed = F.concat(F.substring(F.element_at(F.array(*map(F.lit, KNOWN)), (F.col("c_custkey") % 5 + 1).cast("int")), 1, 6), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 2))
    return c.select("c_custkey", scalars.nearest_name(typed, KNOWN).alias("meant"))


_OPTION = lambda k, i: f"{{'d': levenshtein(t, '{k}'), 'i': {i}, 'name': '{k}'}}"

QUERIES = {
    "a4_transfer_stats": lambda s, d: logs.transfer_stats(entries(s, d)),
    "a5_printed_stats": lambda s, d: logs.printed_stats(logs.transfer_stats(entries(s, d))),
    "a8_operation_stats": lambda s, d: logs.operation_stats(events(s, d).select((F.col("event_type") != "error").alias("succeeded"), (F.col("event_id") % 4).alias("retries"))),
    "a8_f15_errors_by_category": lambda s, d: logs.errors_by_category(_errors(s, d)),
    "f15_error_classes": lambda s, d: logs.classify_errors(_errors(s, d)).select("event_id", "error_kind", "category", "is_fatal", "is_transient", "exit_class"),
    "f13_events_for_job": lambda s, d: logs.events_for(events(s, d), "user_id", 7).select("event_id", "event_type"),
    "f14_provenance_classes": _provenance,
    "a17_histogram": lambda s, d: logs.histogram(events(s, d), "value", (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0), ("event_type",)),
    "a17_counters": lambda s, d: logs.labelled_totals(entries(s, d).withColumn("protocol", F.concat(F.lit("p"), (F.col("line_no") % 3).cast("string"))), ("protocol", "status"), "bytes_copied"),
    "a18_metadata_stats": lambda s, d: events(s, d).agg(F.count("*").alias("files"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("preserved")),
    "a19_metrics_report": lambda s, d: logs.metrics_report(entries(s, d).groupBy((F.col("line_no") % 200).alias("run_id")).agg(F.sum("bytes_copied").alias("bytes"), F.sum("duration_ms").alias("total_ms"), F.sum(F.when(F.col("line_no") % 3 == 0, F.col("duration_ms")).otherwise(0)).alias("scan_ms"), F.sum(F.when(F.col("line_no") % 3 == 1, F.col("duration_ms")).otherwise(0)).alias("copy_ms"), F.sum(F.when(F.col("line_no") % 3 == 2, F.col("duration_ms")).otherwise(0)).alias("verify_ms"), F.count_if(F.col("status") == "failed").alias("errors"))).withColumn("messages", F.array_join("messages", "|")),
    "a20_level_counts": lambda s, d: logs.level_counts(events(s, d).select(F.concat(F.lit("t "), F.when(F.col("event_type") == "error", "[ERROR]").when(F.col("event_type") == "view", "[WARN]").otherwise("[INFO]"), F.lit(" x")).alias("value"))),
    "a22_o2_history_tail": lambda s, d: logs.last_lines(logs.history(_history_lines(s, d)), 20),
    "s8_history": lambda s, d: logs.history(_history_lines(s, d)),
    "e1_e4_chain_report": _chain_report,
    "e2_first_failures": lambda s, d: chains.first_failures(signed_lines(s, d), KEY),
    "e2_all_failures": lambda s, d: chains.all_failures(signed_lines(s, d), KEY),
    "e2_failures_in_ranges": lambda s, d: chains.failures_in_ranges(signed_lines(s, d), KEY),
    "e3_forensic_failures": lambda s, d: chains.all_failures(signed_lines(s, d), KEY, skip_hashless=True),
    "x6_hmac": _hmac,
    "x7_x22_text_functions": _texts,
    "x12_formats": _formats,
    "x14_x15_rates": lambda s, d: entries(s, d).select("line_no", F.round(scalars.throughput_mib(F.col("bytes_copied"), F.col("duration_ms")), 9).alias("mib_per_s"), F.round(scalars.progress_percent(F.col("duration_ms"), F.lit(49)), 9).alias("progress"), F.round(scalars.compression_ratio(F.col("bytes_copied"), F.col("duration_ms")), 6).alias("ratio")),
    "x16_traceparent": _trace,
    "x18_x19_backoff": _backoff,
    "o5_nearest_name": _nearest,
    "st3_circuit_breaker": lambda s, d: states.circuit_breaker(_breaker_rows(s, d), 2, 5000),
    "st3_breaker_stream": _breaker_stream,
    "st4_token_bucket": lambda s, d: states.token_bucket(events(s, d).select((F.col("user_id") % 10).alias("stream"), F.col("event_id").alias("ordinal"), (F.col("event_id") * 3).alias("at_ms"), F.floor(F.col("value") * 1000).cast("long").alias("bytes")), 100_000),
    "st5_retry_outcomes": lambda s, d: states.retry_outcomes(_attempts(s, d)),
    "st6_rates": lambda s, d: logs.instantaneous_rates(events(s, d).select((F.col("event_id") / 20).cast("long").alias("op_id"), (F.col("event_id") * 10).alias("at_ms"), (F.col("event_id") % 20 * 1000).alias("bytes"), F.lit(20_000).alias("total"))),
    "st8_spans": lambda s, d: logs.spans(events(s, d).select((F.col("event_id") / 3).cast("long").alias("span_id"), F.when(F.col("event_id") % 3 == 0, "start").when(F.col("event_id") % 9 != 8, "end").otherwise("note").alias("kind"), (F.col("event_id") * F.col("event_id")).alias("at_ms"))),
    "st9_rolling_counts": lambda s, d: states.rolling_counts(events(s, d)).withColumn("total", F.round("total", 4)),
}

_NEAREST_T = "lower(substr(([" + ", ".join(f"'{k}'" for k in KNOWN) + "])[(c_custkey % 5 + 1)::INT], 1, 6) || substr(md5(c_custkey::VARCHAR), 1, 2))"

ORACLES = {
    "a4_transfer_stats": f"WITH {ENTRIES_SQL}, {_STATS_SQL} SELECT * FROM st",
    "a5_printed_stats": f"""WITH {ENTRIES_SQL}, {_STATS_SQL} SELECT total_bytes // total_operations AS average_bytes, round(total_bytes / total_duration_ms::DOUBLE * 1000.0, 6) AS average_bps,
 round(with_compression / total_operations::DOUBLE * 100.0, 6) AS compressed_pct, round(total_bytes / (1.0 - mean_compression_ratio / 100.0) - total_bytes, 3) AS saved_bytes FROM st""",
    "a8_operation_stats": "SELECT count(*) AS operations, count(*) FILTER (event_type != 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round((count(*) FILTER (event_type != 'error')) / count(*)::DOUBLE * 100.0, 6) AS success_rate, round(avg(event_id % 4), 6) AS avg_retries, max(event_id % 4) AS max_retries FROM events",
    "a8_f15_errors_by_category": f"WITH {ERRORS_SQL} SELECT category, count(*) AS errors FROM ev JOIN er ON ev.error_kind = er.error_kind GROUP BY 1",
    "f15_error_classes": f"WITH {ERRORS_SQL} SELECT event_id, ev.error_kind, category, is_fatal, is_transient, exit_class FROM ev JOIN er ON ev.error_kind = er.error_kind",
    "f13_events_for_job": "SELECT event_id, event_type FROM events WHERE user_id = 7",
    "f14_provenance_classes": "SELECT ([" + ", ".join(f"'{t}'" for t in _TYPES) + "])[(event_id % 20 + 1)::INT] AS event_type, count(*) AS n, event_type LIKE 'chunk%' AS is_chunk, event_type LIKE 'job%' AS is_job FROM (SELECT event_id FROM events) GROUP BY 1",
    "a17_histogram": """SELECT e.event_type, le, count(*) FILTER (value <= b) AS count, any_value(t.s) AS sum FROM events e JOIN (SELECT event_type, round(sum(value), 4) AS s FROM events GROUP BY 1) t ON e.event_type = t.event_type,
 (SELECT unnest(['0.01', '0.05', '0.1', '0.5', '1.0', '5.0', '10.0', 'Infinity']) AS le, unnest([0.01::DOUBLE, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 'Infinity'::DOUBLE]) AS b) GROUP BY 1, 2""",
    "a17_counters": f"WITH {ENTRIES_SQL} SELECT 'p' || (line_no % 3)::VARCHAR AS protocol, status, count(*) AS events, sum(bytes_copied)::BIGINT AS total FROM en GROUP BY 1, 2",
    "a18_metadata_stats": "SELECT count(*) AS files, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS preserved FROM events",
    "a19_metrics_report": f"""WITH {ENTRIES_SQL}, r AS (SELECT line_no % 200 AS run_id, sum(bytes_copied)::BIGINT AS bytes, sum(duration_ms)::BIGINT AS t, coalesce(sum(duration_ms) FILTER (line_no % 3 = 0), 0)::BIGINT AS a, coalesce(sum(duration_ms) FILTER (line_no % 3 = 1), 0)::BIGINT AS b, coalesce(sum(duration_ms) FILTER (line_no % 3 = 2), 0)::BIGINT AS c, count(*) FILTER (status = 'failed') AS errors FROM en GROUP BY 1),
q AS (SELECT run_id, errors, CASE WHEN t > 0 THEN round(bytes / 1048576.0::DOUBLE / (t / 1000.0)::DOUBLE, 4) ELSE 0.0 END AS mib_per_s, round(coalesce(a / nullif(t, 0)::DOUBLE * 100.0, 0.0), 4) AS scan_pct, round(coalesce(b / nullif(t, 0)::DOUBLE * 100.0, 0.0), 4) AS copy_pct, round(coalesce(c / nullif(t, 0)::DOUBLE * 100.0, 0.0), 4) AS verify_pct FROM r)
SELECT run_id, mib_per_s, scan_pct, copy_pct, verify_pct, concat_ws('|', CASE WHEN errors > 0 THEN 'errors' END, CASE WHEN mib_per_s < 1.0 THEN 'slow' END, CASE WHEN verify_pct > 30 THEN 'verification' END) AS messages FROM q""",
    "a20_level_counts": "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS warns, count(*) FILTER (event_type NOT IN ('error', 'view')) AS infos FROM events",
    "s8_history": """SELECT event_id AS line_no, 't' || event_id::VARCHAR AS timestamp, '/a/' || user_id::VARCHAR AS source, '-' AS dest, CASE WHEN event_id % 5 != 0 THEN event_id * 7 END AS bytes, NULL::BIGINT AS files,
 CASE WHEN event_id % 4 != 0 THEN (event_id % 10)::DOUBLE + 0.5 END AS duration_secs, event_type AS status FROM events WHERE event_id % 11 != 0 AND event_id % 13 != 0""",
    "x6_hmac": f"SELECT doc_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(text)))) AS mac FROM documents",
    "x12_formats": "WITH s AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT * pow(37, o_orderkey % 7)::BIGINT AS n FROM orders), u AS (SELECT *, CASE WHEN n >= 1024::BIGINT**4 THEN 4 WHEN n >= 1024**3 THEN 3 WHEN n >= 1024**2 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS p FROM s) SELECT o_orderkey, CASE WHEN p = 0 THEN n::VARCHAR || ' B' ELSE printf('%.1f', n / pow(1024.0, p)) || (['', ' KiB', ' MiB', ' GiB', ' TiB'])[p + 1] END AS size_text, CASE WHEN p = 0 THEN n::VARCHAR || ' B' ELSE printf('%.2f', n / pow(1024.0, p)) || (['', ' KB', ' MB', ' GB', ' TB'])[p + 1] END AS bytes_text FROM u",
    "x14_x15_rates": f"WITH {ENTRIES_SQL} SELECT line_no, round(CASE WHEN duration_ms > 0 THEN bytes_copied / 1048576.0::DOUBLE / (duration_ms / 1000.0::DOUBLE) ELSE 0.0 END, 9) AS mib_per_s, round(duration_ms / 49::DOUBLE * 100.0, 9) AS progress, round(CASE WHEN duration_ms > 0 THEN bytes_copied / duration_ms::DOUBLE * 100.0 ELSE 100.0 END, 6) AS ratio FROM en",
    "x16_traceparent": "SELECT event_id, CASE WHEN ok THEN md5(event_id::VARCHAR) END AS trace_id, CASE WHEN ok THEN substr(md5(user_id::VARCHAR), 1, 16) END AS span_id, CASE WHEN ok THEN '01' END AS flags FROM (SELECT *, event_id % 5 != 0 AND event_id % 7 != 0 AS ok FROM events)",
    "x18_x19_backoff": "SELECT l_orderkey, l_linenumber, least(5000 * pow(2, l_linenumber - 1), 300000)::BIGINT AS delay_ms, least(CASE l_orderkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 200 * l_linenumber ELSE 200 * pow(2, l_linenumber - 1) END, 3000)::BIGINT AS object_delay_ms FROM lineitem",
    "x7_x22_text_functions": r"""WITH p AS (SELECT p_partkey, p_name, 'dir a/' || p_name || '.' || p_type AS path, CASE WHEN p_partkey % 3 = 0 THEN '''=' ELSE '' END || p_name || CASE WHEN p_partkey % 4 = 0 THEN ',"x"' ELSE '' END AS f FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: w != ''), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title,
 upper('dir a/' || regexp_replace(path[7:], '([a-z]+)', '<\1>', 'g')) AS transformed, CASE WHEN length(path) <= 12 THEN path ELSE '...' || right(path, 9) END AS shown, replace(replace(path, '/', '_'), '\', '_') AS file_name,
 CASE WHEN regexp_matches(f, '[,"]') THEN '"' || replace(f, '"', '""') || '"' ELSE f END AS csv FROM p""",
    "o5_nearest_name": f"WITH t AS (SELECT c_custkey, {_NEAREST_T} AS t FROM customer), o AS (SELECT c_custkey, t, unnest([{', '.join(_OPTION(k, i) for i, k in enumerate(KNOWN))}]) AS o FROM t), b AS (SELECT c_custkey, arg_min(o.name, o.d * 10 + o.i) AS meant FROM o WHERE o.d > 0 AND o.d <= greatest(length(t) // 2, 2) GROUP BY 1) SELECT t.c_custkey, meant FROM t LEFT JOIN b ON t.c_custkey = b.c_custkey",
    "st5_retry_outcomes": f"""WITH {ATTEMPTS_SQL}, e AS (SELECT *, CASE WHEN kind IS NULL THEN 'succeeded' WHEN m = 0 THEN 'skipped' WHEN kind = 'config' THEN CASE WHEN m = 1 THEN 'partial' ELSE 'failed' END WHEN attempt >= 4 THEN CASE WHEN m = 1 THEN 'partial' ELSE 'exhausted' END END AS fin FROM att)
SELECT op_id, coalesce(min(attempt) FILTER (fin IS NOT NULL), max(attempt)) AS made, coalesce(arg_min(fin, attempt) FILTER (fin IS NOT NULL), 'open') AS outcome FROM e GROUP BY 1""",
    "st6_rates": """WITH s AS (SELECT event_id // 20 AS op_id, event_id * 10 AS at_ms, event_id % 20 * 1000 AS bytes FROM events), r AS (SELECT *, lag(at_ms) OVER w AS pa, lag(bytes) OVER w AS pb, min(at_ms) OVER (PARTITION BY op_id) AS a0 FROM s WINDOW w AS (PARTITION BY op_id ORDER BY at_ms))
SELECT op_id, at_ms, round((bytes - pb) / (at_ms - pa)::DOUBLE * 1000.0, 6) AS rate, round(CASE WHEN at_ms > a0 AND bytes > 0 THEN (20000 - bytes) / (bytes / (at_ms - a0)::DOUBLE * 1000.0) END, 6) AS eta_s FROM r""",
    "st8_spans": "SELECT event_id // 3 AS span_id, min(event_id * event_id) FILTER (event_id % 3 = 0) AS started, max(event_id * event_id) FILTER (event_id % 3 != 0 AND event_id % 9 != 8) AS ended, max(event_id * event_id) FILTER (event_id % 3 != 0 AND event_id % 9 != 8) - min(event_id * event_id) FILTER (event_id % 3 = 0) AS duration_ms FROM events GROUP BY 1",
    "st9_rolling_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
ORACLES["a22_o2_history_tail"] = ORACLES["s8_history"] + " ORDER BY line_no DESC LIMIT 20"


# Walks that depend on their own outcomes, by recursion over the events' numbers. ---------------------

_BREAKER = """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id % 10 AS endpoint, event_id AS ordinal, event_id * 700 AS at_ms, event_type != 'error' AS good, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events),
w AS (SELECT DISTINCT endpoint, 0::BIGINT AS k, 'closed' AS kind, 0::BIGINT AS failures, 0::BIGINT AS opened, 0::BIGINT AS ordinal, 0::BIGINT AS at_ms, true AS allowed FROM ev
 UNION ALL SELECT endpoint, k, CASE WHEN NOT allowed THEN 'open' WHEN good THEN 'closed' WHEN half OR failures + 1 >= 2 THEN 'open' ELSE kind END, CASE WHEN NOT allowed THEN failures WHEN good THEN 0 ELSE failures + 1 END,
  CASE WHEN allowed AND NOT good AND (half OR failures + 1 >= 2) THEN at_ms ELSE opened END, ordinal, at_ms, allowed FROM
  (SELECT ev.endpoint, ev.k, ev.ordinal, ev.at_ms, good, kind, failures, opened, kind = 'open' AS half, kind != 'open' OR ev.at_ms - opened >= 5000 AS allowed FROM w JOIN ev ON ev.endpoint = w.endpoint AND ev.k = w.k + 1))
SELECT endpoint, ordinal, at_ms, allowed, kind AS state FROM w WHERE k > 0"""
_BUCKET = """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id % 10 AS stream, event_id AS ordinal, event_id * 3 AS at_ms, ceil(floor(value * 1000) / 100.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events),
w AS (SELECT stream, k, ordinal, at_ms, tokens, 1000 - tokens AS held FROM ev WHERE k = 1
 UNION ALL SELECT ev.stream, ev.k, ev.ordinal, ev.at_ms, ev.tokens, least(1000, held + ev.at_ms - w.at_ms) - ev.tokens FROM w JOIN ev ON ev.stream = w.stream AND ev.k = w.k + 1)
SELECT stream, ordinal, tokens, greatest(0, -held) AS wait_ms FROM w"""
#: HMAC of bytes x, in hexadecimal.
_MAC = lambda x: f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || {x})))"
_SIGNED = f"""WITH RECURSIVE can AS MATERIALIZED (SELECT chain, seq, event_type, '{{"sequence":' || seq::VARCHAR || ',"type":"' || event_type || '"}}' AS c FROM (SELECT 'c' || user_id::VARCHAR AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type FROM events)),
sg AS (SELECT chain, seq, {_MAC(f"unhex('{chains.ZERO}') || encode(c)")} AS h FROM can WHERE seq = 0 UNION ALL SELECT can.chain, can.seq, {_MAC("unhex(h) || encode(can.c)")} FROM sg JOIN can ON can.chain = sg.chain AND can.seq = sg.seq + 1),
ln AS MATERIALIZED (SELECT can.chain, can.seq AS line_no, can.seq AS sequence, CASE WHEN can.chain = 'c5' AND can.seq = 1 THEN NULL ELSE h END AS h, CASE WHEN can.chain = 'c3' AND can.seq = 2 THEN replace(c, '"type":"', '"type":"x') ELSE c END AS c,
 row_number() OVER (PARTITION BY can.chain ORDER BY can.seq) AS k FROM can JOIN sg ON sg.chain = can.chain AND sg.seq = can.seq WHERE NOT (can.chain = 'c7' AND can.seq = 4))"""
_WALKED = """wk AS (SELECT DISTINCT chain, 0::BIGINT AS k, '{zero}' AS prior, -1::BIGINT AS place, 0::BIGINT AS line_no, false AS missing, false AS gap, false AS wrong FROM ln
 UNION ALL SELECT chain, k, CASE WHEN h IS NULL OR h != want THEN prior ELSE want END, CASE WHEN h IS NULL THEN place ELSE sequence END, line_no, h IS NULL, h IS NOT NULL AND sequence != place + 1, coalesce(h != want, false) FROM
  (SELECT ln.chain, ln.k, ln.line_no, ln.sequence, ln.h, prior, place, {mac} AS want FROM wk JOIN ln ON ln.chain = wk.chain AND ln.k = wk.k + 1))""".format(zero=chains.ZERO, mac=_MAC("unhex(prior) || encode(ln.c)"))
_FAILED = f"{_SIGNED}, {_WALKED}, fa AS (SELECT chain, line_no, unnest(list_filter([CASE WHEN missing THEN 'missing_hash' END, CASE WHEN gap THEN 'sequence' END, CASE WHEN wrong THEN 'hash' END], lambda x: x IS NOT NULL)) AS failure FROM wk WHERE k > 0)"

ORACLES["st3_circuit_breaker"] = ORACLES["st3_breaker_stream"] = _BREAKER
ORACLES["st4_token_bucket"] = _BUCKET
ORACLES["e2_all_failures"] = ORACLES["e2_failures_in_ranges"] = f"{_FAILED} SELECT * FROM fa"
ORACLES["e3_forensic_failures"] = f"{_FAILED} SELECT * FROM fa WHERE failure = 'hash'"
ORACLES["e2_first_failures"] = f"""{_SIGNED}, t AS (SELECT chain, line_no, CASE WHEN h IS NULL THEN 'missing_hash' WHEN sequence != coalesce(lag(sequence) OVER w + 1, 0) THEN 'sequence' WHEN h != {_MAC(f"unhex(coalesce(lag(h) OVER w, '{chains.ZERO}')) || encode(c)")} THEN 'hash' END AS failure FROM ln WINDOW w AS (PARTITION BY chain ORDER BY line_no))
SELECT chain, min(line_no) AS line_no, arg_min(failure, line_no) AS failure FROM t WHERE failure IS NOT NULL GROUP BY chain"""
ORACLES["e1_e4_chain_report"] = f"""{_FAILED}, b AS (SELECT chain, count(DISTINCT line_no) AS n FROM fa GROUP BY chain)
SELECT e.chain, events, coalesce(n, 0) AS failures, n IS NULL AS is_valid, round(coalesce(n, 0) / events::DOUBLE * 100.0, 6) AS failure_rate FROM (SELECT chain, count(*) AS events FROM ln GROUP BY chain) e LEFT JOIN b ON b.chain = e.chain"""

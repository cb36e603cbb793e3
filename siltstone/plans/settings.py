"""Queries over settings, metadata, files written and read back, and command lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import configs, index, logs, sync
from ..sources import audit_files, commands, listing
from ..streaming import states
from .content import BITS_SQL, LINE_SQL, WINDOWS_SQL, _bits, _windows, lineitem_index
from .files import FILES_SQL, dest_files, source_files
from .logs import ENTRIES_SQL, entries, events


def settings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    bit = lambda n: (k % n == 0)
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("id"), bit(2).alias("use_zero_copy"), (~bit(7)).alias("zero_copy_available"), bit(3).alias("verify_checksum"), bit(5).alias("resume"),
        pick("none", "none", "zstd:1", "none").alias("compression"), bit(11).alias("generate_manifest"), pick("size", "delta", "checksum").alias("check_mode"),
        (k % 6).cast("int").alias("parallel"), bit(4).alias("show_progress"), pick("copy", "sync", "update", "mirror", "copy").alias("copy_mode"),
        pick("ext4", "smb", "nfs", "s3", "xfs", "gcs", "ext4").alias("filesystem"), (k % 17).cast("int").alias("cores"), (k % 601).alias("io_mb_s"), (k % 4).alias("ram_gb"),
        (k % 12).cast("int").alias("retries"), (k % 3 * 1048576).cast("int").alias("chunk_size"), bit(9).alias("exponential_backoff"),
    )


_SETTINGS_SQL = """SELECT p_partkey AS id, p_partkey % 2 = 0 AS zc, p_partkey % 7 != 0 AS av, p_partkey % 3 = 0 AS ck, p_partkey % 5 = 0 AS rs, (['none','none','zstd:1','none'])[(p_partkey % 4 + 1)::INT] AS cp,
 p_partkey % 11 = 0 AS mf, (['size','delta','checksum'])[(p_partkey % 3 + 1)::INT] AS cm, (p_partkey % 6)::INT AS pl, p_partkey % 4 = 0 AS sp, (['copy','sync','update','mirror','copy'])[(p_partkey % 5 + 1)::INT] AS mo,
 (['ext4','smb','nfs','s3','xfs','gcs','ext4'])[(p_partkey % 7 + 1)::INT] AS fs, (p_partkey % 17)::INT AS co, p_partkey % 601 AS io, p_partkey % 4 AS ram, (p_partkey % 12)::INT AS re, (p_partkey % 3 * 1048576)::INT AS cs, p_partkey % 9 = 0 AS eb, '' AS notes FROM part"""

_STEPS = [
    ("fs IN ('smb','nfs') AND NOT rs", "rs", "true", "network_resume"),
    ("fs IN ('smb','nfs') AND re < 5", "re", "5", "network_retries"),
    ("co >= 8 AND io < 50 AND cp = 'none'", "cp", "'zstd:3'", "slow_io_compression"),
    ("ram < 1 AND pl > 4", "pl", "2", "low_memory"),
    ("fs IN ('ext4','xfs') AND co > 8 AND pl = 0", "pl", "co // 2", "auto_workers"),
    ("io > 500 AND cs <= 1048576", "cs", "4194304", "fast_io_chunks"),
    ("fs IN ('s3','gcs') AND cp = 'none'", "cp", "'zstd:3'", "cloud_compression"),
    ("fs IN ('s3','gcs') AND re < 10", "re", "10", "cloud_retries"),
    ("fs IN ('s3','gcs') AND NOT eb", "eb", "true", "cloud_backoff"),
    ("zc AND NOT av", "zc", "false", "zerocopy_unavailable"),
    ("zc AND ck", "zc", "false", "zerocopy_disabled_checksum"),
    ("rs AND ck", "ck", "false", "checksum_disabled_resume"),
    ("rs AND cp != 'none'", "rs", "false", "resume_disabled_compression"),
    ("zc AND rs", "zc", "false", "zerocopy_disabled_resume"),
    ("mf AND zc", "zc", "false", "zerocopy_disabled_manifest"),
    ("cm = 'delta' AND zc", "zc", "false", "zerocopy_disabled_delta"),
    ("pl > 1 AND sp", None, None, "parallel_progress_warning"),
    ("mo IN ('sync','update') AND cm = 'checksum'", None, None, "sync_checksum_performance"),
    ("zc AND cp != 'none'", "zc", "false", "zerocopy_disabled_compression"),
]


def _settings_sql() -> str:
    parts, last = [f"s0 AS ({_SETTINGS_SQL})"], "s0"
    for i, (test, column, value, code) in enumerate(_STEPS, 1):
        change = f"CASE WHEN {test} THEN {value} ELSE {column} END AS {column}, " if column else ""
        parts.append(f"s{i} AS (SELECT * REPLACE ({change}CASE WHEN {test} THEN notes || '|{code}' ELSE notes END AS notes) FROM {last})")
        last = f"s{i}"
    return "WITH " + ", ".join(parts) + f" SELECT id, zc AS use_zero_copy, ck AS verify_checksum, rs AS resume, cp AS compression, pl::INT AS parallel, re::INT AS retries, cs::INT AS chunk_size, eb AS exponential_backoff, notes[2:] AS notices FROM {last}"


def _optimise(spark, d):
    done = configs.optimise(settings(spark, d))
    return done.select("id", "use_zero_copy", "verify_checksum", "resume", "compression", "parallel", "retries", "chunk_size", "exponential_backoff", F.array_join("notices", "|").alias("notices"))


def _meta(spark, d):
    src = source_files(spark, d)
    xattrs = F.map_from_arrays(F.array(F.lit("user.a"), F.lit("security.b")), F.array(F.col("path"), F.col("n").cast("string")))
    return src.select("path", "n", "size", "modified", F.col("modified").alias("accessed"), F.lit(5).cast("long").alias("created"), F.lit(420).alias("permissions"), (F.col("n") % 3).alias("uid"), (F.col("n") % 4).alias("gid"), xattrs.alias("xattrs"))


def _filter_meta(spark, d):
    kept = configs.filter_metadata(_meta(spark, d), ("ownership", "times"), "^security")
    return kept.select("path", "uid", "gid", "modified", "created", "permissions", F.array_join(F.map_keys("xattrs"), ",").alias("attributes"), F.get(F.map_values("xattrs"), F.lit(0)).alias("value"))


def _meta_round_trip(spark, d):
    held = _meta(spark, d)
    back = configs.metadata_from_json(configs.metadata_json(held))
    return back.select("path", "size", "modified", "permissions", "uid", "gid", F.try_element_at("xattrs", F.lit("user.a")).alias("attribute"))


def _audit_files(spark, d):
    rows = entries(spark, d).select(F.concat(F.lit("t"), F.col("line_no").cast("string")).alias("timestamp"), "source", F.when(F.col("line_no") % 3 == 0, 'a,"b').otherwise("c").alias("destination"), "bytes_copied", "duration_ms", F.lit("-").alias("checksum"), "compression_ratio", "status", F.lit(1).alias("attempts"), F.lit("-").alias("error"))
    out = []
    for form, read in (("json", logs.read_audit_json), ("csv", logs.read_audit_csv)):
        folder = audit_files.fresh_folder(spark, f"audit-{form}")
        logs.write_audit(rows, folder, form)
        out.append(read(spark, folder).select(F.lit(form).alias("form"), "timestamp", "source", "destination", "bytes_copied", "duration_ms", "compression_ratio", "status"))
    return out[0].unionByName(out[1])


_KINDS = logs.CHUNK_EVENTS + logs.FILE_EVENTS + logs.JOB_EVENTS + logs.STAR_EVENTS + ("other",)


def _provenance_files(spark, d):
    """Events as provenance lines, some of a foreign kind, written and read back."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    folder = audit_files.fresh_folder(spark, "provenance")
    events(spark, d).select(k.cast("string").alias("ts"), kind.alias("event_type"), F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), (k * 3).alias("bytes")).write.json(folder)
    return logs.read_provenance(spark, folder).select("ts", "event_type", "job_id", "bytes")


def _strict_files(spark, d):
    folder = audit_files.fresh_folder(spark, "strict")
    events(spark, d).select("event_id", "event_type").write.json(folder)
    return logs.read_strict(spark, folder, "event_id long, event_type string")


def _scanned(spark, d):
    """Bytes of files by directory, from a recursive listing of text files."""
    folder = audit_files.fresh_folder(spark, "listing")
    events(spark, d).select(F.col("event_type").alias("kind"), F.md5(F.col("event_id").cast("string")).alias("line")).write.partitionBy("kind").text(folder)
    return listing.scan(spark, folder).groupBy(F.regexp_extract("path", "kind=([^/]+)/", 1).alias("kind")).agg(F.sum("size").alias("bytes"))


def _tailed(spark, d):
    """A log folder followed as a stream, a few files a micro-batch, into a table."""
    source, sink, state = (audit_files.fresh_folder(spark, f"tail-{x}") for x in ("source", "sink", "state"))
    events(spark, d).select("event_id", "event_type", "user_id").write.json(source)
    stream = states.tail_json(spark, source, "event_id long, event_type string, user_id long", 2)
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _plan_files(spark, d):
    spans = _windows(spark, d).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("window_id", "first_chunk", "count", "merkle_root"))).alias("windows"))
    folder = audit_files.fresh_folder(spark, "plans")
    audit_files.save_plan(spans, folder)
    back = audit_files.load_plan(spark, folder, "file_id long, windows array<struct<window_id:int,first_chunk:int,count:int,merkle_root:string>>")
    return back.select("file_id", F.explode("windows").alias("w")).select("file_id", "w.*")


def _versioned(spark, d):
    folder = audit_files.fresh_folder(spark, "index")
    audit_files.save_versioned(lineitem_index(spark, d).groupBy("content_id").agg(F.count("*").alias("n")), folder, 2)
    return audit_files.load_versioned(spark, folder, 2)


def _commands(spark, d):
    k = F.col("p_partkey")
    verb = F.element_at(F.array(*map(F.lit, ("cp", "copy", "sync", "run", "du", "#"))), (k % 6 + 1).cast("int"))
    lines = spark.read.parquet(f"{d}/part.parquet").select(k.alias("line_no"), F.concat(verb, F.lit(" 'a b' "), F.col("p_brand")).alias("value"))
    return commands.parse_commands(lines).withColumn("arguments", F.array_join("arguments", "|"))


def _heads(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    content = docs.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return listing.head(content, 16).join(content.select("path", listing.range_hash(F.col("content"), 8, 64).alias("range_hash")), "path").select("path", F.lower(F.hex("head")).alias("head"), "range_hash")


QUERIES = {
    "g1_optimise_settings": _optimise,
    "f11_zero_copy": lambda s, d: source_files(s, d).select("path", configs.should_use_zero_copy(F.col("size") * 40, F.col("n") % 7 != 0, F.col("n") % 5 == 0, F.col("n") % 2 == 0, F.col("n") % 3 == 0).alias("zero_copy")),
    "o6_deletion_order": lambda s, d: sync.deletions(source_files(s, d).select("path"), dest_files(s, d).select("path")).orderBy(F.col("depth").desc(), "path").select("path", "depth"),
    "s4_head_range_hash": _heads,
    "s1_scan": _scanned,
    "s6_s7_audit_files": _audit_files,
    "s9_provenance_files": _provenance_files,
    "s10_strict_files": _strict_files,
    "st1_st2_tail": _tailed,
    "s11_plan_files": _plan_files,
    "s12_s14_versioned_tables": _versioned,
    "s18_commands": _commands,
    "u5_unset_positions": lambda s, d: _bits(s, d).where(~F.col("bit")).select("window_id", "pos"),
    "x1_sha256": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", scalars.sha256_hex(F.encode("html", "UTF-8")).alias("digest")),
    "x10_x11_filter_metadata": _filter_meta,
    "x21_metadata_json": _meta_round_trip,
    "a12_overall_progress": lambda s, d: index.window_progress(_bits(s, d).withColumn("window_id", F.lit(0))).select("total", "completed", "missing", "percent"),
}

ORACLES = {
    "s1_scan": "SELECT event_type AS kind, count(*) * 33 AS bytes FROM events GROUP BY 1",
    "s9_provenance_files": f"SELECT event_id::VARCHAR AS ts, ({list(_KINDS)})[(event_id % {len(_KINDS)} + 1)::INT] AS event_type, 'j' || user_id::VARCHAR AS job_id, event_id * 3 AS bytes FROM events WHERE event_id % {len(_KINDS)} != {len(_KINDS) - 1}",
    "s10_strict_files": "SELECT event_id, event_type FROM events",
    "st1_st2_tail": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "g1_optimise_settings": _settings_sql(),
    "f11_zero_copy": f"WITH {FILES_SQL} SELECT path, n % 7 != 0 AND n % 5 != 0 AND (n % 3 = 0 OR n % 2 = 0) AND size * 40 >= 65536 AS zero_copy FROM src",
    "o6_deletion_order": f"WITH {FILES_SQL} SELECT path, len(string_split(path, '/'))::INT AS depth FROM dst WHERE path NOT IN (SELECT path FROM src) ORDER BY 2 DESC, 1",
    "s4_head_range_hash": "SELECT doc_id::VARCHAR AS path, lower(hex(encode(text)[1:16])) AS head, sha256(encode(text)[9:72]) AS range_hash FROM documents",
    "s6_s7_audit_files": f"""WITH {ENTRIES_SQL} SELECT form, 't' || line_no::VARCHAR AS timestamp, source, CASE WHEN line_no % 3 = 0 THEN 'a,"b' ELSE 'c' END AS destination, bytes_copied, duration_ms, compression_ratio, status FROM en, (SELECT unnest(['json', 'csv']) AS form)""",
    "s11_plan_files": WINDOWS_SQL + "SELECT * FROM r",
    "s12_s14_versioned_tables": f"WITH {LINE_SQL} SELECT content_id, count(*) AS n FROM loc GROUP BY 1",
    "s18_commands": "SELECT p_partkey AS line_no, (['copy', 'copy', 'copy', 'run', 'du'])[(p_partkey % 6 + 1)::INT] AS verb, 'a b|' || p_brand AS arguments, CASE WHEN p_partkey % 6 = 3 THEN 'rejected' ELSE 'ok' END AS status FROM part WHERE p_partkey % 6 != 5",
    "u5_unset_positions": f"WITH {BITS_SQL} SELECT window_id, pos FROM bits WHERE NOT bit",
    "x1_sha256": "SELECT page_id, sha256(html) AS digest FROM pages",
    "x10_x11_filter_metadata": f"WITH {FILES_SQL} SELECT path, NULL::BIGINT AS uid, NULL::BIGINT AS gid, 0::BIGINT AS modified, 0::BIGINT AS created, 420 AS permissions, 'user.a' AS attributes, path AS value FROM src",
    "x21_metadata_json": f"WITH {FILES_SQL} SELECT path, size, modified, 420 AS permissions, n % 3 AS uid, n % 4 AS gid, path AS attribute FROM src",
    "a12_overall_progress": f"WITH {BITS_SQL} SELECT count(*) AS total, count(*) FILTER (bit) AS completed, count(*) FILTER (NOT bit) AS missing, round((count(*) FILTER (bit)) / count(*)::DOUBLE * 100.0, 6) AS percent FROM bits",
}

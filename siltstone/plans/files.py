"""Queries over listings: rule lists, sync decisions, joins of two listings, classification, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, scalars
from ..operators import objects, sync

RULES = """
# keep one source whole, drop another, and numbers ending in 7
+ src1/**
- src2/**
- regex: 7\\.txt$
! + **/*9.txt
include path: src3/en/3.txt
- **/de/**
"""
GLOBS = ("src1*", "src?/en/*", "*/1*.txt", "src2/**")


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a source listing."""
    size = F.octet_length("text").cast("long")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        size.alias("size"),
        (F.col("doc_id") * 7 % 1000).alias("modified"),
        F.sha2("text", 256).alias("digest"),
        F.col("doc_id").alias("n"),
    )


def dest_files(spark: SparkSession, d: str) -> DataFrame:
    """A destination that has some files at another path, and others larger, older, newer or changed."""
    return source_files(spark, d).select(
        F.when(F.col("n") % 7 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"),
        (F.col("size") + F.when(F.col("n") % 5 == 0, 1).otherwise(0)).alias("size"),
        (F.col("modified") + (F.col("n") % 3 - 1) * 10).alias("modified"),
        F.when(F.col("n") % 4 == 0, F.lit("changed")).otherwise(F.col("digest")).alias("digest"),
    )


FILES_SQL = """
src AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path,
               octet_length(encode(text))::BIGINT AS size, doc_id * 7 % 1000 AS modified, sha256(text) AS digest, doc_id AS n FROM documents),
dst AS (SELECT CASE WHEN n % 7 = 0 THEN 'old/' || path ELSE path END AS path, size + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS size,
               modified + (n % 3 - 1) * 10 AS modified, CASE WHEN n % 4 = 0 THEN 'changed' ELSE digest END AS digest FROM src)
"""


def _rules(spark, d):
    rules = patterns.parse_rules(RULES)
    return source_files(spark, d).select("path", patterns.evaluate(rules, F.col("path")).alias("decision"), patterns.should_include(rules, F.col("path")).alias("included"), patterns.survives_pruning(rules, F.col("path")).alias("survives"))


def _config_rules(spark, d):
    rules = patterns.rule_list(include=["src4/**"], exclude=["*.txt"], file_text="+ src5/**\n")
    return source_files(spark, d).where(patterns.should_include(rules, F.col("path"))).select("path")


def _legacy(spark, d):
    return source_files(spark, d).where(~patterns.excluded_by_globs(["src1*/**", "*5.txt", "a**b"], F.col("path"))).select("path")


def _wildcard(spark, d):
    out = None
    for p in GLOBS:
        found = objects.list_matching(source_files(spark, d), p, "path").select(F.lit(p).alias("pattern"), F.lit(patterns.static_prefix(p)).alias("prefix"), "path", "size")
        out = found if out is None else out.unionByName(found)
    return out


def _case_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    part = F.regexp_replace("url", "^https?://", "")
    head = F.encode(F.col("html"), "UTF-8")
    named = pages.select("page_id", F.concat(part, F.element_at(F.array(*map(F.lit, (".html", ".toml", ".log", ".mp4", "/Makefile", "/.env", "/pg_wal/0001", ".YML"))), (F.col("page_id") % 8 + 1).cast("int"))).alias("path"), head.alias("head"))
    c = sync.semantic_class(F.col("path"), F.col("head"))
    return named.select("page_id", c.alias("c")).select("page_id", F.col("c.class").alias("class"), "c.priority", "c.rank", "c.strategy", "c.description")


CASE_SQL = """
SELECT page_id, class, priority, rank::INT AS rank, strategy, class || ': ' || name AS description FROM (
  SELECT page_id, name, CASE WHEN config THEN 'Config' WHEN log THEN 'WAL' WHEN media THEN 'Media' ELSE 'Standard' END AS class,
         CASE WHEN config THEN 'critical' WHEN log THEN 'high' WHEN media THEN 'low' ELSE 'normal' END AS priority,
         CASE WHEN config THEN 0 WHEN log THEN 10 WHEN media THEN 100 ELSE 50 END AS rank,
         CASE WHEN config THEN 'atomic_replace' WHEN log THEN 'append_only' ELSE 'content_defined' END AS strategy
  FROM (SELECT page_id, name,
    CASE WHEN ext IS NULL THEN lower(name) IN ('config','configuration','.env','dockerfile','makefile')
         ELSE ext IN ('toml','json','yaml','yml','ini','conf','lock','env') END AS config,
    lower(path) LIKE '%pg\\_wal%' ESCAPE '\\' OR lower(path) LIKE '%pg\\_xlog%' ESCAPE '\\' OR coalesce(ext IN ('wal','log','binlog'), false) AS log,
    coalesce(ext IN ('mp4','mkv','avi','mov','webm','flv','mp3','flac','wav','ogg','m4a','jpg','jpeg','png','gif','bmp','webp','svg','iso','img','dmg','vdi','vmdk','qcow2','zip','tar','gz','bz2','xz','7z','rar'), false) AS media
    FROM (SELECT page_id, path, name, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) END AS ext
      FROM (SELECT page_id, path, split_part(path, '/', -1) AS name FROM (
        SELECT page_id, regexp_replace(url, '^https?://', '') || (['.html','.toml','.log','.mp4','/Makefile','/.env','/pg_wal/0001','.YML'])[(page_id % 8 + 1)::INT] AS path FROM pages)))))
"""


def _decide(mode):
    return lambda spark, d: sync.decisions(source_files(spark, d).select("path", "size", "modified"), dest_files(spark, d).select("path", "size", "modified"), mode)


def _decide_sql(test):
    return f"WITH {FILES_SQL} SELECT s.path, s.size, CASE WHEN d.path IS NULL THEN 'create' WHEN {test} THEN 'update' ELSE 'skip' END AS action FROM src s LEFT JOIN dst d ON s.path = d.path"


def _needs(spark, d):
    rows = sync.pair(source_files(spark, d).withColumn("blocks", F.col("digest")), dest_files(spark, d).withColumn("blocks", F.col("digest")))
    test = lambda c: sync.needs_transfer(c, F.col("size"), F.col("modified"), F.col("digest"), F.col("blocks"), F.col("dst")).alias(c)
    return rows.select("path", *[test(c) for c in ("modtime", "size", "checksum", "delta")]).withColumnRenamed("size", "size_only")


def _delta_gate(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    size, old = (F.col("o_totalprice") * 1).cast("long"), F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_totalprice") / (F.col("o_orderkey") % 4 + 1)).cast("long"))
    gate = sync.should_use_delta(size, old, F.col("o_orderstatus") != "P", F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") % 17 == 0)
    return o.select("o_orderkey", gate.alias("use_delta"))


def _renames(spark, d):
    moved = source_files(spark, d).select("path", "digest")
    return sync.renames(moved, dest_files(spark, d).select("path", "digest"))


def _references(spark, d):
    """Two earlier copies of all files, each with some files at another path, the second with some changed."""
    src = source_files(spark, d)
    at = lambda n: F.when(F.col("n") % n == 0, F.col("path")).otherwise(F.concat(F.lit("old/"), "path")).alias("path")
    one = src.select(at(3), "size", "modified", "digest", F.lit(1).alias("ref_priority"))
    two = src.select(at(2), "size", "modified", F.when(F.col("n") % 5 == 0, "x").otherwise(F.col("digest")).alias("digest"), F.lit(2).alias("ref_priority"))
    return one.unionByName(two)


REFS_SQL = FILES_SQL + """,
refs AS (SELECT CASE WHEN n % 3 = 0 THEN path ELSE 'old/' || path END AS path, size, modified, digest, 1 AS ref_priority FROM src
         UNION ALL SELECT CASE WHEN n % 2 = 0 THEN path ELSE 'old/' || path END, size, modified, CASE WHEN n % 5 = 0 THEN 'x' ELSE digest END, 2 FROM src)
"""


def _hardlinks(spark, d):
    src = source_files(spark, d).select("path", (F.col("n") % 3).alias("dev"), F.floor(F.col("n") / 6).alias("ino"), F.when(F.col("n") % 5 == 0, 1).otherwise(2).alias("nlink"))
    return sync.hardlinks(src)


def _disk(spark, d):
    need = source_files(spark, d).agg(F.sum("size").alias("required"))
    free = F.explode(F.array(*[F.lit(x).cast("long") for x in (100_000_000, 107_500_000, 108_000_000, 200_000_000)]))
    return need.select("required", free.alias("available")).withColumn("enough", sync.disk_guard(F.col("required"), F.col("available")))


def _dry_run(spark, d):
    plan = _decide("sync")(spark, d)
    gone = sync.deletions(source_files(spark, d).select("path"), dest_files(spark, d).select("path", "size")).select("path", "size", F.lit("delete").alias("action"))
    return sync.dry_run_summary(plan.unionByName(gone))


def _items(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    rank = F.element_at(F.array(*map(F.lit, (0, 10, 50, 100))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").cast("string").alias("path"), rank.alias("rank"), F.floor(F.col("o_totalprice") / 10000).cast("long").alias("size"), F.col("o_orderdate").alias("queued_at"), (F.col("o_orderkey") % 3).alias("retry_count"))


def _priority(spark, d):
    return sync.prioritised(_items(spark, d)).select("path", "rank", "size", "queued_at")


def _priority_other(spark, d):
    return sync.prioritised(_items(spark, d), ("fewest_retries", "largest_first", "newest_first")).select("path", "retry_count", "size")


def _objects(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    cls = F.when(F.col("o_orderstatus") == "F", "GLACIER").when(F.col("o_orderstatus") == "P", "STANDARD_IA")
    return o.select(
        F.concat(F.lit("data/"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderkey").cast("string").alias("version_id"),
        F.col("o_totalprice").cast("long").alias("size"),
        F.col("o_orderdate").alias("last_modified"),
        cls.alias("storage_class"),
        (F.col("o_orderkey") % 10 == 0).alias("is_delete_marker"),
        F.md5(F.col("o_orderpriority")).alias("etag"),
    )


def _versions(spark, d):
    from pyspark.sql import Window as W

    newest = F.row_number().over(W.partitionBy("key").orderBy(F.col("last_modified").desc(), F.col("version_id").desc())) == 1
    return _objects(spark, d).withColumn("is_latest", newest)


OBJECTS_SQL = """
obj AS (SELECT 'data/' || o_custkey::VARCHAR AS key, o_orderkey::VARCHAR AS version_id, trunc(o_totalprice)::BIGINT AS size, o_orderdate AS last_modified,
               CASE o_orderstatus WHEN 'F' THEN 'GLACIER' WHEN 'P' THEN 'STANDARD_IA' END AS storage_class, o_orderkey % 10 = 0 AS is_delete_marker, md5(o_orderpriority) AS etag FROM orders),
ver AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY last_modified DESC, version_id DESC) = 1 AS is_latest FROM obj)
"""


def _compare(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("last_modified", "version_id")
    item = F.struct("version_id", "size", F.unix_timestamp(F.col("last_modified").cast("timestamp")).alias("at"), "etag")
    rows = _objects(spark, d).select("key", item.alias("b"), F.lag(item).over(w).alias("a")).where("a is not null")
    c = objects.compare_versions(F.col("a"), F.col("b"))
    return rows.select("key", F.col("a.version_id").alias("v1"), F.col("b.version_id").alias("v2"), c.alias("c")).select("key", "v1", "v2", "c.*")


def _batch(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.groupBy(F.col("l_suppkey").alias("batch_id")).agg(F.count_if(F.col("l_returnflag") != "R").alias("completed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), (F.count("*") + 5).alias("total"), F.sum(F.col("l_extendedprice").cast("long")).alias("bytes"), (F.count("*") * 9).alias("elapsed_ms"))
    return objects.batch_progress(rows)


def _verify_meta(spark, d):
    src = source_files(spark, d)
    side = lambda k: F.struct((F.col("modified") + F.when(F.col("n") % k == 0, 1).otherwise(0)).alias("modified"), F.lit(420).alias("permissions"), (F.col("n") % 3).alias("uid"), F.when(F.col("n") % 8 != 0, F.col("n") % (k + 1)).alias("gid"), F.create_map(F.lit("user.tag"), F.when(F.col("n") % 6 == 0, F.lit("b")).otherwise(F.lit("a"))).alias("xattrs"))
    rows = src.select("path", side(5).alias("src"), side(10).alias("dst"))
    return sync.verify_metadata(rows, {"times", "permissions", "ownership", "xattrs"}).select("path", "verified")


def _uris(spark, d):
    lead = F.element_at(F.array(*map(F.lit, ("smb://", "cifs://", "s3://", "file://", "", "ftp://", "S3://"))), (F.col("n") % 7 + 1).cast("int"))
    p = scalars.uri_parts(F.concat(lead, F.col("path")))
    return source_files(spark, d).select("file_id", p.alias("p")).select("file_id", "p.protocol", "p.location")


def _listing(spark, d):
    from ..sources import listing

    dotted = source_files(spark, d).withColumn("path", F.when(F.col("n") % 6 == 0, F.concat(F.lit("."), F.col("path"))).when(F.col("n") % 10 == 1, F.concat(F.lit("root"), F.col("n").cast("string"))).otherwise(F.col("path")))
    return listing.listed(dotted.select("path", "size"), max_depth=2, include_hidden=False).unionByName(listing.listed(dotted.select("path", "size"), max_entries=25, include_hidden=True))


def _copy_totals(spark, d):
    plan = _decide("update")(spark, d)
    stats = plan.select(F.when(F.col("action") != "skip", F.col("size")).otherwise(0).alias("bytes_copied"), (F.col("action") != "skip").cast("int").alias("files_copied"), (F.col("action") == "skip").cast("int").alias("files_skipped"), F.lit(0).alias("files_failed"), F.lit(0).alias("chunks_resumed"))
    return sync.copy_totals(stats)


QUERIES = {
    "f1_f5_rule_list": _rules,
    "f4_config_rules": _config_rules,
    "f6_legacy_excludes": _legacy,
    "f7_s17_wildcards": _wildcard,
    "f8_j1_copy": _decide("copy"),
    "f8_j1_update": _decide("update"),
    "f8_j1_sync": _decide("sync"),
    "f9_needs_transfer": _needs,
    "f10_delta_gate": _delta_gate,
    "f12_disk_guard": _disk,
    "j2_mirror_deletions": lambda s, d: sync.deletions(source_files(s, d).select("path"), dest_files(s, d).select("path", "size")),
    "j3_renames": _renames,
    "j4_link_dest": lambda s, d: sync.link_dest(source_files(s, d), _references(s, d)),
    "j6_link_dest_quick": lambda s, d: sync.link_dest_quick(source_files(s, d), _references(s, d)),
    "j11_hardlinks": _hardlinks,
    "j13_compare_versions": _compare,
    "j14_verify_metadata": _verify_meta,
    "a6_copy_totals": _copy_totals,
    "a9_directory_size": lambda s, d: source_files(s, d).groupBy(F.split("path", "/")[0].alias("directory")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files")),
    "a10_dry_run": _dry_run,
    "a14_usage": lambda s, d: objects.usage(_objects(s, d)),
    "a15_version_totals": lambda s, d: objects.version_totals(_versions(s, d)),
    "a16_batch_progress": _batch,
    "c6_semantic_class": _case_pages,
    "o1_priority_chain": _priority,
    "o1_priority_other": _priority_other,
    "o3_versions_sorted": lambda s, d: objects.versions_sorted(_objects(s, d).select("key", "version_id", "size", "last_modified")),
    "s2_listing_options": _listing,
    "s5_uri_parts": _uris,
}

_RULE_CASE = """CASE WHEN regexp_matches(p, '^src1/.*$') THEN 'include' WHEN regexp_matches(p, '^src2/.*$') THEN 'exclude' WHEN regexp_matches(p, '7\\.txt$') THEN 'exclude'
 WHEN regexp_matches(p, '^(?:.*/)?.*9\\.txt$') THEN 'exclude' WHEN p = 'src3/en/3.txt' THEN 'include' WHEN regexp_matches(p, '^(?:.*/)?de/.*$') THEN 'exclude' ELSE 'no_match' END"""

ORACLES = {
    "f1_f5_rule_list": f"""WITH {FILES_SQL}, e AS (SELECT path, path AS p, {_RULE_CASE} AS decision FROM src),
a AS (SELECT path, bool_or({_RULE_CASE} = 'exclude') AS pruned FROM (SELECT path, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS p FROM src) GROUP BY path)
SELECT e.path, decision, decision != 'exclude' AS included, decision != 'exclude' AND NOT pruned AS survives FROM e JOIN a ON e.path = a.path""",
    "f4_config_rules": f"WITH {FILES_SQL} SELECT path FROM src WHERE path LIKE 'src4/%' OR NOT path LIKE '%.txt'",
    "f6_legacy_excludes": f"WITH {FILES_SQL} SELECT path FROM src WHERE NOT (regexp_matches(path, '^src1.*/.*$') OR path LIKE '%5.txt')",
    "f7_s17_wildcards": f"""WITH {FILES_SQL}, g AS (SELECT unnest(['src1*', 'src?/en/*', '*/1*.txt', 'src2/**']) AS pattern, unnest(['src1', 'src', '', 'src2/']) AS prefix)
SELECT pattern, prefix, path, size FROM src, g WHERE path GLOB replace(pattern, '**', '*')""",
    "f8_j1_copy": _decide_sql("true"),
    "f8_j1_update": _decide_sql("s.modified > d.modified"),
    "f8_j1_sync": _decide_sql("s.modified > d.modified OR s.size != d.size"),
    "f9_needs_transfer": f"""WITH {FILES_SQL} SELECT s.path, coalesce(s.size != d.size OR s.modified > d.modified, true) AS modtime, coalesce(s.size != d.size, true) AS size_only,
 coalesce(s.size != d.size OR s.digest != d.digest, true) AS checksum, coalesce(s.size != d.size OR s.digest != d.digest, true) AS delta FROM src s LEFT JOIN dst d ON s.path = d.path""",
    "f10_delta_gate": """WITH o AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS size, CASE WHEN o_orderkey % 9 != 0 THEN trunc(o_totalprice / (o_orderkey % 4 + 1))::BIGINT END AS old, o_orderstatus FROM orders)
SELECT o_orderkey, NOT (o_orderkey % 13 = 0) AND (o_orderkey % 17 = 0 OR (old IS NOT NULL AND o_orderstatus != 'P' AND size >= 65536 AND coalesce(greatest(size, old)::DOUBLE / nullif(least(size, old), 0) <= 2.0, false))) AS use_delta FROM o""",
    "f12_disk_guard": f"""WITH {FILES_SQL}, r AS (SELECT sum(size)::BIGINT AS required FROM src)
SELECT required, available, available >= required + floor(required * 0.1)::BIGINT + 104857600 AS enough FROM r, (SELECT unnest([100000000, 107500000, 108000000, 200000000]::BIGINT[]) AS available)""",
    "j2_mirror_deletions": f"WITH {FILES_SQL} SELECT path, size, len(string_split(path, '/'))::INT AS depth FROM dst WHERE path NOT IN (SELECT path FROM src)",
    "j3_renames": f"WITH {FILES_SQL} SELECT s.path, f.linked_path, s.digest FROM src s JOIN (SELECT digest, min(path) AS linked_path FROM dst GROUP BY 1) f ON s.digest = f.digest WHERE s.path NOT IN (SELECT path FROM dst)",
    "j4_link_dest": f"WITH {REFS_SQL} SELECT s.path, s.size, s.digest, min(r.ref_priority)::INT AS ref_priority FROM src s JOIN refs r ON s.path = r.path AND s.size = r.size AND s.digest = r.digest GROUP BY ALL",
    "j6_link_dest_quick": f"WITH {REFS_SQL} SELECT s.path, s.size, s.modified, min(r.ref_priority)::INT AS ref_priority FROM src s JOIN refs r ON s.path = r.path AND s.size = r.size AND s.modified = r.modified GROUP BY ALL",
    "j11_hardlinks": f"WITH {FILES_SQL} SELECT path, original, path != original AS is_link FROM (SELECT path, min(path) OVER (PARTITION BY n % 3, n // 6) AS original FROM src WHERE n % 5 != 0)",
    "j13_compare_versions": f"""WITH {OBJECTS_SQL}, p AS (SELECT key, version_id AS v2, lag(version_id) OVER w AS v1, size AS s2, lag(size) OVER w AS s1, epoch(last_modified)::BIGINT AS t2, lag(epoch(last_modified)::BIGINT) OVER w AS t1, etag AS e2, lag(etag) OVER w AS e1 FROM obj WINDOW w AS (PARTITION BY key ORDER BY last_modified, version_id))
SELECT key, v1, v2, s2 - s1 AS size_diff, abs(t2 - t1) AS time_diff, e1 = e2 AS same_etag, e1 = e2 AND s1 = s2 AS identical, CASE WHEN t2 > t1 THEN v2 ELSE v1 END AS newer FROM p WHERE v1 IS NOT NULL""",
    "j14_verify_metadata": f"WITH {FILES_SQL} SELECT path, (n % 5 = 0) = (n % 10 = 0) AND CASE WHEN n % 8 != 0 THEN n % 6 = n % 11 ELSE true END AS verified FROM src",
    "a6_copy_totals": f"""WITH {FILES_SQL}, p AS (SELECT s.size, d.path IS NULL OR s.modified > d.modified AS copied FROM src s LEFT JOIN dst d ON s.path = d.path)
SELECT sum(CASE WHEN copied THEN size ELSE 0 END)::BIGINT AS bytes_copied, (count(*) FILTER (copied))::BIGINT AS files_copied, (count(*) FILTER (NOT copied))::BIGINT AS files_skipped, 0::BIGINT AS files_failed, 0::BIGINT AS chunks_resumed FROM p""",
    "a9_directory_size": f"WITH {FILES_SQL} SELECT split_part(path, '/', 1) AS directory, sum(size)::BIGINT AS bytes, count(*) AS files FROM src GROUP BY 1",
    "a10_dry_run": f"""WITH {FILES_SQL}, p AS (SELECT s.size, CASE WHEN d.path IS NULL THEN 'create' WHEN s.modified > d.modified OR s.size != d.size THEN 'update' ELSE 'skip' END AS action FROM src s LEFT JOIN dst d ON s.path = d.path
UNION ALL SELECT size, 'delete' FROM dst WHERE path NOT IN (SELECT path FROM src))
SELECT count(*) FILTER (action = 'create') AS creates, count(*) FILTER (action = 'update') AS updates, count(*) FILTER (action = 'skip') AS skips, count(*) FILTER (action = 'delete') AS deletes, sum(CASE WHEN action IN ('create', 'update') THEN size ELSE 0 END)::BIGINT AS bytes FROM p""",
    "a14_usage": f"WITH {OBJECTS_SQL} SELECT coalesce(storage_class, 'STANDARD') AS storage_class, count(*) FILTER (NOT is_delete_marker) AS objects, coalesce(sum(size) FILTER (NOT is_delete_marker), 0)::BIGINT AS bytes, count(*) FILTER (is_delete_marker) AS delete_markers FROM obj GROUP BY 1",
    "a15_version_totals": f"WITH {OBJECTS_SQL} SELECT key, count(*) FILTER (NOT is_delete_marker) AS versions, coalesce(sum(size) FILTER (NOT is_delete_marker), 0)::BIGINT AS total_size, max(version_id) FILTER (NOT is_delete_marker AND is_latest) AS latest_version, bool_or(is_delete_marker AND is_latest) AS is_deleted FROM ver GROUP BY 1",
    "a16_batch_progress": """WITH b AS (SELECT l_suppkey AS batch_id, count(*) AS n, sum(trunc(l_extendedprice)::BIGINT)::BIGINT AS bytes, count(*) * 9 AS ms FROM lineitem GROUP BY 1)
SELECT batch_id, round(n / (n + 5)::DOUBLE * 100.0, 6) AS percent, round(n / (ms / 1000.0)::DOUBLE, 6) AS ops_per_s, round(bytes / 1048576.0::DOUBLE / (ms / 1000.0)::DOUBLE, 6) AS mib_per_s, round(CASE WHEN floor(ms / 1000.0) >= 1 THEN n / floor(ms / 1000.0)::DOUBLE ELSE 0.0 END, 6) AS result_throughput FROM b""",
    "c6_semantic_class": CASE_SQL,
    "o1_priority_chain": "WITH i AS (SELECT o_orderkey::VARCHAR AS path, ([0, 10, 50, 100])[(o_orderkey % 4 + 1)::INT]::INT AS rank, floor(o_totalprice / 10000)::BIGINT AS size, o_orderdate AS queued_at FROM orders) SELECT path, rank, size, queued_at FROM i ORDER BY rank, size, queued_at, path",
    "o1_priority_other": "SELECT o_orderkey::VARCHAR AS path, o_orderkey % 3 AS retry_count, floor(o_totalprice / 10000)::BIGINT AS size FROM orders ORDER BY 2, 3 DESC, o_orderdate DESC, 1",
    "o3_versions_sorted": f"WITH {OBJECTS_SQL} SELECT key, version_id, size, last_modified FROM obj ORDER BY key, last_modified DESC, version_id",
    "s2_listing_options": f"""WITH {FILES_SQL}, l AS (SELECT CASE WHEN n % 6 = 0 THEN '.' || path WHEN n % 10 = 1 THEN 'root' || n::VARCHAR ELSE path END AS path, size FROM src)
SELECT path, size FROM l WHERE len(string_split(path, '/')) <= 2 AND NOT regexp_matches(path, '(^|/)\\.') UNION ALL (SELECT path, size FROM l ORDER BY path LIMIT 25)""",
    "s5_uri_parts": f"WITH {FILES_SQL} SELECT file_id, (['smb', 'smb', 's3', 'local', 'local', NULL, 's3'])[(n % 7 + 1)::INT] AS protocol, path AS location FROM src",
}

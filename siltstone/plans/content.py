"""Queries over contents: chunks, deduplication, the chunk index, sketches, manifests, deltas, containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import adler32
from ..operators import chunking, containers, dedup, delta, index, manifests, sync

SMALL = chunking.ChunkConfig(64, 256, 1024)


def files(spark: SparkSession, d: str) -> DataFrame:
    return chunking.document_files(spark.read.parquet(f"{d}/documents.parquet"))


def chunks(spark: SparkSession, d: str, size: int = 1024) -> DataFrame:
    return chunking.fixed_chunks(files(spark, d), size)


def chunks_sql(size: int, name: str = "ch") -> str:
    return f"""{name} AS (SELECT doc_id AS file_id, off // {size} AS chunk_index, off AS "offset", octet_length(encode(text)[off + 1:off + {size}]) AS length, sha256(encode(text)[off + 1:off + {size}]) AS content_id
 FROM (SELECT doc_id, text, unnest(range(0, octet_length(encode(text)), {size})) AS off FROM documents WHERE octet_length(encode(text)) > 0))"""


def lineitem_index(spark: SparkSession, d: str) -> DataFrame:
    """A chunk index at scale: line items as locations of parts."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_partkey").alias("content_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_quantity") * 100).cast("long").alias("length"), F.col("l_suppkey").alias("star_id")
    )


LINE_SQL = "loc AS (SELECT l_partkey AS content_id, l_orderkey AS file_id, l_linenumber AS chunk_index, (l_quantity * 100)::BIGINT AS length, l_suppkey AS star_id FROM lineitem)"


def _link_overlap(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.col("doc_id").cast("string")
    make = lambda text, key: chunking.fixed_chunks(docs.select("doc_id", path.alias("path"), F.encode(text, "UTF-8").alias("content")), 256, "path")
    a = make(F.col("text"), 0)
    one = make(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 700), F.lit("#"), F.substring("text", F.lit(702), F.length("text")))), 1).withColumn("ref_priority", F.lit(1))
    two = make(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("none")), 2).withColumn("ref_priority", F.lit(2))
    return sync.link_dest_overlap(a, one.unionByName(two)).withColumn("overlap", F.round("overlap", 9))


LINK_SQL = """
WITH t AS (SELECT doc_id::VARCHAR AS path, 0 AS side, text FROM documents
  UNION ALL SELECT doc_id::VARCHAR, 1, CASE WHEN doc_id % 3 = 0 THEN text ELSE text[1:700] || '#' || text[702:] END FROM documents
  UNION ALL SELECT doc_id::VARCHAR, 2, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'none' END FROM documents),
c AS (SELECT path, side, sha256(encode(text)[off + 1:off + 256]) AS cid FROM (SELECT path, side, text, unnest(range(0, octet_length(encode(text)), 256)) AS off FROM t)),
n AS (SELECT path, side, count(*) AS n FROM c GROUP BY ALL),
h AS (SELECT s.path, r.side, count(*) AS hits FROM (SELECT path, cid FROM c WHERE side = 0) s JOIN (SELECT DISTINCT path, side, cid FROM c WHERE side > 0) r ON s.path = r.path AND s.cid = r.cid GROUP BY ALL),
k AS (SELECT h.path, h.side, hits / a.n::DOUBLE AS overlap, CASE WHEN hits = a.n AND a.n = b.n THEN 'hardlink' WHEN hits / a.n::DOUBLE >= 0.3 THEN 'delta_basis' END AS decision
      FROM h JOIN n a ON a.path = h.path AND a.side = 0 JOIN n b ON b.path = h.path AND b.side = h.side),
best AS (SELECT * FROM k WHERE decision IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY side) = 1)
SELECT a.path, coalesce(b.decision, 'full') AS decision, b.side AS ref_priority, round(coalesce(b.overlap, 0.0), 9) AS overlap FROM n a LEFT JOIN best b ON a.path = b.path WHERE a.side = 0
"""


def _parts(spark, d, kept):
    """All parts as chunk ids; those not ``kept`` under other ids."""
    return spark.read.parquet(f"{d}/part.parquet").select(F.when(F.expr(kept), F.col("p_partkey")).otherwise(-1 - F.col("p_partkey")).alias("content_id"))


def _claims(spark, d):
    loc = lineitem_index(spark, d).withColumn("arrival", F.col("file_id") * 10 + F.col("chunk_index"))
    return index.claims(loc.select("content_id", "arrival"), _parts(spark, d, "p_size > 40"))


def _universe(spark, d):
    maps = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 5).alias("map_id"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_partkey").alias("content_id"))
    return index.merged_universe(maps).groupBy("path", "file_id").agg(F.count("*").alias("locations"))


def _bits(spark, d):
    return lineitem_index(spark, d).select((F.col("file_id") % 50).alias("window_id"), (F.col("file_id") * 10 + F.col("chunk_index")).alias("pos"), (F.col("content_id") % 3 != 0).alias("bit")).groupBy("window_id", "pos").agg(F.bool_or("bit").alias("bit"))


BITS_SQL = LINE_SQL + ", bits AS (SELECT file_id % 50 AS window_id, file_id * 10 + chunk_index AS pos, bool_or(content_id % 3 != 0) AS bit FROM loc GROUP BY 1, 2)"


def _bloom(spark, d):
    """What a filter for a rate of 1 % says of all chunks: members missed, and whether the false finds are within twice the rate."""
    members, probes = _parts(spark, d, "p_size <= 25"), lineitem_index(spark, d).select("content_id").distinct()
    m, k = index.bloom_size(members.count(), 0.01)
    found = index.bloom_probe(probes, "content_id", index.bloom_build(members, "content_id", m, k), m, k).withColumn("found", F.lit(True))
    rows = probes.join(found, "content_id", "left").join(members.distinct().withColumn("member", F.lit(True)), "content_id", "left")
    hit, member = F.coalesce("found", F.lit(False)), F.coalesce("member", F.lit(False))
    others = F.count_if(~member)
    return rows.agg(F.count_if(member).alias("members"), F.count_if(member & ~hit).alias("missed"), others.alias("others"), (F.count_if(hit & ~member) <= others * 0.02 + 3).alias("within_rate"))


def _bloom_rates(spark, d):
    m, k = index.bloom_size(1000, 0.01)
    n = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 100).alias("n"))
    return n.select("n", F.round(index.bloom_rate(F.col("n"), m, k), 9).alias("rate"), F.lit(m).alias("m"), F.lit(k).alias("k"))


def _windows(spark, d):
    return manifests.windows(chunks(spark, d, 128))


WINDOWS_SQL = (
    "WITH "
    + chunks_sql(128)
    + """,
n AS (SELECT file_id, count(*)::INT AS n FROM ch GROUP BY 1),
f AS (SELECT file_id, n, f FROM (SELECT file_id, n, unnest(range(0, n)) AS f FROM n) WHERE (f % 60 = 0 AND f <= 60 * (CASE WHEN n >= 64 THEN (n - 64) // 60 + 1 ELSE 0 END)) OR f >= n - 4),
w AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY f) - 1)::INT AS window_id, f::INT AS first_chunk, least(64, n - f)::INT AS count FROM f),
r AS (SELECT w.file_id, window_id, first_chunk, w.count, sha256(string_agg(content_id, '' ORDER BY chunk_index)) AS merkle_root FROM w JOIN ch ON ch.file_id = w.file_id AND ch.chunk_index BETWEEN first_chunk AND first_chunk + w.count - 1 GROUP BY ALL)
"""
)


def _cargo(spark, d):
    c = chunks(spark, d, 128)
    held = manifests.cargo(files(spark, d), c, manifests.windows(c))
    return held.select("file_id", "path", "chunks", "size", F.size("windows").alias("windows"), F.get("windows", F.lit(0))["merkle_root"].alias("first_root"), F.aggregate("windows", F.lit(0), lambda a, w: a + w["count"]).alias("window_chunks"))


def _violations(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    chunking_ = F.struct(F.when(k % 5 == 0, "fixed").when(k % 7 == 0, "other").otherwise("cdc").alias("type"), F.when(k % 3 != 0, 64).alias("avg_kib"), F.when(k % 4 != 0, "gear").alias("algo"), F.when(k % 2 == 0, 16).alias("fixed_kib"))
    window = lambda i: F.struct((F.lit(i) + F.when(k % 11 == 0, 1).otherwise(0)).alias("id"), F.when(k % 13 == 0, 0).otherwise(4).alias("count"), F.lit(0).alias("first_chunk"), F.when(k % 17 == 0, "").otherwise(F.sha2(k.cast("string"), 256)).alias("merkle_root"))
    rows = part.select(k.alias("id"), F.when(k % 19 == 0, "2").otherwise("1").alias("schema"), F.when(k % 23 == 0, "").otherwise(F.col("p_name")).alias("path"), chunking_.alias("chunking"), F.array(window(0), window(1)).alias("windows"))
    return rows


def _cargo_violations(spark, d):
    rows = manifests.violations(_violations(spark, d))
    return rows.select("id", F.array_join("violations", "|").alias("violations"))


def _strict_violations(spark, d):
    return manifests.strict_violations(_violations(spark, d)).select("id", F.array_join("violations", "|").alias("violations"))


def _map_violations(spark, d):
    c = chunks(spark, d, 128)
    spans = manifests.windows(c).withColumn("window_id", F.col("window_id") + F.when(F.col("file_id") % 50 == 0, 1).otherwise(0))
    counts = c.groupBy("file_id").agg((F.count("*") - F.when(F.col("file_id") % 30 == 0, 2).otherwise(0)).alias("n"))
    return manifests.map_violations(spans, counts)


def _resume(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("long")
    copied = F.when(k % 10 == 0, 0).when(k % 3 == 0, total).otherwise(F.floor(total / 2).cast("long"))
    dest = F.when(k % 7 == 0, F.lit(None).cast("long")).when(k % 4 == 0, total).when(k % 9 == 1, copied - 5).when(k % 9 == 2, copied + 9).otherwise(copied)
    decision = manifests.resume_decision(copied, F.when(k % 5 != 0, total), F.lit(100), dest, F.when(k % 6 == 0, 103).otherwise(102))
    return o.select("o_orderkey", decision.alias("decision"))


def _ranges(spark, d):
    f = files(spark, d)
    c = chunking.fixed_chunks(f, 512)
    digests = c.select("file_id", F.col("chunk_index").cast("int").alias("chunk"), F.when(F.col("file_id") % 10 == 0, "bad").otherwise(F.col("content_id")).alias("digest"))
    return manifests.validate_ranges(f.select("file_id", "content"), digests.unionByName(digests.select("file_id", (F.col("chunk") + 100_000).alias("chunk"), "digest")), 512)


def _diff(spark, d):
    from .files import dest_files, source_files

    return manifests.diff(dest_files(spark, d), source_files(spark, d))


def _verify(spark, d):
    bad = manifests.violations(_violations(spark, d)).withColumn("id", F.when(F.col("id") % 29 == 0, -F.col("id")).otherwise(F.col("id")))  # some belong to other files
    return manifests.verify_summary(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id")), bad, "id")


def _upsert(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 100).alias("dest_path"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 100_000 + F.col("o_orderkey") % 100_000).alias("transferred_at"), "o_orderkey")
    return manifests.upsert(rows)


#: What a manifest's time differs by: forward and back, with fractions on both sides of a whole second.
PARTIAL_STEPS = (1.5, -1.5, 0.5, -0.5, 2.0, -2.25, -1.0)


def _partial(spark, d):
    from .files import dest_files, source_files

    step = F.element_at(F.array(*map(F.lit, PARTIAL_STEPS)), (F.col("n") % len(PARTIAL_STEPS) + 1).cast("int"))
    m = source_files(spark, d).select("path", F.when(F.col("n") % 4 == 0, 2).otherwise(1).alias("version"), "size", (F.col("modified") + step).alias("modified"))
    return manifests.partial_valid(m, dest_files(spark, d).select("path", "size", F.col("modified").cast("double").alias("modified")))


def _journal(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.element_at(F.array(*map(F.lit, ("create_file", "write_chunk", "copy_chunk", "delete_file", "set_metadata"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("ordinal"), F.concat(F.lit("p"), (F.col("user_id") % 97).cast("string")).alias("path"), op.alias("op"), (F.col("event_id") % 1000).alias("length"), F.md5((F.col("event_id") % 3).cast("string")).alias("hash"), F.md5((F.col("event_id") % 2).cast("string")).alias("dest_hash"))


def _replay(spark, d):
    existing = _journal(spark, d).select("path").distinct().withColumn("path", F.when(F.col("path") < "p5", F.col("path")).otherwise(F.concat(F.lit("old/"), "path")))
    return manifests.replay_counts(_journal(spark, d), existing)


JOURNAL_SQL = """j AS (SELECT event_id AS ordinal, 'p' || (user_id % 97)::VARCHAR AS path, (['create_file','write_chunk','copy_chunk','delete_file','set_metadata'])[(event_id % 5 + 1)::INT] AS op,
 event_id % 1000 AS length, md5((event_id % 3)::VARCHAR) AS hash, md5((event_id % 2)::VARCHAR) AS dest_hash FROM events)"""


def _pairs(spark, d):
    """Neighbouring documents, and documents with an insertion, as delta pairs."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.col("text")
    changed = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(text, 1, 300), F.lit("<inserted>"), F.substring(text, F.lit(301), F.length(text)))).otherwise(F.lit("other"))
    return docs.select(F.col("doc_id").alias("pair_id"), F.encode(changed, "UTF-8").alias("source"), F.encode(text, "UTF-8").alias("dest"))


def _lookup(spark, d):
    p = _pairs(spark, d)
    probes = delta.signatures(p.select(F.col("pair_id").alias("file_id"), F.col("source").alias("content")), 128).select("file_id", "offset", "weak", "strong")
    return delta.lookup(probes, delta.signatures(files(spark, d), 128)).select("file_id", "offset", "strong", "match_offset")


def _delta_stats(spark, d):
    p = _pairs(spark, d)
    return delta.delta_stats(p, delta.deltas(p, 64), 64)


def _delta_round_trip(spark, d):
    p = _pairs(spark, d)
    back = delta.rebuilt(p, delta.deltas(p, 64))
    return p.join(back, "pair_id", "left").select("pair_id", (F.coalesce("content", F.lit(b"")) == F.col("source")).alias("same"))


def _packing(spark, d):
    pool = F.concat(F.lit("pool"), F.floor(F.col("file_id") / 64).cast("string"))
    rows = chunks(spark, d, 1024).select(pool.alias("pool"), (F.col("file_id") * 1_000_000 + F.col("chunk_index")).alias("ordinal"), "length")
    return containers.pack_containers(rows, 4096)


QUERIES = {
    "a1_dedup_stats": lambda s, d: dedup.dedup_stats(chunks(s, d)),
    "a1_dedup_stats_large": lambda s, d: dedup.dedup_stats(lineitem_index(s, d)),
    "a2_a3_bulk_stats": lambda s, d: index.bulk_stats(lineitem_index(s, d)),
    "a3_index_counts": lambda s, d: index.index_counts(lineitem_index(s, d).select("content_id", "star_id", "file_id")),
    "c1_content_chunks": lambda s, d: chunking.content_chunks(files(s, d), SMALL),
    "c3_fixed_chunks": lambda s, d: chunks(s, d, 512),
    "c4_sparse_stats": lambda s, d: chunking.sparse_stats(
        s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.concat(F.encode("text", "UTF-8"), F.unhex(F.repeat(F.lit("00"), ((F.col("doc_id") % 5) * 256).cast("int")))).alias("content")), 256, "auto", 1024
    ),
    "c7_containers": _packing,
    "c8_size_distribution": lambda s, d: chunking.size_distribution(chunks(s, d)),
    "c8_u4_preservation": lambda s, d: index.preservation(
        chunks(s, d, 256), chunking.fixed_chunks(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.encode(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("x"), F.col("text"))), "UTF-8").alias("content")), 256)
    ),
    "x3_adler32": lambda s, d: files(s, d).select("file_id", adler32("content").alias("adler32")),
    "j5_link_overlap": _link_overlap,
    "j7_signature_lookup": _lookup,
    "j8_has_chunk": lambda s, d: index.with_chunk(lineitem_index(s, d), _parts(s, d, "p_size < 5")).select("file_id", "chunk_index", "content_id"),
    "j8_missing_chunk": lambda s, d: index.without_chunk(lineitem_index(s, d), _parts(s, d, "p_size < 45")).select("file_id", "chunk_index", "content_id"),
    "j9_claims": _claims,
    "j10_files_with_chunk": lambda s, d: index.files_with_chunk(lineitem_index(s, d)).groupBy("content_id").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file")),
    "j10_chunks_of_file": lambda s, d: index.chunks_of_file(lineitem_index(s, d)),
    "u1_merged_universe": _universe,
    "u2_insert_set": lambda s, d: index.insert_set(lineitem_index(s, d).select("content_id", "star_id"), lineitem_index(s, d).select("content_id", (F.col("star_id") + F.col("file_id") % 2).alias("star_id"))),
    "r1_bloom": _bloom,
    "r1_bloom_rate": _bloom_rates,
    "r2_rank_select": lambda s, d: index.bitmap_ranks(_bits(s, d)),
    "r2_rank_directory": lambda s, d: index.ranks_at(_bits(s, d).select("window_id", (F.col("pos") + F.col("window_id") % 3).alias("pos")), index.rank_directory(_bits(s, d))),
    "r3_a12_window_progress": lambda s, d: index.window_progress(_bits(s, d)),
    "p2_p3_windows": _windows,
    "p1_cargo": _cargo,
    "a13_total_chunks": lambda s, d: _windows(s, d).groupBy("file_id").agg(F.sum("count").alias("total_chunks")),
    "j12_windows_of_chunks": lambda s, d: manifests.window_of_chunks(chunks(s, d, 128), _windows(s, d)),
    "p4_cargo_violations": _cargo_violations,
    "p5_strict_violations": _strict_violations,
    "p6_map_violations": _map_violations,
    "p7_manifest_diff": _diff,
    "p8_resume_decision": _resume,
    "p9_validate_ranges": _ranges,
    "a21_verify_summary": _verify,
    "s16_upsert": _upsert,
    "d6_partial_valid": _partial,
    "a11_journal_stats": lambda s, d: manifests.journal_stats(_journal(s, d)),
    "p10_replay": _replay,
    "d1_signatures": lambda s, d: delta.signatures(files(s, d), 512).select("file_id", "offset", "length", "strong"),
    "d1_rotating": lambda s, d: delta.signatures(files(s, d), 512, weak="rotating").select("file_id", "offset", "length", "weak", "strong"),
    "d2_delta": lambda s, d: delta.deltas(_pairs(s, d), 64).drop("bytes"),
    "d4_delta_stats": _delta_stats,
    "a7_merged_delta_stats": lambda s, d: delta.merged_stats(_delta_stats(s, d)),
    "d5_round_trip": _delta_round_trip,
    "d7_block_overlap": lambda s, d: delta.block_overlap(_pairs(s, d), 64),
}

_STATS = """g AS (SELECT content_id, count(*) AS n FROM {t} GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS unique_chunks, sum(n)::BIGINT AS total_references, (count(*) FILTER (n > 1))::BIGINT AS deduplicated_chunks, max(n)::BIGINT AS max_references FROM g)
SELECT *, round((total_references - unique_chunks) / total_references::DOUBLE, 9) AS dedup_ratio, round((total_references - unique_chunks) / total_references::DOUBLE * 100, 6) AS space_savings_pct FROM s"""

_VIOLATION_ROWS = """v AS (SELECT p_partkey AS k, p_name FROM part), x AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'fixed' WHEN k % 7 = 0 THEN 'other' ELSE 'cdc' END AS t, p_name FROM v)"""

ORACLES = {
    "a1_dedup_stats": f"WITH {chunks_sql(1024)}, " + _STATS.format(t="ch"),
    "a1_dedup_stats_large": f"WITH {LINE_SQL}, " + _STATS.format(t="loc"),
    "a2_a3_bulk_stats": f"WITH {LINE_SQL}, g AS (SELECT content_id, count(*) AS n FROM loc GROUP BY 1) SELECT count(*)::BIGINT AS chunks, sum(n)::BIGINT AS locations, sum(n - 1)::BIGINT AS deduped, max(n)::BIGINT AS max_locations, round(avg(n), 9) AS avg_locations FROM g",
    "a3_index_counts": f"WITH {LINE_SQL} SELECT count(DISTINCT content_id)::BIGINT AS distinct_hashes, count(*)::BIGINT AS total_entries FROM (SELECT DISTINCT content_id, star_id, file_id FROM loc)",
    "c3_fixed_chunks": f"WITH {chunks_sql(512)} SELECT * FROM ch",
    "c4_sparse_stats": """WITH f AS (SELECT doc_id AS file_id, octet_length(encode(text)) AS n, doc_id % 5 * 256 AS z, octet_length(encode(text)) + doc_id % 5 * 256 AS size FROM documents),
c AS (SELECT *, CASE WHEN size >= 1024 THEN greatest(0, (size + 255) // 256 - (n + 255) // 256) ELSE 0 END AS holes FROM f),
b AS (SELECT *, CASE WHEN holes > 0 THEN size - (n + 255) // 256 * 256 ELSE 0 END AS saved FROM c)
SELECT file_id, size::BIGINT AS size, holes::BIGINT AS holes, saved::BIGINT AS bytes_saved, (size - saved)::BIGINT AS physical, CASE WHEN size > 0 THEN round((size - saved) / size::DOUBLE, 9) ELSE 1.0 END AS density FROM b""",
    "c7_containers": f"""WITH RECURSIVE {chunks_sql(1024)}, r AS (SELECT file_id // 64 AS p, file_id * 1000000 + chunk_index AS ordinal, length, row_number() OVER (PARTITION BY file_id // 64 ORDER BY file_id, chunk_index) AS k FROM ch),
w AS (SELECT DISTINCT p, 0::BIGINT AS k, 0::BIGINT AS num, 16::BIGINT AS fill, 0::BIGINT AS ordinal, 0::BIGINT AS off, 0::BIGINT AS length FROM r
 UNION ALL SELECT p, k, num, CASE WHEN base + length > 4096 THEN base ELSE base + length END, ordinal, CASE WHEN base + length > 4096 THEN -1 ELSE base END, length FROM
  (SELECT r.p, r.k, r.ordinal, r.length, num + CASE WHEN fill + r.length > 4096 THEN 1 ELSE 0 END AS num, CASE WHEN fill + r.length > 4096 THEN 16 ELSE fill END AS base FROM w JOIN r ON r.p = w.p AND r.k = w.k + 1))
SELECT 'pool' || p::VARCHAR AS pool, ordinal, 'container_' || lpad(num::VARCHAR, 6, '0') AS container_id, off AS "offset", length, CASE WHEN off < 0 THEN 'too large' END AS error FROM w WHERE k > 0""",
    "x3_adler32": """WITH f AS (SELECT doc_id, encode(text) AS e, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, n, i, ('0x' || hex(e[i + 1:i + 1]))::INT AS v FROM (SELECT *, unnest(range(0, n)) AS i FROM f)),
s AS (SELECT doc_id, sum(v) AS plain, sum((n - i) * v) AS weighted FROM b GROUP BY 1)
SELECT f.doc_id AS file_id, ((n + coalesce(weighted, 0)) % 65521 * 65536 + (1 + coalesce(plain, 0)) % 65521)::BIGINT AS adler32 FROM f LEFT JOIN s ON f.doc_id = s.doc_id""",
    "c8_size_distribution": f"WITH {chunks_sql(1024)} SELECT count(*) AS chunks, min(length)::BIGINT AS min_length, max(length)::BIGINT AS max_length, round(avg(length), 6) AS avg_length FROM ch",
    "c8_u4_preservation": f"""WITH {chunks_sql(256)}, t AS (SELECT CASE WHEN doc_id % 2 = 0 THEN text ELSE 'x' || text END AS text FROM documents),
a AS (SELECT DISTINCT sha256(encode(text)[off + 1:off + 256]) AS cid FROM (SELECT text, unnest(range(0, octet_length(encode(text)), 256)) AS off FROM t)), o AS (SELECT DISTINCT content_id AS cid FROM ch)
SELECT count(*) AS originals, count(a.cid) AS preserved, round(count(a.cid) / count(*)::DOUBLE, 9) AS rate FROM o LEFT JOIN a ON o.cid = a.cid""",
    "j5_link_overlap": LINK_SQL,
    "j7_signature_lookup": """WITH t AS (SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text[1:300] || '<inserted>' || text[301:] ELSE 'other' END AS a, text AS b FROM documents),
s AS (SELECT file_id, off AS "offset", sha256(encode(a)[off + 1:off + 128]) AS strong FROM (SELECT file_id, a, unnest(range(0, octet_length(encode(a)), 128)) AS off FROM t)),
m AS (SELECT sha256(encode(b)[off + 1:off + 128]) AS strong, min(off) AS o FROM (SELECT b, unnest(range(0, octet_length(encode(b)), 128)) AS off FROM t) GROUP BY 1)
SELECT s.file_id, s."offset", s.strong, m.o AS match_offset FROM s LEFT JOIN m ON s.strong = m.strong""",
    "j8_has_chunk": f"WITH {LINE_SQL} SELECT file_id, chunk_index, content_id FROM loc WHERE content_id IN (SELECT p_partkey FROM part WHERE p_size < 5)",
    "j8_missing_chunk": f"WITH {LINE_SQL} SELECT file_id, chunk_index, content_id FROM loc WHERE content_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)",
    "j9_claims": f"WITH {LINE_SQL} SELECT content_id, file_id * 10 + chunk_index AS arrival, file_id * 10 + chunk_index = min(file_id * 10 + chunk_index) OVER (PARTITION BY content_id) AND content_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AS claimed FROM loc",
    "j10_files_with_chunk": f"WITH {LINE_SQL} SELECT content_id, count(DISTINCT file_id) AS files, min(file_id) AS first_file FROM loc GROUP BY 1",
    "j10_chunks_of_file": f"WITH {LINE_SQL} SELECT file_id, count(DISTINCT content_id) AS chunks FROM loc GROUP BY 1",
    "u1_merged_universe": """WITH m AS (SELECT l_suppkey % 5 AS map_id, 'f' || l_orderkey::VARCHAR AS path FROM lineitem), f AS (SELECT path, min(map_id) AS fm, count(*) AS locations FROM m GROUP BY 1)
SELECT path, row_number() OVER (ORDER BY fm, path) AS file_id, locations FROM f""",
    "u2_insert_set": f"WITH {LINE_SQL} SELECT content_id, star_id FROM loc UNION SELECT content_id, star_id + file_id % 2 FROM loc",
    "r1_bloom": f"WITH {LINE_SQL}, p AS (SELECT content_id, content_id IN (SELECT p_partkey FROM part WHERE p_size <= 25) AS member FROM (SELECT DISTINCT content_id FROM loc)) SELECT count(*) FILTER (member) AS members, 0::BIGINT AS missed, count(*) FILTER (NOT member) AS others, true AS within_rate FROM p",
    "r1_bloom_rate": "WITH p AS (SELECT ceil(-1000 * ln(0.01) / ln(2) ** 2)::INT AS m), q AS (SELECT m, greatest(1, ceil(m / 1000.0::DOUBLE * ln(2)))::INT AS k FROM p) SELECT n_nationkey * 100 AS n, round((1 - exp(-k * n_nationkey * 100 / m::DOUBLE)) ** k, 9) AS rate, m, k FROM nation, q",
    "r2_rank_select": f"WITH {BITS_SQL}, r AS (SELECT *, coalesce(sum(bit::INT) OVER (PARTITION BY window_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM bits) SELECT window_id, pos, bit, rank, CASE WHEN bit THEN rank END AS select_index FROM r",
    "r2_rank_directory": f"""WITH {BITS_SQL}, one AS (SELECT window_id, pos, row_number() OVER (PARTITION BY window_id ORDER BY pos) AS k FROM bits WHERE bit), p AS (SELECT window_id, pos + window_id % 3 AS pos FROM bits)
SELECT p.window_id, p.pos, coalesce(one.k, 0) - coalesce((one.pos = p.pos)::INT, 0) AS rank, coalesce(one.pos = p.pos, false) AS "set" FROM p ASOF LEFT JOIN one ON one.window_id = p.window_id AND one.pos <= p.pos""",
    "r3_a12_window_progress": f"WITH {BITS_SQL} SELECT window_id, count(*) AS total, count(*) FILTER (bit) AS completed, count(*) FILTER (NOT bit) AS missing, min(pos) FILTER (NOT bit) AS next_missing, round((count(*) FILTER (bit)) / count(*)::DOUBLE * 100.0, 6) AS percent FROM bits GROUP BY 1",
    "p2_p3_windows": WINDOWS_SQL + "SELECT * FROM r",
    "p1_cargo": WINDOWS_SQL + """, t AS (SELECT file_id, count(*) AS chunks, sum(length)::BIGINT AS size FROM ch GROUP BY 1)
SELECT t.file_id, source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path, chunks, size, count(*)::INT AS windows, min(merkle_root) FILTER (window_id = 0) AS first_root, sum(r.count)::INT AS window_chunks
FROM t JOIN r ON t.file_id = r.file_id JOIN documents ON doc_id = t.file_id GROUP BY ALL""",
    "a13_total_chunks": WINDOWS_SQL + 'SELECT file_id, sum("count")::BIGINT AS total_chunks FROM w GROUP BY 1',
    "j12_windows_of_chunks": WINDOWS_SQL + 'SELECT ch.file_id, chunk_index, window_id FROM ch JOIN w ON ch.file_id = w.file_id AND chunk_index BETWEEN first_chunk AND first_chunk + w."count" - 1',
    "p4_cargo_violations": f"""WITH {_VIOLATION_ROWS} SELECT k AS id, concat_ws('|', CASE WHEN k % 19 = 0 THEN 'schema version' END, CASE WHEN k % 23 = 0 THEN 'path is empty' END, CASE WHEN t = 'other' THEN 'chunking type' END,
 CASE WHEN t = 'cdc' AND k % 3 = 0 THEN 'cdc needs avg_kib' END, CASE WHEN t = 'cdc' AND k % 4 = 0 THEN 'cdc needs algo' END, CASE WHEN t = 'fixed' AND k % 2 != 0 THEN 'fixed needs fixed_kib' END,
 CASE WHEN k % 11 = 0 THEN 'window 0: id' END, CASE WHEN k % 13 = 0 THEN 'window 0: no chunks' END, CASE WHEN k % 17 = 0 THEN 'window 0: no root' END,
 CASE WHEN k % 11 = 0 THEN 'window 1: id' END, CASE WHEN k % 13 = 0 THEN 'window 1: no chunks' END, CASE WHEN k % 17 = 0 THEN 'window 1: no root' END) AS violations FROM x""",
    "p5_strict_violations": f"WITH {_VIOLATION_ROWS} SELECT k AS id, concat_ws('|', CASE WHEN k % 17 = 0 THEN 'digest' END, CASE WHEN k % 13 = 0 THEN 'count' END) AS violations FROM x",
    "p6_map_violations": WINDOWS_SQL + """SELECT w.file_id, (w.window_id + CASE WHEN w.file_id % 50 = 0 THEN 1 ELSE 0 END)::INT AS window_id, CASE WHEN w.file_id % 50 = 0 THEN 'sequence' ELSE 'range' END AS violation
FROM w JOIN n ON w.file_id = n.file_id WHERE w.file_id % 50 = 0 OR first_chunk >= n - CASE WHEN w.file_id % 30 = 0 THEN 2 ELSE 0 END""",
    "p8_resume_decision": """WITH a AS (SELECT o_orderkey AS k, trunc(o_totalprice)::BIGINT AS total FROM orders), b AS (SELECT *, CASE WHEN k % 10 = 0 THEN 0 WHEN k % 3 = 0 THEN total ELSE total // 2 END AS copied FROM a),
c AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN total WHEN k % 9 = 1 THEN copied - 5 WHEN k % 9 = 2 THEN copied + 9 ELSE copied END AS dest FROM b)
SELECT k AS o_orderkey, CASE WHEN copied = 0 THEN 'start_fresh' WHEN dest IS NULL THEN 'restart' WHEN k % 5 != 0 AND dest != total AND dest != copied THEN 'restart' WHEN k % 6 = 0 THEN 'revalidate' WHEN dest < copied THEN 'restart' WHEN dest > copied THEN 'revalidate' ELSE 'resume' END AS decision FROM c""",
    "p9_validate_ranges": f"WITH {chunks_sql(512)} SELECT file_id, count(*) AS checked, count(*) FILTER (file_id % 10 = 0) AS failed FROM ch GROUP BY 1",
    "a21_verify_summary": f"""WITH {_VIOLATION_ROWS}, b AS (SELECT k, k % 29 != 0 AND NOT (k % 19 = 0 OR k % 23 = 0 OR t = 'other' OR (t = 'cdc' AND (k % 3 = 0 OR k % 4 = 0)) OR (t = 'fixed' AND k % 2 != 0) OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0) AS good FROM x)
SELECT count(*) FILTER (good) AS verified, count(*) FILTER (NOT good) AS failed FROM b""",
    "s16_upsert": """SELECT dest_path, transferred_at, o_orderkey FROM (SELECT o_custkey % 100 AS dest_path, epoch(o_orderdate)::BIGINT * 100000 + o_orderkey % 100000 AS transferred_at, o_orderkey FROM orders)
QUALIFY row_number() OVER (PARTITION BY dest_path ORDER BY transferred_at DESC) = 1""",
    "a11_journal_stats": f"WITH {JOURNAL_SQL} SELECT count(*) AS operations, sum(CASE WHEN op IN ('create_file', 'write_chunk', 'copy_chunk') THEN length ELSE 0 END)::BIGINT AS total_bytes, sum(CASE WHEN op IN ('create_file', 'write_chunk') THEN length ELSE 0 END)::BIGINT AS data_bytes FROM j",
    "p10_replay": f"""WITH {JOURNAL_SQL}, e AS (SELECT ordinal, path, op, hash, dest_hash FROM j UNION ALL SELECT DISTINCT -1, CASE WHEN path < 'p5' THEN path ELSE 'old/' || path END, 'existing', NULL, NULL FROM j),
l AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('existing', 'create_file', 'write_chunk') THEN true WHEN op = 'delete_file' THEN false END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS alive FROM e)
SELECT count(*) FILTER (op = 'create_file') AS created, count(*) FILTER (op = 'write_chunk') AS written, count(*) FILTER (op = 'copy_chunk' AND alive AND hash = dest_hash) AS copied,
 count(*) FILTER (op = 'copy_chunk' AND NOT (alive AND hash = dest_hash)) AS copy_failed, count(*) FILTER (op = 'delete_file' AND alive) AS deleted, count(*) FILTER (op = 'set_metadata') AS metadata FROM l""",
    "d1_signatures": f'WITH {chunks_sql(512)} SELECT file_id, "offset", length, content_id AS strong FROM ch',
    "d5_round_trip": "SELECT doc_id AS pair_id, true AS same FROM documents",
    "d7_block_overlap": """WITH t AS (SELECT doc_id AS pair_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text[1:300] || '<inserted>' || text[301:] ELSE 'other' END AS a, text AS b FROM documents),
x AS (SELECT pair_id, encode(a)[off + 1:off + 64] AS p FROM (SELECT pair_id, a, unnest(range(0, octet_length(encode(a)), 64)) AS off FROM t)), y AS (SELECT DISTINCT pair_id, encode(b)[off + 1:off + 64] AS p FROM (SELECT pair_id, b, unnest(range(0, octet_length(encode(b)), 64)) AS off FROM t))
SELECT x.pair_id, count(*) AS blocks, count(y.p) AS shared FROM x LEFT JOIN y ON x.pair_id = y.pair_id AND x.p = y.p GROUP BY 1""",
}

from .files import FILES_SQL  # noqa: E402  shared listing

ORACLES["p7_manifest_diff"] = f"WITH {FILES_SQL} SELECT coalesce(d.path, s.path) AS path, CASE WHEN d.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' WHEN d.digest != s.digest THEN 'changed' ELSE 'same' END AS change FROM dst d FULL JOIN src s ON d.path = s.path"
ORACLES["d6_partial_valid"] = f"""WITH {FILES_SQL} SELECT s.path, n % 4 != 0 AND s.size = d.size AND floor(abs(s.modified + ({list(PARTIAL_STEPS)})[(n % {len(PARTIAL_STEPS)} + 1)::INT] - d.modified)) <= 1 AS valid FROM src s JOIN dst d ON s.path = d.path"""


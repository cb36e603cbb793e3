"""Queries over large files, and SQL for walks that depend on their own earlier choices.

The large files are archives: 512 documents each, one after the other, given in
pieces of a document. The SQL lists all places where a walk could stop, points
each to the next, and follows the pointers by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blake3
from ..operators import chunking, delta, spans

ARCHIVE = 512
LARGE_BLOCK = 64 * 1024


def archives(spark: SparkSession, d: str, text: Column | None = None) -> DataFrame:
    """(file_id, offset, data): the documents' bytes, ``ARCHIVE`` of them a file."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.floor(F.col("doc_id") / ARCHIVE).alias("file_id"), "doc_id", F.encode(F.coalesce(F.col("text") if text is None else text, F.lit("")), "UTF-8").alias("data"))
    before = W.partitionBy("file_id").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)  # an archive's documents
    return rows.select("file_id", F.coalesce(F.sum(F.length("data")).over(before), F.lit(0)).cast("long").alias("offset"), "data")


def _large_delta(spark, d):
    """Archives with texts put in, against archives with other texts put in."""
    changed = lambda every, k, s: F.when(F.col("doc_id") % every == k, F.concat(F.lit(s), F.col("text"))).otherwise(F.col("text"))
    return delta.large_deltas(archives(spark, d, changed(389, 3, "<new>")), archives(spark, d, changed(397, 5, "x")), LARGE_BLOCK)


QUERIES = {
    "x2_blake3": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", blake3.blake3(F.encode("text", "UTF-8")).alias("blake3")),
    "x2_blake3_large": lambda s, d: blake3.large_hashes(spans.spans_of(archives(s, d), blake3.SPAN, 0, "file_id"), "file_id"),
    "c1_large_chunks": lambda s, d: chunking.large_content_chunks(archives(s, d)),
    "d3_large_delta": _large_delta,
}

# Bytes of files: byt(k, i, v), and whole contents: tot(k, n, x).
_DOC_BYTES = """doc AS (SELECT doc_id AS k, encode(text) AS x FROM documents), tot AS (SELECT k, octet_length(x) AS n, x FROM doc WHERE octet_length(x) > 0),
byt AS MATERIALIZED (SELECT k, i, ('0x' || hex(x[i + 1:i + 1]))::INT AS v FROM (SELECT k, x, unnest(range(0, octet_length(x))) AS i FROM doc))"""


def _archive_bytes(name: str, text: str = "coalesce(text, '')") -> str:
    return f"""{name}doc AS (SELECT doc_id // {ARCHIVE} AS k, doc_id, encode({text}) AS x, {text} AS t FROM documents),
{name}tot AS MATERIALIZED (SELECT k, sum(octet_length(x))::BIGINT AS n, encode(string_agg(t, '' ORDER BY doc_id)) AS x FROM {name}doc GROUP BY k),
{name}byt AS MATERIALIZED (SELECT k, o + j AS i, ('0x' || hex(x[j + 1:j + 1]))::INT AS v FROM (SELECT k, o, x, unnest(range(0, octet_length(x))) AS j
 FROM (SELECT k, x, coalesce(sum(octet_length(x)) OVER (PARTITION BY k ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM {name}doc)))"""


def _cuts(config: chunking.ChunkConfig) -> str:
    bits = config.mask.bit_length()
    tested = " + ".join(f"{1 << j} * coalesce(lag(g, {j}) OVER w, 0)" for j in range(bits))
    return f"""gear AS (SELECT i, ('0x' || h[1:2])::INT + (('0x' || h[3:4])::INT & 15) * 256 AS g FROM (SELECT i, sha256('gear:' || i::VARCHAR) AS h FROM range(256) r(i))),
cand AS MATERIALIZED (SELECT k, i + 1 AS e FROM (SELECT k, byt.i, ({tested}) & {config.mask} AS h FROM byt JOIN gear ON gear.i = v WINDOW w AS (PARTITION BY k ORDER BY byt.i)) WHERE h < {chunking.CUT_BELOW}),
nx AS MATERIALIZED (SELECT p.k, p.i AS s, CASE WHEN n - p.i < {config.most} THEN n ELSE least(coalesce(c.e, n), p.i + {config.most}) END AS e
 FROM (SELECT byt.k, byt.i, byt.i + {config.least} AS f, n FROM byt JOIN tot ON tot.k = byt.k) p ASOF LEFT JOIN cand c ON p.k = c.k AND p.f <= c.e),
walk AS (SELECT k, s, e, 0 AS idx FROM nx WHERE s = 0 UNION ALL SELECT nx.k, nx.s, nx.e, idx + 1 FROM walk JOIN nx ON nx.k = walk.k AND nx.s = walk.e)
SELECT walk.k AS file_id, idx::BIGINT AS chunk_index, s AS "offset", e - s AS length, sha256(x[s + 1:e]) AS content_id, NOT regexp_matches(hex(x[s + 1:e]), '[1-9A-F]') AS is_zero FROM walk JOIN tot ON tot.k = walk.k"""


def _follow(block: int) -> str:
    """From m(k, s, o), windows at s with the block at o: the walk that takes the first match first."""
    return f"""nx AS MATERIALIZED (SELECT m.k, m.s, m.o, c.s AS e FROM (SELECT *, s + {block} AS f FROM m) m ASOF LEFT JOIN m c ON m.k = c.k AND m.f <= c.s),
walk AS (SELECT nx.k, nx.s, nx.o, nx.e FROM nx JOIN (SELECT k, min(s) AS s FROM m GROUP BY k) f ON f.k = nx.k AND f.s = nx.s UNION ALL SELECT nx.k, nx.s, nx.o, nx.e FROM walk JOIN nx ON nx.k = walk.k AND nx.s = walk.e)"""


_PAIRS = "p AS (SELECT doc_id AS k, encode(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text[1:300] || '<inserted>' || text[301:] ELSE 'other' END) AS a, encode(text) AS b FROM documents)"
DELTA_SQL = f"""WITH RECURSIVE {_PAIRS},
win AS (SELECT k, i AS s, a[i + 1:i + 64] AS w FROM (SELECT k, a, unnest(range(0, octet_length(a) - 63)) AS i FROM p)),
blk AS (SELECT k, b[o + 1:o + 64] AS w, min(o) AS o FROM (SELECT k, b, unnest(range(0, octet_length(b) - 63, 64)) AS o FROM p) GROUP BY ALL),
m AS MATERIALIZED (SELECT win.k, win.s, blk.o FROM win JOIN blk ON blk.k = win.k AND blk.w = win.w),
{_follow(64)},
fin AS (SELECT p.k, octet_length(a) AS n, coalesce(d.pending, 0) AS pending, octet_length(b) % 64 AS r, octet_length(b) AS bn, a, b FROM p LEFT JOIN (SELECT k, max(s) + 64 AS pending FROM walk GROUP BY k) d ON d.k = p.k),
en AS (SELECT k, n, pending, bn - r AS o, CASE WHEN r > 0 AND n - r >= pending AND a[n - r + 1:] = b[bn - r + 1:] THEN n - r END AS tail FROM fin WHERE n > 0),
st AS (SELECT k, 'copy' AS op, s AS src_offset, o AS dest_offset, 64 AS length FROM walk
 UNION ALL SELECT k, 'data', b, b, s - b FROM (SELECT k, s, coalesce(lag(s + 64) OVER (PARTITION BY k ORDER BY s), 0) AS b FROM walk) WHERE s > b
 UNION ALL SELECT k, 'data', pending, pending, coalesce(tail, n) - pending FROM en WHERE coalesce(tail, n) > pending
 UNION ALL SELECT k, 'copy', tail, o, n - tail FROM en WHERE tail IS NOT NULL)"""

_SUMS = """sums AS (SELECT k, count(*) FILTER (op = 'copy') AS matched_blocks, coalesce(sum(length) FILTER (op = 'copy'), 0)::BIGINT AS bytes_saved, coalesce(sum(length) FILTER (op = 'data'), 0)::BIGINT AS bytes_transferred FROM st GROUP BY k),
ds AS (SELECT p.k AS pair_id, octet_length(a)::BIGINT AS size, ceil(octet_length(a) / 64.0)::BIGINT AS total_blocks, coalesce(matched_blocks, 0) AS matched_blocks, greatest(ceil(octet_length(a) / 64.0)::BIGINT - coalesce(matched_blocks, 0), 0)::BIGINT AS transferred_blocks,
 coalesce(bytes_saved, 0)::BIGINT AS bytes_saved, coalesce(bytes_transferred, 0)::BIGINT AS bytes_transferred, CASE WHEN octet_length(a) > 0 THEN round(coalesce(bytes_saved, 0) / octet_length(a)::DOUBLE, 9) ELSE 0.0 END AS savings_ratio FROM p LEFT JOIN sums ON sums.k = p.k)"""

#: Windows and blocks by their plain and their weighted sum of bytes; what the walk copies is compared byte by byte.
_LARGE_DELTA = f"""WITH RECURSIVE {_archive_bytes("a", "CASE WHEN doc_id % 389 = 3 THEN '<new>' || text ELSE coalesce(text, '') END")}, {_archive_bytes("b", "CASE WHEN doc_id % 397 = 5 THEN 'x' || text ELSE coalesce(text, '') END")},
win AS (SELECT * FROM (SELECT k, i AS s, count(*) OVER w AS c, sum(v) OVER w AS p, sum(v * i) OVER w - i * sum(v) OVER w AS q FROM abyt WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {LARGE_BLOCK - 1} FOLLOWING)) WHERE c = {LARGE_BLOCK}),
blk AS (SELECT k, p, q, min(o) AS o FROM (SELECT k, i // {LARGE_BLOCK} * {LARGE_BLOCK} AS o, sum(v) AS p, sum(v * (i % {LARGE_BLOCK})) AS q FROM bbyt GROUP BY ALL HAVING count(*) = {LARGE_BLOCK}) GROUP BY k, p, q),
m AS MATERIALIZED (SELECT win.k, win.s, blk.o FROM win JOIN blk ON blk.k = win.k AND blk.p = win.p AND blk.q = win.q JOIN atot ON atot.k = win.k JOIN btot ON btot.k = win.k WHERE atot.x[s + 1:s + {LARGE_BLOCK}] = btot.x[o + 1:o + {LARGE_BLOCK}]),
{_follow(LARGE_BLOCK)},
en AS (SELECT atot.k, n, coalesce(d.pending, 0) AS pending FROM atot LEFT JOIN (SELECT k, max(s) + {LARGE_BLOCK} AS pending FROM walk GROUP BY k) d ON d.k = atot.k)
SELECT k AS file_id, 'copy' AS op, s AS src_offset, o AS dest_offset, {LARGE_BLOCK}::BIGINT AS length FROM walk
UNION ALL SELECT k, 'data', b, b, s - b FROM (SELECT k, s, coalesce(lag(s + {LARGE_BLOCK}) OVER (PARTITION BY k ORDER BY s), 0) AS b FROM walk) WHERE s > b
UNION ALL SELECT k, 'data', pending, pending, n - pending FROM en WHERE n > pending"""

ORACLES = {
    "c1_content_chunks": f"WITH RECURSIVE {_DOC_BYTES}, {_cuts(chunking.ChunkConfig(64, 256, 1024))}",
    "c1_large_chunks": f"WITH RECURSIVE {_archive_bytes('')}, {_cuts(chunking.ChunkConfig())}",
    "d1_rotating": f"""WITH {_DOC_BYTES}, t AS (SELECT i, ('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UHUGEINT AS t FROM (SELECT i, sha256('block-hash:' || i::VARCHAR) AS h FROM range(256) r(i))),
rot AS (SELECT i, r, ((t * pow(2, r)::UHUGEINT) % 18446744073709551616::UHUGEINT + t // pow(2, 64 - r)::UHUGEINT)::UBIGINT AS t FROM t, range(64) s(r)),
w AS (SELECT byt.k, byt.i // 512 * 512 AS o, bit_xor(rot.t) AS h FROM byt JOIN tot ON tot.k = byt.k JOIN rot ON rot.i = v AND rot.r = (least(n, byt.i // 512 * 512 + 512) - 1 - byt.i) % 64 GROUP BY ALL)
SELECT w.k AS file_id, o AS "offset", octet_length(x[o + 1:o + 512]) AS length, lpad(lower(hex(h)), 16, '0') AS weak, sha256(x[o + 1:o + 512]) AS strong FROM w JOIN tot ON tot.k = w.k""",
    "d2_delta": f"{DELTA_SQL} SELECT k AS pair_id, (row_number() OVER (PARTITION BY k ORDER BY src_offset) - 1)::INT AS step, op, src_offset, dest_offset, length FROM st",
    "d3_large_delta": _LARGE_DELTA,
    "d4_delta_stats": f"{DELTA_SQL}, {_SUMS} SELECT * FROM ds",
    "a7_merged_delta_stats": f"{DELTA_SQL}, {_SUMS} SELECT sum(total_blocks)::BIGINT AS total_blocks, sum(matched_blocks)::BIGINT AS matched_blocks, sum(transferred_blocks)::BIGINT AS transferred_blocks, sum(bytes_saved)::BIGINT AS bytes_saved, sum(bytes_transferred)::BIGINT AS bytes_transferred, round(sum(bytes_saved) / (sum(bytes_saved) + sum(bytes_transferred))::DOUBLE, 9) AS savings_ratio FROM ds",
}

"""Queries over the contents of files after a journal's replay, and SQL that looks at each byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journals

BLOCK = 256


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as a journal: files created, updated by two writes around a copy, and deleted."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    k = F.col("event_id")
    text = lambda salt, n: F.encode(F.substring(F.repeat(F.md5(F.concat(F.lit(salt), k.cast("string"))), 20), F.lit(1), (n).cast("int")), "UTF-8")
    op = F.when(k % 17 == 0, "delete_file").when(k % 11 == 0, "create_file").when(k % 13 == 0, "set_metadata").otherwise("update_file")
    write = lambda salt, n: F.struct(F.lit("write_chunk").alias("kind"), n.cast("long").alias("length"), text(salt, n).alias("data"))
    copy = F.struct(F.lit("copy_chunk").alias("kind"), (k * 37 % 900).cast("long").alias("length"), F.lit(None).cast("binary").alias("data"))
    ops = F.array(write("a", k * 7 % 300), copy, write("b", k * 5 % 500))
    return e.select(k.alias("ordinal"), F.concat(F.lit("p"), (F.col("user_id") % 97).cast("string")).alias("path"), op.alias("op"), F.when(op == "create_file", text("c", k % 600)).alias("data"),
                    F.when(op == "create_file", k * 3 % 900).when(k % 3 == 0, k * 13 % 1500).when(op == "update_file", k * 7 % 300 + k * 37 % 900 + k * 5 % 500).alias("size"), F.when(op == "update_file", ops).alias("ops"))


def _existing(spark, d):
    old = entries(spark, d).select("path").distinct().where("path < 'p6'")
    return old.select("path", F.encode(F.repeat(F.md5("path"), 40), "UTF-8").alias("data"))


QUERIES = {
    "p10_extents": lambda s, d: journals.extents(journals.steps(entries(s, d)), _existing(s, d), BLOCK),
    "p10_contents": lambda s, d: journals.contents(journals.steps(entries(s, d)), _existing(s, d), BLOCK),
}

_TEXT = lambda salt, n: f"substring(repeat(md5('{salt}' || k::VARCHAR), 20), 1, ({n})::INT)"
#: Every byte of every write, numbered; the newest of a place is the largest (ordinal, step).
_BYTES = f"""WITH e AS (SELECT event_id AS k, 'p' || (user_id % 97)::VARCHAR AS path, CASE WHEN event_id % 17 = 0 THEN 'delete_file' WHEN event_id % 11 = 0 THEN 'create_file' WHEN event_id % 13 = 0 THEN 'set_metadata' ELSE 'update_file' END AS op FROM events),
o AS (SELECT path, -1 AS k, 0 AS step, 'create_file' AS op, 0 AS off, repeat(md5(path), 40) AS t, 1280 AS size FROM (SELECT DISTINCT path FROM e WHERE path < 'p6')
 UNION ALL SELECT path, k, 0, op, 0, {_TEXT("c", "k % 600")}, k * 3 % 900 FROM e WHERE op = 'create_file'
 UNION ALL SELECT path, k, 0, op, 0, NULL, 0 FROM e WHERE op = 'delete_file'
 UNION ALL SELECT path, k, 0, 'write_chunk', 0, {_TEXT("a", "k * 7 % 300")}, NULL FROM e WHERE op = 'update_file'
 UNION ALL SELECT path, k, 2, 'write_chunk', k * 7 % 300 + k * 37 % 900, {_TEXT("b", "k * 5 % 500")}, NULL FROM e WHERE op = 'update_file'
 UNION ALL SELECT path, k, 3, 'set_size', NULL, NULL, CASE WHEN k % 3 = 0 THEN k * 13 % 1500 ELSE k * 7 % 300 + k * 37 % 900 + k * 5 % 500 END FROM e WHERE op = 'update_file'),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k, step) AS r FROM o),
p AS (SELECT path, coalesce(max(r) FILTER (op IN ('create_file', 'delete_file')), 0) AS reset, coalesce(max(r) FILTER (size IS NOT NULL), 0) AS sizer, arg_max(op, r) AS newest FROM n GROUP BY path),
f AS (SELECT n.path, any_value(reset) AS reset, greatest(coalesce(max(CASE WHEN r > sizer AND t IS NOT NULL THEN off + length(t) END), 0), coalesce(max(CASE WHEN r = sizer THEN size END), 0))::BIGINT AS final
 FROM n JOIN p ON p.path = n.path WHERE newest != 'delete_file' AND r >= reset GROUP BY n.path),
b AS (SELECT n.path, k, step, op, t, off, size, r, final FROM n JOIN f ON f.path = n.path WHERE r >= reset),
w AS (SELECT path, off + i AS pos, k, step, r, i, hex(encode(t[i + 1:i + 1])) AS h FROM (SELECT *, unnest(range(0, least(length(t), final - off, CASE WHEN op = 'create_file' THEN size ELSE final END))) AS i FROM b WHERE t IS NOT NULL AND off < final)
 UNION ALL SELECT path, size + i, k, step, r, i, '00' FROM (SELECT *, unnest(range(0, final - size)) AS i FROM b WHERE op = 'set_size' AND size < final)
 UNION ALL SELECT path, i, -2, 0, 0, i, '00' FROM (SELECT path, unnest(range(0, final)) AS i FROM f)),
l AS (SELECT path, pos, arg_max(k, r) AS k, arg_max(step, r) AS step, arg_max(i, r) AS i, arg_max(h, r) AS h FROM w GROUP BY path, pos)"""

ORACLES = {
    "p10_extents": f"""{_BYTES}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY path, pos // {BLOCK}, k, step ORDER BY pos) AS run FROM l)
SELECT path, min(pos)::BIGINT AS "offset", count(*) AS length, k::BIGINT AS ordinal, step::INT AS step, min(i)::BIGINT AS "from" FROM g GROUP BY path, pos // {BLOCK}, k, step, run""",
    "p10_contents": f"""{_BYTES}, h AS (SELECT path, pos // {BLOCK} AS b, sha256(unhex(string_agg(h, '' ORDER BY pos))) AS own FROM l GROUP BY ALL),
d AS (SELECT path, count(*) AS n, string_agg(own, '' ORDER BY b) AS owns FROM h GROUP BY path)
SELECT f.path, final AS size, coalesce(n, 0) AS blocks, sha256(coalesce(owns, '')) AS digest FROM f LEFT JOIN d ON d.path = f.path""",
}

"""Queries over log sinks fed by streams, listings as a data source, and scans that end early."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans
from ..sources import audit_files, backends
from ..streaming import sinks
from .content import LINE_SQL, lineitem_index
from .logs import _MAC, KEY, chains, events

RUNS = 3


def _telemetry(spark, d):
    """Events as telemetry lines, a chain for each user."""
    e = events(spark, d)
    job = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    held = e.select(job.alias("chain"), F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("ts"), job.alias("job"), F.col("event_type").alias("event"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 3).alias("bytes"))
    return held.select("chain", "ordinal", sinks.line(held.columns, "telemetry").alias("body"))


def _sink(spark, d):
    """Telemetry that comes in three runs of a stream, each stopped and started again, and the chains that it leaves."""
    source, folder = audit_files.fresh_folder(spark, "sink-events"), audit_files.fresh_folder(spark, "sink")
    rows = _telemetry(spark, d)
    most = rows.agg(F.max("ordinal").alias("m")).first()["m"] or 0
    for run in range(RUNS):
        rows.where(F.floor(F.col("ordinal") * RUNS / (most + 1)) == run).write.mode("append").parquet(source)
        sinks.start(spark.readStream.schema(rows.schema).parquet(source), folder, KEY).awaitTermination()
    return sinks.read(spark, folder)


def _backend_listing(spark, d):
    """Files of the event types that start with a letter, from a listing with the prefix pushed into it."""
    folder = audit_files.fresh_folder(spark, "backend")
    e = events(spark, d)
    e.select(F.col("event_type").alias("kind"), F.md5(F.col("event_id").cast("string")).alias("line")).write.partitionBy("kind").text(folder)
    before = spark.conf.get(backends.PUSHDOWN, None)
    spark.conf.set(backends.PUSHDOWN, "true")
    try:
        files = backends.folder_listing(spark, folder).where(F.col("path").startswith("kind=") & ~F.col("hidden"))
        found = files.groupBy(F.regexp_extract("path", "kind=([^/]+)/", 1).alias("kind")).agg(F.sum("size").alias("bytes"))
        return audit_files.written(found, "backend-listing")
    finally:
        if before is None:
            spark.conf.unset(backends.PUSHDOWN)
        else:
            spark.conf.set(backends.PUSHDOWN, before)


ORDER = ["content_id", "file_id", "chunk_index"]


def _early(spark, d):
    """Locations in order of their chunks up to the first long one in a certain place."""
    path = audit_files.fresh_folder(spark, "ordered-index")
    scans.save_ordered(lineitem_index(spark, d).select(*ORDER, "length", "star_id"), path, ORDER, 32)
    return scans.scan_until(spark, path, lambda rows: ~((rows["length"] > 4500) & (rows["star_id"] % 10 == 3))).rows


QUERIES = {
    "s19_chained_sink": _sink,
    "ud3_backend_listing": _backend_listing,
    "o4_ud4_early_scan": _early,
}

ORACLES = {
    "s19_chained_sink": f"""WITH RECURSIVE can AS MATERIALIZED (SELECT chain, seq, '{{"sequence":' || seq || ',"chain":"' || chain || '","ts":"' || event_id || '","job":"' || chain || '","event":"' || event_type || '"' || CASE WHEN event_id % 4 != 0 THEN ',"bytes":' || event_id * 3 ELSE '' END || '}}' AS c
 FROM (SELECT 'c' || user_id::VARCHAR AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id, event_type FROM events)),
sg AS (SELECT chain, seq, c, {_MAC(f"unhex('{chains.ZERO}') || encode(c)")} AS h FROM can WHERE seq = 0 UNION ALL SELECT can.chain, can.seq, can.c, {_MAC("unhex(h) || encode(can.c)")} FROM sg JOIN can ON can.chain = sg.chain AND can.seq = sg.seq + 1)
SELECT chain, seq AS line_no, '{{"integrity_hash":"' || h || '",' || c[2:] AS value FROM sg""",
    "ud3_backend_listing": "SELECT event_type AS kind, count(*) * 33 AS bytes FROM events GROUP BY 1",
    "o4_ud4_early_scan": f"WITH {LINE_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY content_id, file_id, chunk_index) AS r FROM loc) SELECT content_id, file_id, chunk_index, length, star_id FROM n WHERE r <= (SELECT coalesce(min(r), (SELECT count(*) FROM n)) FROM n WHERE length > 4500 AND star_id % 10 = 3)",
}

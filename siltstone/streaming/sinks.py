"""Log sinks fed by streams: lines are appended a micro-batch at a time, signed in chains or plain.

A sink is a folder: ``lines/batch=N`` has a micro-batch's lines, ``heads/batch=N``
the sequence and hash each of its chains ends with. Heads are written last, so
a batch counts when its heads are complete. A batch that comes again after a
failure is written over, or passed over if it counts already; the stream's
checkpoint lies in the folder too, so that batch numbers and heads stay together.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.folds import walked

#: Fields of the forms of log lines, fixed values; those after the bar are left out when null.
FORMS = {
    "provenance": ("ts", "event_type", "job_id", "|", "chunk_hash", "source_star", "source_path", "dest_star", "dest_path", "bytes", "duration_ms", "error", "context"),
    "telemetry": ("ts", "job", "event", "|", "path", "window_id", "files", "bytes", "repair", "digest", "message"),
    "unified": ("trace_id", "span_id", "timestamp", "payload", "|", "parent_span_id", "job_id", "file_id", "metadata"),
}
#: Every so many batches the heads of all chains are written anew, so that a batch reads at most so many tables of heads.
COMPACT = 20


def line(columns: list[str], form: str) -> Column:
    """A JSON line of the form from the columns there are; a required field must be there, and null in none."""
    names = FORMS[form]
    bar = names.index("|")
    missing = [n for n in names[:bar] if n not in columns]
    if missing:
        raise ValueError(f"{form} lines need {', '.join(missing)}")
    text = F.to_json(F.struct(*[n for n in (*names[:bar], *names[bar + 1 :]) if n in columns]))
    absent = F.lit(False)
    for n in names[:bar]:
        absent = absent | F.col(n).isNull()
    return F.when(absent, F.raise_error(F.lit(f"a {form} line lacks a required field"))).otherwise(text)


def _path(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def complete_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that count."""
    fs, path = _path(spark, f"{folder}/heads")
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


_HEAD = "chain string, sequence long, hash string"


def heads(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(chain, sequence, hash) at the end of all batches, or of those before one."""
    done = [b for b in complete_batches(spark, folder) if before is None or b < before]
    base = max((b for b in done if b % COMPACT == 0), default=None)
    wanted = [b for b in done if base is None or b >= base]
    if not wanted:
        return spark.createDataFrame([], _HEAD)
    rows = spark.read.schema(_HEAD).parquet(*[f"{folder}/heads/batch={b}" for b in wanted])
    newest = rows.groupBy("chain").agg(F.max(F.struct("sequence", "hash")).alias("h"))
    return newest.select("chain", "h.sequence", "h.hash")


def append(events: DataFrame, batch: int, folder: str, key: bytes | None) -> None:
    """One micro-batch of events (chain, ordinal, body: a JSON object) to the sink; the same batch twice is the same as once.

    In a chain lines are in the order of (ordinal, body), after those of earlier
    batches; a null chain is written as an empty name, a null body as an empty object. With
    ``key`` a line carries its sequence, its chain and the hash over the hash
    before it and the line; without, lines are plain and only counted.
    """
    spark = events.sparkSession
    if batch in complete_batches(spark, folder):
        return
    rows = events.select(F.coalesce(F.col("chain").cast("string"), F.lit("")).alias("chain"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("body", F.lit("{}")).alias("body"), F.lit(False).alias("head"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("string").alias("hash"))
    known = heads(spark, folder, batch)
    touched = known.join(rows.select("chain").distinct(), "chain", "left_semi")
    known_rows = touched.select("chain", F.lit(None).cast("long").alias("ordinal"), F.lit("").alias("body"), F.lit(True).alias("head"), "sequence", "hash")

    def step(state: tuple[bytes, int], r) -> tuple[tuple[bytes, int], list[tuple]]:
        prior, place = state
        if r.head:
            return (bytes.fromhex(r.hash or "00" * 32), int(r.sequence)), []
        place += 1
        if key is None:
            return (prior, place), [(r.chain, place, None, r.body)]
        rest = r.body[1:].lstrip()
        canonical = f'{{"sequence":{place},"chain":{json.dumps(r.chain, ensure_ascii=False)}{"" if rest == "}" else ","}{rest}'
        own = hmac.new(key, prior + canonical.encode(), hashlib.sha256).digest()
        return (own, place), [(r.chain, place, own.hex(), f'{{"integrity_hash":"{own.hex()}",{canonical[1:]}')]

    # a chain's head, which has no ordinal and is marked, comes before its events
    ordered = rows.unionByName(known_rows).withColumn("later", ~F.col("head"))
    made = walked(ordered, "chain", ("later", "ordinal", "body"), lambda: (bytes(32), -1), step, "chain string, sequence long, hash string, value string")
    lines = f"{folder}/lines/batch={batch}"
    made.write.mode("overwrite").parquet(lines)
    held = spark.read.schema(made.schema).parquet(lines)
    ends = held.groupBy("chain").agg(F.max(F.struct("sequence", "hash")).alias("h")).select("chain", "h.sequence", "h.hash")
    if batch % COMPACT == 0:
        ends = ends.unionByName(known.join(ends.select("chain"), "chain", "left_anti"))
    ends.write.mode("overwrite").parquet(f"{folder}/heads/batch={batch}")


def start(events: DataFrame, folder: str, key: bytes | None, **trigger) -> StreamingQuery:
    """Follow a stream of events (chain, ordinal, body) into the sink, by default all that is there, then stop."""
    sink = folder.rstrip("/")
    writer = events.writeStream.foreachBatch(lambda rows, batch: append(rows, batch, sink, key)).option("checkpointLocation", f"{sink}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(chain, line_no, value) of the batches that count, as the checks of chains take them."""
    done = complete_batches(spark, folder)
    if not done:
        return spark.createDataFrame([], "chain string, line_no long, value string")
    rows = spark.read.schema("chain string, sequence long, value string").parquet(*[f"{folder}/lines/batch={b}" for b in done])
    return rows.select("chain", F.col("sequence").alias("line_no"), "value")

"""Manifests: chunk windows and their roots, validation, progress, resume decisions, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, OVERLAP = 64, 4
SCHEMA_VERSION = "1"


def windows(chunks: DataFrame, key: str = "file_id", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, window_id, first_chunk, count, merkle_root) over (key, chunk_index, content_id).

    A window starts every ``size`` - ``overlap`` chunks while a whole one fits;
    the last ``overlap`` starts follow chunk by chunk with what is left. The
    root hashes the ids of a window's chunks, concatenated in order.
    """
    step = size - overlap
    counts = chunks.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    k = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / step) + 1).otherwise(0)
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda f: ((f % step == 0) & (f <= step * k)) | (f >= F.col("n") - overlap))
    first = counts.select(key, "n", F.posexplode(starts).alias("window_id", "first_chunk"))
    first = first.withColumn("count", F.least(F.lit(size), F.col("n") - F.col("first_chunk")))
    members = first.select(key, "window_id", "first_chunk", "count", F.explode(F.sequence("first_chunk", F.col("first_chunk") + F.col("count") - 1)).alias("chunk_index"))
    held = members.join(chunks.select(key, F.col("chunk_index").cast("int").alias("chunk_index"), "content_id"), [key, "chunk_index"])
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content_id")))  # at most a window's chunks
    root = F.sha2(F.array_join(F.transform(ordered, lambda x: x["content_id"]), ""), 256)
    return held.groupBy(key, "window_id", "first_chunk", "count").agg(root.alias("merkle_root"))


def window_of_chunks(chunks: DataFrame, spans: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, chunk_index, window_id): every window that a chunk is in, as an equi-join on the windows' chunks."""
    inside = spans.select(key, "window_id", F.explode(F.sequence(F.col("first_chunk").cast("long"), (F.col("first_chunk") + F.col("count") - 1).cast("long"))).alias("chunk_index"))
    return chunks.select(key, "chunk_index").join(inside, [key, "chunk_index"])


def cargo(files: DataFrame, chunks: DataFrame, spans: DataFrame, key: str = "file_id") -> DataFrame:
    """One manifest a file: path, size, chunk count, windows as an ordered array. Files without chunks have none."""
    total = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("length").alias("size"))
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("window_id", "first_chunk", "count", "merkle_root"))).alias("windows"))
    return files.select(key, "path").join(total, key).join(listed, key)


def violations(manifest: DataFrame) -> DataFrame:
    """Manifests (schema, path, chunking struct, windows array) with the array of rules they break, in order."""
    chunking = F.col("chunking")
    rules = [
        (F.col("schema") != SCHEMA_VERSION, "schema version"),
        (F.col("path") == "", "path is empty"),
        (~chunking["type"].isin("cdc", "fixed"), "chunking type"),
        ((chunking["type"] == "cdc") & chunking["avg_kib"].isNull(), "cdc needs avg_kib"),
        ((chunking["type"] == "cdc") & chunking["algo"].isNull(), "cdc needs algo"),
        ((chunking["type"] == "fixed") & chunking["fixed_kib"].isNull(), "fixed needs fixed_kib"),
    ]
    general = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])
    own = F.flatten(
        F.transform(
            "windows",
            lambda w, i: F.array(
                F.when(w["id"] != i, F.concat(F.lit("window "), i.cast("string"), F.lit(": id"))),
                F.when(w["count"] == 0, F.concat(F.lit("window "), i.cast("string"), F.lit(": no chunks"))),
                F.when(F.coalesce(w["merkle_root"], F.lit("")) == "", F.concat(F.lit("window "), i.cast("string"), F.lit(": no root"))),
            ),
        )
    )
    return manifest.withColumn("violations", F.array_compact(F.concat(general, own)))


def strict_violations(plan: DataFrame) -> DataFrame:
    """The stricter schema's rules: at least one window, roots of 64 hex digits, counts of 1 or more, no negative starts."""
    digests = F.exists("windows", lambda w: ~w["merkle_root"].rlike("^[0-9a-f]{64}$"))
    rules = [(F.size("windows") < 1, "windows"), (digests, "digest"), (F.exists("windows", lambda w: w["count"] < 1), "count"), (F.exists("windows", lambda w: w["first_chunk"] < 0), "first_chunk")]
    return plan.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in rules])))


def map_violations(spans: DataFrame, chunk_counts: DataFrame, key: str = "file_id") -> DataFrame:
    """Windows that break a chunk map's rules: ids not in sequence, or a start beyond the file's chunks."""
    place = F.row_number().over(W.partitionBy(key).orderBy("window_id")) - 1
    rows = spans.withColumn("__place", place).join(chunk_counts, key, "left")
    bad = F.when(F.col("window_id") != F.col("__place"), "sequence").when(F.col("first_chunk") >= F.coalesce("n", F.lit(0)), "range")
    return rows.select(key, "window_id", bad.alias("violation")).where("violation is not null")


def diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """An extension: (key, change) added, removed, changed or same between two manifests' files."""
    a = old.select(key, F.col(digest).alias("old_digest"))
    b = new.select(key, F.col(digest).alias("new_digest"))
    kind = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def verify_summary(references: DataFrame, manifests: DataFrame, key: str = "path") -> DataFrame:
    """verified and failed over file references: a manifest is there and breaks no rule."""
    found = references.select(key).join(manifests.select(key, F.size("violations").alias("__bad")), key, "left")
    good = F.coalesce(F.col("__bad") == 0, F.lit(False))
    return found.agg(F.count_if(good).alias("verified"), F.count_if(~good).alias("failed"))


def resume_decision(copied: Column, saved_size: Column, saved_mtime: Column, dest_size: Column, dest_mtime: Column) -> Column:
    """start_fresh, restart, revalidate or resume; a null destination size is a missing file; the order of the tests counts."""
    mismatch = saved_size.isNotNull() & (dest_size != saved_size) & (dest_size != copied)
    touched = F.coalesce(dest_mtime > saved_mtime + 2, F.lit(False))
    return (
        F.when(copied == 0, "start_fresh")
        .when(dest_size.isNull(), "restart")
        .when(mismatch, "restart")
        .when(touched, "revalidate")
        .when(dest_size < copied, "restart")
        .when(dest_size > copied, "revalidate")
        .otherwise("resume")
    )


def validate_ranges(content: DataFrame, digests: DataFrame, size: int, key: str = "file_id") -> DataFrame:
    """(key, checked, failed): stored digests of chunks against the content; chunks beyond its end are skipped."""
    pieces = digests.join(content, key).withColumn("piece", F.substring(F.col("content"), F.col("chunk") * size + 1, F.lit(size))).where(F.length("piece") > 0)
    return pieces.groupBy(key).agg(F.count("*").alias("checked"), F.count_if(F.sha2("piece", 256) != F.col("digest")).alias("failed"))


def partial_valid(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Partial manifests against files: same path pair, version 1, equal size, times at most one whole second apart."""
    rows = manifest.alias("m").join(now.alias("f"), "path")
    good = (F.col("m.version") == 1) & (F.col("m.size") == F.col("f.size")) & (F.floor(F.abs(F.col("m.modified") - F.col("f.modified"))) <= 1)
    return rows.select("path", good.alias("valid"))


def upsert(entries: DataFrame, key: str = "dest_path", order: str = "transferred_at") -> DataFrame:
    """The latest entry of each key, in columns that can be ordered; of entries equal in time the largest by the other columns.

    A maximum is taken partly before the shuffle, so a key with many versions is no task's burden.
    """
    newest = entries.groupBy(key).agg(F.max(F.struct(order, *[c for c in entries.columns if c not in (key, order)])).alias("__newest"))
    return newest.select(key, "__newest.*").select(*entries.columns)


def journal_stats(operations: DataFrame) -> DataFrame:
    """operations, total_bytes (created, written and copied) and data_bytes (created and written only)."""
    stored = F.when(F.col("op").isin("create_file", "write_chunk"), F.col("length")).otherwise(0)
    moved = F.when(F.col("op").isin("create_file", "write_chunk", "copy_chunk"), F.col("length")).otherwise(0)
    return operations.agg(F.count("*").alias("operations"), F.coalesce(F.sum(moved), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum(stored), F.lit(0)).cast("long").alias("data_bytes"))


def replay_counts(operations: DataFrame, existing: DataFrame) -> DataFrame:
    """What a replay of (ordinal, path, op, hash, dest_hash) would do: created, written, copied, copy_failed, deleted, metadata.

    A copy needs the path to exist when its turn comes and its hash to agree;
    a delete of a path that is not there counts for nothing.
    """
    events = operations.unionByName(existing.select(F.lit(-1).cast("long").alias("ordinal"), "path", F.lit("existing").alias("op")), allowMissingColumns=True)
    before = W.partitionBy("path").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    life = F.when(F.col("op").isin("existing", "create_file", "write_chunk"), True).when(F.col("op") == "delete_file", False)
    rows = events.withColumn("alive", F.coalesce(F.last(life, ignorenulls=True).over(before), F.lit(False)))
    good = F.col("alive") & (F.col("hash") == F.col("dest_hash"))
    return rows.agg(
        F.count_if(F.col("op") == "create_file").alias("created"),
        F.count_if(F.col("op") == "write_chunk").alias("written"),
        F.count_if((F.col("op") == "copy_chunk") & F.coalesce(good, F.lit(False))).alias("copied"),
        F.count_if((F.col("op") == "copy_chunk") & ~F.coalesce(good, F.lit(False))).alias("copy_failed"),
        F.count_if((F.col("op") == "delete_file") & F.col("alive")).alias("deleted"),
        F.count_if(F.col("op") == "set_metadata").alias("metadata"),
    )

"""Decisions over two listings: what to copy, skip, delete, link or rename.

A listing has at least path, size, modified (seconds) and what a function's
docstring names beside; content hashes are computed by the caller for the rows
that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DELTA_LEAST = 64 * 1024


def pair(source: DataFrame, dest: DataFrame, key: str = "path") -> DataFrame:
    """Source rows with struct ``dst`` of the destination's row, null where there is none."""
    right = dest.select(dest[key].alias("__key"), F.struct(*[dest[c] for c in dest.columns]).alias("dst"))
    return source.join(right, source[key] == F.col("__key"), "left").drop("__key")


def should_copy(mode: str, size: Column, modified: Column, dst: Column) -> Column:
    """Whether a source file is copied: copy and mirror always, update if newer, sync if newer or of another size."""
    missing, newer = dst.isNull(), modified > dst["modified"]
    if mode in ("copy", "mirror"):
        return F.lit(True)
    if mode == "update":
        return missing | newer
    if mode == "sync":
        return missing | newer | (size != dst["size"])
    raise ValueError(f"unknown mode {mode!r}")


def decisions(source: DataFrame, dest: DataFrame, mode: str) -> DataFrame:
    """path, size, action: create, update or skip."""
    rows = pair(source, dest)
    copy = should_copy(mode, F.col("size"), F.col("modified"), F.col("dst"))
    action = F.when(F.col("dst").isNull(), "create").when(copy, "update").otherwise("skip")
    return rows.select("path", "size", action.alias("action"))


def deletions(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Destination rows that the source lacks, with their depth; delete deeper ones first."""
    return dest.join(source.select("path"), "path", "left_anti").withColumn("depth", F.size(F.split("path", "/")))


def needs_transfer(check: str, size: Column, modified: Column, digest: Column, blocks: Column, dst: Column) -> Column:
    """By check: modtime (newer or size), size, checksum, or delta (small files by checksum, others by all block signatures)."""
    other_size = size != dst["size"]
    by = {
        "modtime": other_size | (modified > dst["modified"]),
        "size": other_size,
        "checksum": other_size | (digest != dst["digest"]),
        "delta": other_size | F.when(size < DELTA_LEAST, digest != dst["digest"]).otherwise(blocks != dst["blocks"]),
    }
    if check not in by:
        raise ValueError(f"unknown check {check!r}")
    return dst.isNull() | by[check]


def should_use_delta(size: Column, dst_size: Column, delta_mode: Column, whole_file: Column, partial_valid: Column) -> Column:
    """The delta gate: a valid partial file, or delta mode, a destination, 64 KiB, and sizes within a factor of two."""
    ratio = F.greatest(size, dst_size) / F.nullif(F.least(size, dst_size), F.lit(0))
    near = F.coalesce(ratio <= 2.0, F.lit(False))
    gate = dst_size.isNotNull() & delta_mode & (size >= DELTA_LEAST) & near
    return ~whole_file & (partial_valid | gate)


def renames(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Source files without a destination whose digest a destination file has: path, linked_path (the first by path)."""
    missing = source.join(dest.select("path"), "path", "left_anti")
    first = dest.groupBy("digest").agg(F.min("path").alias("linked_path"))
    return missing.join(first, "digest").select("path", "linked_path", "digest")


def link_dest(source: DataFrame, references: DataFrame) -> DataFrame:
    """Source files found under the same path, size and digest in a reference directory; the first directory wins."""
    same = source.select("path", "size", "digest").join(references, ["path", "size", "digest"])
    return same.groupBy("path", "size", "digest").agg(F.min("ref_priority").alias("ref_priority"))


def link_dest_quick(source: DataFrame, references: DataFrame) -> DataFrame:
    """The same by path, size and exact modification time."""
    same = source.select("path", "size", "modified").join(references.select("path", "size", "modified", "ref_priority"), ["path", "size", "modified"])
    return same.groupBy("path", "size", "modified").agg(F.min("ref_priority").alias("ref_priority"))


def link_dest_overlap(source_chunks: DataFrame, reference_chunks: DataFrame, least: float = 0.3) -> DataFrame:
    """(path, decision, ref_priority, overlap) by chunk overlap with the references' files of the same path.

    ``hardlink`` if all chunks are there and the counts agree, ``delta_basis``
    from ``least`` on, in the first directory that allows either, else ``full``.
    """
    counts = source_chunks.groupBy("path").agg(F.count("*").alias("n"))
    distinct = reference_chunks.select("path", "ref_priority", "content_id").distinct()
    held = reference_chunks.groupBy("path", "ref_priority").agg(F.count("*").alias("ref_n"))
    common = source_chunks.select("path", "content_id").join(distinct, ["path", "content_id"]).groupBy("path", "ref_priority").agg(F.count("*").alias("hits"))
    scored = common.join(held, ["path", "ref_priority"]).join(counts, "path").withColumn("overlap", F.col("hits") / F.col("n"))
    kind = F.when((F.col("hits") == F.col("n")) & (F.col("n") == F.col("ref_n")), "hardlink").when(F.col("overlap") >= least, "delta_basis")
    usable = scored.withColumn("decision", kind).where("decision is not null")
    best = usable.groupBy("path").agg(F.min(F.struct("ref_priority", "decision", "overlap")).alias("best"))
    return counts.join(best, "path", "left").select("path", F.coalesce("best.decision", F.lit("full")).alias("decision"), "best.ref_priority", F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"))


def hardlinks(files: DataFrame) -> DataFrame:
    """Files with several links: path, original (the first path of their inode), is_link."""
    first = F.min("path").over(W.partitionBy("dev", "ino"))
    return files.where("nlink > 1").select("path", first.alias("original")).withColumn("is_link", F.col("path") != F.col("original"))


def verify_metadata(pairs: DataFrame, flags: set[str]) -> DataFrame:
    """Rows of (path, src, dst) structs with ``verified``: times, permissions, ownership and xattrs as flagged; never ACLs."""
    test = F.lit(True)
    if "times" in flags:
        test = test & F.col("src.modified").eqNullSafe(F.col("dst.modified"))
    if "permissions" in flags:
        test = test & F.col("src.permissions").eqNullSafe(F.col("dst.permissions"))
    if "ownership" in flags:
        test = test & F.col("src.uid").eqNullSafe(F.col("dst.uid")) & F.col("src.gid").eqNullSafe(F.col("dst.gid"))
    if "xattrs" in flags:
        sides = [F.array_sort(F.map_entries(F.coalesce(F.col(f"{s}.xattrs"), F.create_map().cast("map<string,string>")))) for s in ("src", "dst")]
        test = test & (sides[0] == sides[1])
    return pairs.withColumn("verified", test)


def disk_guard(required: Column, available: Column, reserve: float = 0.10, floor: int = 100 << 20) -> Column:
    """Whether what is free covers what is needed with a tenth more and 100 MiB."""
    return available >= required + F.floor(required * reserve).cast("long") + floor


def dry_run_summary(actions: DataFrame) -> DataFrame:
    """One row of counts by action and the bytes that copies and updates would move."""
    n = lambda kind: F.coalesce(F.count_if(F.col("action") == kind), F.lit(0)).alias(f"{kind}s")
    moved = F.coalesce(F.sum(F.when(F.col("action").isin("create", "update"), F.col("size"))), F.lit(0)).cast("long")
    return actions.agg(n("create"), n("update"), n("skip"), n("delete"), moved.alias("bytes"))


def copy_totals(stats: DataFrame) -> DataFrame:
    """Sums of per-file results: bytes_copied, files_copied, files_skipped, files_failed, chunks_resumed."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("bytes_copied", "files_copied", "files_skipped", "files_failed", "chunks_resumed")])


#: Tiers: rank of each priority, fixed values.
TIERS = {"critical": 0, "high": 10, "normal": 50, "low": 100}
#: Names that decide a file's class, fixed values.
CONFIG_EXTENSIONS = ("toml", "json", "yaml", "yml", "ini", "conf", "lock", "env")
CONFIG_NAMES = ("config", "configuration", ".env", "dockerfile", "makefile")
LOG_EXTENSIONS = ("wal", "log", "binlog")
MEDIA_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "flv", "mp3", "flac", "wav", "ogg", "m4a", "jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "iso", "img", "dmg", "vdi", "vmdk", "qcow2", "zip", "tar", "gz", "bz2", "xz", "7z", "rar")


def semantic_class(path: Column, head: Column, extra: list[tuple[Column, str, str, str]] = ()) -> Column:
    """(class, priority, rank, strategy, description) by the first test that holds.

    ``extra`` has (test, class, priority, strategy) tuples that come before the
    built-in ones: configuration, write-ahead logs, media, anything else.
    """
    from ..functions.scalars import base_name, extension

    name = base_name(path)
    ext, low, lower_path = F.lower(extension(path)), F.lower(name), F.lower(path)
    config = F.when(ext.isNotNull(), ext.isin(*CONFIG_EXTENSIONS)).otherwise(low.isin(*CONFIG_NAMES))
    log = lower_path.contains("pg_wal") | lower_path.contains("pg_xlog") | F.coalesce(ext.isin(*LOG_EXTENSIONS), F.lit(False))
    lead = F.hex(F.substring(head, 1, 8))
    magic = (F.length(head) >= 12) & ((F.substring(lead, 9, 8) == "66747970") | lead.startswith("89504E47") | lead.startswith("FFD8FF"))
    media = F.coalesce(ext.isin(*MEDIA_EXTENSIONS), F.lit(False)) | F.coalesce(magic, F.lit(False))
    tests = [*extra, (config, "Config", "critical", "atomic_replace"), (log, "WAL", "high", "append_only"), (media, "Media", "low", "content_defined"), (F.lit(True), "Standard", "normal", "content_defined")]
    case = None
    for test, label, priority, strategy in tests:
        value = F.struct(F.lit(label).alias("class"), F.lit(priority).alias("priority"), F.lit(TIERS[priority]).alias("rank"), F.lit(strategy).alias("strategy"), F.concat(F.lit(f"{label}: "), name).alias("description"))
        case = F.when(test, value) if case is None else case.when(test, value)
    return case


#: Sort keys by name; the first that differs decides.
ORDERS = {
    "semantic": lambda: F.col("rank").asc(),
    "smallest_first": lambda: F.col("size").asc(),
    "largest_first": lambda: F.col("size").desc(),
    "oldest_first": lambda: F.col("queued_at").asc(),
    "newest_first": lambda: F.col("queued_at").desc(),
    "fewest_retries": lambda: F.col("retry_count").asc(),
}


def prioritised(items: DataFrame, chain: tuple[str, ...] = ("semantic", "smallest_first", "oldest_first"), tie: str = "path") -> DataFrame:
    """Items in the order of the chain; ``tie`` settles what the chain leaves equal."""
    return items.orderBy(*[ORDERS[name]() for name in chain], F.col(tie).asc())

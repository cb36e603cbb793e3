"""Transfer settings as rows: rules that settle conflicts and tune to the environment, in order, with their notices.

A rule is (code, test, changes); each sees what the rules before it left. The
order counts: resume switches checksums off before compression switches resume
off, so settings with all three keep only compression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _conflicts() -> list[tuple[str, Column, dict[str, Column]]]:
    no, zero = F.lit(False), c("use_zero_copy")
    return [
        ("zerocopy_unavailable", zero & ~c("zero_copy_available"), {"use_zero_copy": no}),
        ("zerocopy_disabled_checksum", zero & c("verify_checksum"), {"use_zero_copy": no}),
        ("checksum_disabled_resume", c("resume") & c("verify_checksum"), {"verify_checksum": no}),
        ("resume_disabled_compression", c("resume") & (c("compression") != "none"), {"resume": no}),
        ("zerocopy_disabled_resume", zero & c("resume"), {"use_zero_copy": no}),
        ("zerocopy_disabled_manifest", c("generate_manifest") & zero, {"use_zero_copy": no}),
        ("zerocopy_disabled_delta", (c("check_mode") == "delta") & zero, {"use_zero_copy": no}),
        ("parallel_progress_warning", (c("parallel") > 1) & c("show_progress"), {}),
        ("sync_checksum_performance", c("copy_mode").isin("sync", "update") & (c("check_mode") == "checksum"), {}),
        ("zerocopy_disabled_compression", zero & (c("compression") != "none"), {"use_zero_copy": no}),
    ]


def _tuning() -> list[tuple[str, Column, dict[str, Column]]]:
    network, cloud = c("filesystem").isin("smb", "nfs"), c("filesystem").isin("s3", "gcs", "azure")
    zstd = F.lit("zstd:3")
    return [
        ("network_resume", network & ~c("resume"), {"resume": F.lit(True)}),
        ("network_retries", network & (c("retries") < 5), {"retries": F.lit(5)}),
        ("slow_io_compression", (c("cores") >= 8) & (c("io_mb_s") < 50) & (c("compression") == "none"), {"compression": zstd}),
        ("low_memory", (c("ram_gb") < 1) & (c("parallel") > 4), {"parallel": F.lit(2)}),
        ("auto_workers", ~network & ~cloud & (c("cores") > 8) & (c("parallel") == 0), {"parallel": F.expr("cast(cores div 2 as int)")}),
        ("fast_io_chunks", (c("io_mb_s") > 500) & (c("chunk_size") <= 1 << 20), {"chunk_size": F.lit(4 << 20)}),
        ("cloud_compression", cloud & (c("compression") == "none"), {"compression": zstd}),
        ("cloud_retries", cloud & (c("retries") < 10), {"retries": F.lit(10)}),
        ("cloud_backoff", cloud & ~c("exponential_backoff"), {"exponential_backoff": F.lit(True)}),
    ]


def apply_rules(settings: DataFrame, rules: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """Settings after the rules, with ``notices``: the codes that fired, in order."""
    if "notices" not in settings.columns:
        settings = settings.withColumn("notices", F.array().cast("array<string>"))
    for code, test, changes in rules:
        settings = settings.withColumn("__fires", test)
        fresh = {name: F.when(c("__fires"), value).otherwise(c(name)) for name, value in changes.items()}
        fresh["notices"] = F.when(c("__fires"), F.concat("notices", F.array(F.lit(code)))).otherwise(c("notices"))
        settings = settings.withColumns(fresh)
    return settings.drop("__fires")


def settle(settings: DataFrame) -> DataFrame:
    """Conflicts only."""
    return apply_rules(settings, _conflicts())


def optimise(settings: DataFrame) -> DataFrame:
    """Tuning to the probed environment (columns filesystem, cores, io_mb_s, ram_gb), then conflicts."""
    return apply_rules(apply_rules(settings, _tuning()), _conflicts())


def should_use_zero_copy(size: Column, available: Column, resume: Column, same_filesystem: Column, across: Column) -> Column:
    """The capability, no resume, one file system unless copies across work, and 64 KiB."""
    return available & ~resume & (across | same_filesystem) & (size >= 64 * 1024)


def filter_metadata(files: DataFrame, strip: tuple[str, ...] = (), xattr_pattern: str | None = None) -> DataFrame:
    """Files (xattrs map, uid, gid, permissions, modified, accessed, created) without what ``strip`` names.

    xattrs, ownership, permissions become null, times the epoch; attributes
    whose name matches the pattern go, and an empty map becomes null.
    """
    changes: dict[str, Column] = {}
    if "xattrs" in strip:
        changes["xattrs"] = F.lit(None).cast("map<string,string>")
    elif xattr_pattern is not None:
        kept = F.map_filter("xattrs", lambda k, _: ~k.rlike(xattr_pattern))
        changes["xattrs"] = F.when(F.size(kept) > 0, kept)
    if "ownership" in strip:
        changes |= {"uid": F.lit(None).cast("long"), "gid": F.lit(None).cast("long")}
    if "permissions" in strip:
        changes["permissions"] = F.lit(None).cast("int")
    if "times" in strip:
        changes |= {n: F.lit(0).cast("long") for n in ("modified", "accessed", "created")}
    return files.withColumns(changes) if changes else files


def metadata_json(files: DataFrame) -> DataFrame:
    """(path, json): metadata as a JSON map, attribute values in base64; absent fields are left out."""
    coded = F.transform_values("xattrs", lambda _, v: F.base64(F.encode(v, "UTF-8")))
    return files.select("path", F.to_json(F.struct("size", "modified", "permissions", "uid", "gid", coded.alias("xattrs"))).alias("json"))


def metadata_from_json(rows: DataFrame) -> DataFrame:
    """The inverse of ``metadata_json``."""
    parsed = F.from_json("json", "size long, modified long, permissions int, uid long, gid long, xattrs map<string,string>")
    held = rows.select("path", parsed.alias("m")).select("path", "m.*")
    return held.withColumn("xattrs", F.transform_values("xattrs", lambda _, v: F.decode(F.unbase64(v), "UTF-8")))

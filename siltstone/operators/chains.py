"""Hash-chained event logs: signing, verification, reports.

An event's hash is HMAC-SHA256 over the previous hash (32 zero bytes before the
first) and the event's line without its hash. Lines are taken as they are; the
hash is cut out of the text, never re-serialised.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hmac_sha256
from ..sources.audit_files import written
from .folds import walked

ZERO = "00" * 32
HASH_FIELD = r'"integrity_hash":"([0-9a-f]*)",?'


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines (chain, line_no, value) with sequence, integrity_hash (null if absent) and the canonical text."""
    found = F.regexp_extract(value, HASH_FIELD, 1)
    return lines.select(
        "chain",
        "line_no",
        F.try_variant_get(F.try_parse_json(F.col(value)), "$.sequence", "bigint").alias("sequence"),
        F.when(F.col(value).rlike(HASH_FIELD), found).alias("integrity_hash"),
        F.regexp_replace(value, HASH_FIELD, "").alias("canonical"),
    )


def sign(events: DataFrame, key: bytes) -> DataFrame:
    """Events (chain, sequence, canonical) with integrity_hash; sequential in each chain, so a walk over its sorted rows."""

    def step(prior: bytes, r) -> tuple[bytes, list[tuple]]:
        own = hmac.new(key, prior + r.canonical.encode(), hashlib.sha256).digest()
        return own, [(r.chain, r.sequence, r.canonical, own.hex())]

    wanted = events.select("chain", "sequence", "canonical")
    return walked(wanted, "chain", ("sequence",), lambda: bytes(32), step, "chain string, sequence long, canonical string, integrity_hash string")


def link_tests(lines: DataFrame, key: bytes) -> DataFrame:
    """Each line against the one before it, in parallel: failure is null, missing_hash, sequence or hash."""
    w = W.partitionBy("chain").orderBy("line_no")
    rows = parsed(lines).withColumn("prior", F.coalesce(F.lag("integrity_hash").over(w), F.lit(ZERO))).withColumn("place", F.lag("sequence").over(w))
    want = hmac_sha256(key, F.concat(F.unhex("prior"), F.encode("canonical", "UTF-8")))
    failure = F.when(F.col("integrity_hash").isNull(), "missing_hash").when(F.col("sequence") != F.coalesce(F.col("place") + 1, F.lit(0)), "sequence").when(F.col("integrity_hash") != want, "hash")
    return rows.select("chain", "line_no", "sequence", failure.alias("failure"))


def first_failures(lines: DataFrame, key: bytes) -> DataFrame:
    """(chain, line_no, failure) of the first bad line of each broken chain. Up to it all links hold, so pairs suffice."""
    bad = link_tests(lines, key).where("failure is not null")
    return bad.groupBy("chain").agg(F.min(F.struct("line_no", "failure")).alias("first")).select("chain", "first.line_no", "first.failure")


def all_failures(lines: DataFrame, key: bytes, skip_hashless: bool = False) -> DataFrame:
    """Every failure by the sequential rule: after a hash mismatch the last good hash stays; gaps in sequence are
    noted and the walk goes on. With ``skip_hashless`` lines without a hash are passed over and sequences not tested."""

    def step(state: tuple[bytes, int], r) -> tuple[tuple[bytes, int], list[tuple]]:
        prior, place = state
        if not r.integrity_hash:
            return state, [] if skip_hashless else [(r.chain, r.line_no, "missing_hash")]
        out = [(r.chain, r.line_no, "sequence")] if not skip_hashless and r.sequence != place + 1 else []
        want = hmac.new(key, prior + r.canonical.encode(), hashlib.sha256).digest()
        if want.hex() != r.integrity_hash:
            return (prior, r.sequence), [*out, (r.chain, r.line_no, "hash")]
        return (want, r.sequence), out

    return walked(parsed(lines), "chain", ("line_no",), lambda: (bytes(32), -1), step, "chain string, line_no long, failure string")


def _linked(lines: DataFrame, key: bytes) -> DataFrame:
    """Parsed lines with what the line with a hash before has (``before``, ``place``), and whether its hash fits that (``fits``).

    Lines are sorted in ranges; a range needs the last hash and sequence of those before it, one row a range.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.when(F.coalesce(F.col("integrity_hash"), F.lit("")) != "", F.struct(F.col("integrity_hash").alias("hash"), F.col("sequence").alias("place")))
    rows = parsed(lines).withColumn("own", hashed).repartitionByRange(parts, "chain", "line_no").withColumn("part", F.spark_partition_id())
    held = written(rows, "chain-ranges")
    earlier = W.partitionBy("chain", "part").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    ranges = held.groupBy("chain", "part").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("last"))
    before = W.partitionBy("chain").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.last("last", ignorenulls=True).over(before)).drop("last")
    found = held.withColumn("known", F.last("own", ignorenulls=True).over(earlier)).join(ranges, ["chain", "part"])
    prior = F.coalesce("known", "ahead", F.struct(F.lit(ZERO).alias("hash"), F.lit(-1).cast("long").alias("place")))
    found = found.withColumn("prior", prior).select("chain", "line_no", "sequence", "integrity_hash", "canonical", F.col("prior.hash").alias("before"), F.col("prior.place").alias("place"), F.col("own").isNotNull().alias("hashed"))
    return written(found.withColumn("fits", F.col("hashed") & (F.col("integrity_hash") == _mac(key, F.col("before")))), "chain-links")


def _mac(key: bytes, prior):
    return hmac_sha256(key, F.concat(F.unhex(prior), F.encode("canonical", "UTF-8")))


def failures_in_ranges(lines: DataFrame, key: bytes, skip_hashless: bool = False) -> DataFrame:
    """The failures of ``all_failures``, a chain being many tasks' work.

    As long as hashes fit, the last good hash is that of the line before, so
    pairs are tested. From a chain's first misfit on, the last good hash stays,
    and all later lines are tested against it at once; where one fits, pairs
    count again. A round finds one misfit and one such line of every chain;
    most broken chains have no line that fits again, and end in the first.
    Chains are named.
    """
    links = _linked(lines.where("chain is not null"), key)
    open_, wrong, first = None, [], True
    while True:
        rows = links.where("hashed") if first else links.where("hashed").join(open_, "chain").where("line_no > since")
        broken = rows.where("not fits").groupBy("chain").agg(F.min(F.struct("line_no", "before")).alias("at")).select("chain", F.col("at.line_no").alias("misfit"), F.col("at.before").alias("good"))
        broken = written(broken, "chain-misfits")
        if broken.isEmpty():
            break
        later = links.where("hashed").join(broken, "chain").where("line_no > misfit").withColumn("again", F.col("integrity_hash") == _mac(key, F.col("good")))
        later = written(later.select("chain", "line_no", "again"), "chain-later")
        since = written(later.where("again").groupBy("chain").agg(F.min("line_no").alias("since")), "chain-again")
        until = later.join(since, "chain", "left").where("since is null or line_no < since").select("chain", "line_no")
        wrong += [broken.select("chain", F.col("misfit").alias("line_no")), until]
        open_, first = since, False
        if since.isEmpty():
            break
    found = links.where("false").select("chain", "line_no", F.lit("hash").alias("failure"))
    for part in wrong:
        found = found.unionByName(part.withColumn("failure", F.lit("hash")))
    if not skip_hashless:
        found = found.unionByName(links.where("not hashed").select("chain", "line_no", F.lit("missing_hash").alias("failure")))
        found = found.unionByName(links.where("hashed").where(~F.col("sequence").eqNullSafe(F.col("place") + 1)).select("chain", "line_no", F.lit("sequence").alias("failure")))
    return found


def report(lines: DataFrame, failures: DataFrame) -> DataFrame:
    """By chain: events, failures, is_valid, failure_rate in percent."""
    counts = lines.groupBy("chain").agg(F.count("*").alias("events"))
    bad = failures.groupBy("chain").agg(F.count_distinct("line_no").alias("failures"))
    return counts.join(bad, "chain", "left").select("chain", "events", F.coalesce("failures", F.lit(0)).alias("failures"), F.col("failures").isNull().alias("is_valid"), F.round(F.coalesce("failures", F.lit(0)) / F.col("events") * 100.0, 6).alias("failure_rate"))

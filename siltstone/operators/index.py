"""The chunk index: locations, set operations, claims, sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.audit_files import fresh_folder

BLOOM_SEEDS = (17, 42)
#: A filter up to this size is sent to all tasks.
BROADCAST_BYTES = 32 << 20


def bulk_stats(locations: DataFrame, key: str = "content_id") -> DataFrame:
    """chunks, locations, deduped (locations beyond the first of a chunk), max and average locations."""
    per = locations.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").cast("long").alias("chunks"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("locations"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("deduped"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_locations"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 9).alias("avg_locations"),
    )


def index_counts(locations: DataFrame, key: str = "content_id") -> DataFrame:
    """distinct_hashes and total_entries of an index of sets of locations."""
    return locations.distinct().agg(F.count_distinct(key).cast("long").alias("distinct_hashes"), F.count("*").cast("long").alias("total_entries"))


def insert_set(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index and new locations as a set: the same location of a chunk is held once."""
    return index.unionByName(fresh).distinct()


def with_chunk(probe: DataFrame, index: DataFrame, key: str = "content_id") -> DataFrame:
    return probe.join(index.select(key), key, "left_semi")


def without_chunk(probe: DataFrame, index: DataFrame, key: str = "content_id") -> DataFrame:
    return probe.join(index.select(key), key, "left_anti")


def claims(arrivals: DataFrame, index: DataFrame, key: str = "content_id", order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Arrivals with ``claimed``: the first of a chunk that the index lacks; ``order`` tells all arrivals of a chunk apart."""
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    fresh = first.join(index.select(key).distinct(), key, "left_anti")
    return arrivals.join(fresh, key, "left").withColumn("claimed", F.struct(*order).eqNullSafe(F.col("__first"))).drop("__first")


def files_with_chunk(locations: DataFrame) -> DataFrame:
    """(content_id, file_id): the distinct files of every chunk."""
    return locations.select("content_id", "file_id").distinct()


def chunks_of_file(locations: DataFrame) -> DataFrame:
    """(file_id, chunks): how many distinct chunks every file has."""
    return locations.select("file_id", "content_id").distinct().groupBy("file_id").agg(F.count("*").alias("chunks"))


def preservation(before: DataFrame, after: DataFrame, key: str = "content_id") -> DataFrame:
    """How many distinct chunks of ``before`` are still in ``after``: originals, preserved, rate."""
    old = before.select(key).distinct()
    kept = old.join(after.select(key).distinct().withColumn("__kept", F.lit(1)), key, "left")
    return kept.agg(F.count("*").alias("originals"), F.count("__kept").alias("preserved")).withColumn("rate", F.when(F.col("originals") > 0, F.round(F.col("preserved") / F.col("originals"), 9)).otherwise(F.lit(1.0)))


def merged_universe(maps: DataFrame) -> DataFrame:
    """Chunk maps (map_id, path, content_id, ...) united: file_id from 1 in order of first registration; a path keeps its id.

    Registration order is (map_id, path).
    """
    first = maps.groupBy("path").agg(F.min("map_id").alias("first_map"))
    return maps.join(numbered(first, ["first_map", "path"], "file_id").select("path", "file_id"), "path")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their places, from 1, in ``order``: sorted in ranges, a range starts from the counts of those before it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_folder(spark, "numbered")
    rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    counts = held.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return held.join(F.broadcast(counts), "__part").withColumn(name, (F.col("__ahead") + place).cast("long")).drop("__part", "__ahead")


def bitmap_ranks(bits: DataFrame) -> DataFrame:
    """(window_id, pos, bit) with rank (ones before pos) and, on ones, their 0-based select index."""
    before = W.partitionBy("window_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rank = F.coalesce(F.sum(F.col("bit").cast("int")).over(before), F.lit(0)).cast("long")
    return bits.withColumn("rank", rank).withColumn("select_index", F.when(F.col("bit"), F.col("rank")))


#: Bits of a word of a bitmap; words have at most 63, so that they stay positive.
WORD_BITS, SUPER_WORDS = 60, 64


def rank_directory(bits: DataFrame) -> DataFrame:
    """(window_id, super, ahead, base, words): a bitmap (window_id, pos, bit) in packed words with the ones before each word.

    A super-block has ``SUPER_WORDS`` words of ``WORD_BITS`` positions; ``base``
    has the ones of the super-block before each word and ``ahead`` those of the
    window before the super-block. Only counts of super-blocks are summed in
    order, one row for some 4000 positions.
    """
    word = F.expr(f"pos div {WORD_BITS}").alias("word")
    packed = bits.where("bit").groupBy("window_id", word).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pos % {WORD_BITS}))")).alias("mask"))
    held = packed.groupBy("window_id", F.expr(f"word div {SUPER_WORDS}").alias("super")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % SUPER_WORDS).cast("int").alias("at"), "mask"))).alias("found"))
    words = F.transform(F.sequence(F.lit(0), F.lit(SUPER_WORDS - 1)), lambda i: F.coalesce(F.get(F.array(F.try_element_at("found", i)), F.lit(0)), F.lit(0).cast("long")))
    rows = held.select("window_id", "super", words.alias("words"))
    sums = F.aggregate("words", F.array(F.lit(0)), lambda a, w: F.array_append(a, F.element_at(a, -1) + F.bit_count(w)))
    before = W.partitionBy("window_id").orderBy("super").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("base", sums).withColumn("ones", F.element_at("base", -1))
    return rows.select("window_id", "super", F.coalesce(F.sum("ones").over(before), F.lit(0)).cast("long").alias("ahead"), "base", "words")


def ranks_at(probes: DataFrame, directory: DataFrame) -> DataFrame:
    """Probes (window_id, pos) with ``rank``, the ones before pos, and ``set``, whether pos has one: a join and two look-ups.

    Where a probe's super-block has no ones, the nearest before it counts.
    """
    size = WORD_BITS * SUPER_WORDS
    asked = probes.withColumn("super", F.expr(f"pos div {size}"))
    wanted = asked.select("window_id", "super").distinct().join(directory.select("window_id", "super", "ahead", "base", "words"), ["window_id", "super"], "full_outer")
    earlier = W.partitionBy("window_id").orderBy("super").rowsBetween(W.unboundedPreceding, 0)
    known = wanted.withColumn("upto", F.coalesce(F.last(F.col("ahead") + F.element_at("base", -1), ignorenulls=True).over(earlier), F.lit(0)))
    word = F.expr(f"int(pos div {WORD_BITS} % {SUPER_WORDS})")
    mask, shift = F.get("words", word), F.expr(f"int(pos % {WORD_BITS})")
    below = F.bit_count(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1))
    one = F.call_function("shiftright", mask, shift).bitwiseAND(F.lit(1).cast("long")) == 1
    found = asked.join(known, ["window_id", "super"])
    rank = F.when(F.col("words").isNull(), F.col("upto")).otherwise(F.col("ahead") + F.get("base", word) + below)
    return found.select(*probes.columns, rank.cast("long").alias("rank"), F.coalesce(one, F.lit(False)).alias("set"))


def window_progress(bits: DataFrame) -> DataFrame:
    """By window: total, completed, missing, next_missing (null when complete), percent (0 for an empty window)."""
    return bits.groupBy("window_id").agg(
        F.count("*").alias("total"),
        F.count_if("bit").alias("completed"),
        F.count_if(~F.col("bit")).alias("missing"),
        F.min(F.when(~F.col("bit"), F.col("pos"))).alias("next_missing"),
        F.round(F.coalesce(F.count_if("bit") / F.nullif(F.count("*"), F.lit(0)) * 100.0, F.lit(0.0)), 6).alias("percent"),
    )


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for ``n`` members at a false positive rate of ``p``."""
    m = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, math.ceil(m / max(1, n) * math.log(2)))


def bloom_positions(value: Column, m: int, k: int) -> Column:
    """The ``k`` bits of a value: h1 + i * h2 modulo ``m``."""
    h1 = F.pmod(F.xxhash64(F.lit(BLOOM_SEEDS[0]), value), F.lit(m))
    h2 = F.pmod(F.xxhash64(F.lit(BLOOM_SEEDS[1]), value), F.lit(m))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(m)))


def bloom_build(members: DataFrame, value: str, m: int, k: int) -> DataFrame:
    """The filter in words of 64 bits: (word, mask), words without a set bit left out."""
    bits = members.select(F.explode(bloom_positions(F.col(value), m, k)).alias("bit"))
    return bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("mask"))


def bloom_probe(probes: DataFrame, value: str, words: DataFrame, m: int, k: int) -> DataFrame:
    """Distinct probe values that may be members: all their bits are set.

    A filter of at most ``BROADCAST_BYTES`` goes to all tasks as one array of
    words; a larger one is joined by word.
    """
    asked = probes.select(value).distinct()
    has = lambda mask, p: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0
    if m // 8 <= BROADCAST_BYTES:
        dense = words.sparkSession.range(m // 64 + 1).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("mask", F.lit(0)).alias("mask"))
        bitmap = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "mask"))), lambda x: x["mask"]).alias("bitmap"))
        asked = asked.withColumn("bitmap", bitmap.scalar())
        return asked.where(F.forall(bloom_positions(F.col(value), m, k), lambda p: has(F.get("bitmap", F.floor(p / 64).cast("int")), p))).select(value)
    bits = asked.select(value, F.explode(F.array_distinct(bloom_positions(F.col(value), m, k))).alias("bit")).withColumn("word", F.expr("bit div 64"))
    seen = bits.join(words, "word", "left").groupBy(value).agg(F.bool_and(F.coalesce(has(F.col("mask"), F.col("bit")), F.lit(False))).alias("all"))
    return seen.where("all").select(value)


def bloom_rate(n: Column, m: int, k: int) -> Column:
    """The expected false positive rate after ``n`` insertions, repeats counted."""
    return F.pow(1 - F.exp(-F.lit(float(k)) * n / float(m)), F.lit(float(k)))

"""Operator 9: mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key from its id and text. Within its source
the key's leading digits name one of 4096 ranges; range totals are summed over
the ranges before a range, and a running sum inside each range gives every
document its place in the source's random order. The source's budget is cut
there exactly: whole epochs first, the rest from the start of the order. A
source that holds a third of all rows is spread over its 4096 ranges; rows
equal in id, text and source are one group with a count until the end, so many
of them make no large range.

Defined cases: a null text or one without words has size 0 and takes nothing;
a null source is a source of its own and comes last; null ids are ids like
others; equal rows are taken one after the other; an empty table gives an
empty result; columns beyond doc_id, text and source are not looked at by
``mix_plan``, and ``mixed_documents`` hands them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import WORD_CLASS, join_with_hot, materialise, text_of

#: Up to so many sources their table is broadcast, and ordered in one task; beyond, it is joined and ordered by shuffles.
BROADCAST_SOURCES = 10_000
RANGE_DIGITS = 3
#: Equal rows are numbered in so many groups.
SALTS = 64


def word_count(column: str | Column = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(f"{WORD_CLASS}+")).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """The hash-random key, in hexadecimal; equal only for rows of equal id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text))))


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], parts: int) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over all rows before in ``order``.

    The rows are range-sorted into ``parts``; a part starts from the totals of
    the parts before it, one row each.
    """
    held = materialise(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over one row a part
    totals = held.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = held.join(F.broadcast(totals), "__part")
    return found.select(*rows.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """From (source, source_size): source_id in code point order, weight, target, budget.

    The targets share the total by weight; one that passes ``max_epochs``
    times its source stops there and the excess is shared again. With the
    sources in the order in which they fill up, the common level is the
    largest of (total - caps before) / (weights from here on).
    """
    sizes = materialise(sizes.select("source", "source_size"), "mix-sources")
    counted = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()
    parts = 1 if counted["n"] <= BROADCAST_SOURCES else int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = (
        running_sums(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, parts)
        .withColumn("source_id", (F.col("place") + 1).cast("long"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .drop("place")
    )
    filled = materialise(running_sums(ranked, [F.col("fill"), F.col("source_id")], {"caps": F.col("cap"), "weights": F.col("weight")}, parts), "mix-levels")
    heavy = filled.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()["weights"]
    level = filled.agg(F.max((F.lit(float(counted["total"])) - F.col("caps")) / (F.lit(float(heavy)) - F.col("weights")))).first()[0]
    target = F.least(F.lit(level).cast("double") * F.col("weight"), F.col("cap").cast("double"))
    return filled.select("source", "source_id", "source_size", "weight", target.alias("target")).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def mix_groups(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per group of rows equal in id, text and source.

    ``n`` rows of ``size`` words; ``before`` is the number of words of the
    source's documents ahead of the first, ``epochs`` how often the whole
    source is taken, ``rest`` the words of the last, partial epoch.
    """
    keyed = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), mix_key(docs["doc_id"], docs["text"]).alias("key"))
    groups = materialise(keyed.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "mix-groups")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialise(source_targets(sizes, weights, max_epochs), "mix-targets")
    by_source = targets.withColumnRenamed("source", "named")
    by_source = F.broadcast(by_source) if targets.count() <= BROADCAST_SOURCES else by_source
    rows = groups.join(by_source, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    words = F.col("size") * F.col("n")
    ranges = rows.groupBy("source_id", "range").agg(F.sum(words).alias("range_size"))
    ahead = W.partitionBy("source_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source_id", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ranges_before"))
    inside = W.partitionBy("source_id", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(ranges, ["source_id", "range"]).withColumn("before", F.col("ranges_before") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    cut = placed.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    return cut.select("key", "doc_id", "source", "size", "n", "source_size", "target", "before", "epochs", "rest")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, before, epochs, rest, taken."""
    rows = mix_groups(docs, weights, max_epochs).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "before", "epochs", "rest", taken.cast("long").alias("taken"))


def _named(source: Column) -> Column:
    """A source as a key without nulls."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mixture as documents: a row for each time a document is taken, all columns kept.

    The document at a source's cut is kept whole. Documents without words are
    in no mixture. Of rows equal in id, text and source as many are taken as
    their words at the cut ask for.
    """
    groups = mix_groups(docs, weights, max_epochs).where("size > 0").where("epochs > 0 or before < rest")
    groups = groups.select(F.col("key").alias("mix_key"), _named(F.col("source")).alias("mix_source"), "n", "size", "before", "epochs", "rest")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"), mix_key(docs["doc_id"], docs["text"]).alias("mix_key"), _named(docs["source"]).alias("mix_source"))
    on = ["mix_key", "mix_source"]

    def copies(nth: Column) -> Column:
        return (F.col("epochs") + F.when(F.col("before") + nth * F.col("size") < F.col("rest"), 1).otherwise(0)).cast("int")

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.where("mix_copies > 0").select("document", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_epoch")).select("document.*")

    groups = materialise(groups, "mix-taken")
    taken = repeated(whole.join(groups.where("n = 1"), on).withColumn("mix_copies", copies(F.lit(0))))
    many = groups.where("n > 1")
    rows = many.agg(F.sum("n")).first()[0]
    if not rows:
        return taken
    # Equal rows are numbered: how many the salts before have, then the place within the salt.
    equal = materialise(join_with_hot(whole, many, on, "n", rows).withColumn("mix_salt", F.floor(F.rand(7) * SALTS)), "mix-equal")
    ahead = W.partitionBy(*on).orderBy("mix_salt").rowsBetween(W.unboundedPreceding, -1)
    salts = equal.groupBy(*on, "mix_salt").agg(F.count("*").alias("held"))
    salts = salts.select(*on, "mix_salt", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("salts_before"))
    inside = W.partitionBy(*on, "mix_salt").orderBy(F.lit(1))
    numbered = equal.join(salts, [*on, "mix_salt"]).withColumn("mix_nth", F.col("salts_before") + F.row_number().over(inside) - 1)
    return taken.unionByName(repeated(numbered.withColumn("mix_copies", copies(F.col("mix_nth")))))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB over whole ``documents``; the level is found by trying every source as the first that is not full.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_id FROM s),
w AS (SELECT *, [1, 2, 3][((source_id - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM r),
lv AS (SELECT max((t.total - t.before) / t.onward) AS level FROM (
  SELECT (SELECT sum(source_size) FROM s)::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         sum(weight) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS onward FROM w) t),
t AS (SELECT w.*, least(level * weight, cap::DOUBLE) AS target, floor(least(level * weight, cap::DOUBLE) + 0.5)::BIGINT AS budget FROM w, lv),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
             coalesce(sum(d.size) OVER (PARTITION BY t.source_id ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""

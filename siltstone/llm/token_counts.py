"""Operator 6: exact token-length histogram with suffix sums.

Documents are encoded once, in Arrow batches; only (length, documents) leaves a
batch. Spark adds the counts up, and suffix sums over the histogram answer
totals, quantiles and truncated totals for every context limit. The sums run
in blocks of 1024 lengths and then over the blocks, so no single task sees the
whole histogram.

Defined cases: a null or empty text has length 0; equal texts count each time;
an empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import documents, map_arrow, materialise, slices, text_of
from ._tokens import byte_encoder, vocabulary_path

BLOCK = 1024


def length_histogram(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, text: str = "text") -> DataFrame:
    """(length, documents): how many texts encode to so many ids."""
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(json_path, ranks_path).encode
        seen: dict[int, int] = {}
        for part in slices(batches, 0):
            for ids in encode(part.column(0).to_pylist()):
                seen[len(ids)] = seen.get(len(ids), 0) + 1
        if seen:
            yield pa.RecordBatch.from_pydict({"length": pa.array(seen.keys(), pa.int64()), "documents": pa.array(seen.values(), pa.int64())})

    counted = map_arrow(docs.select(text_of(text).alias("text")), count, "length long, documents long")
    return counted.groupBy("length").agg(F.sum("documents").alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for its length L taken as a context limit:

    documents_at_least, tokens_at_least: of documents of length L or more;
    tokens_if_truncated: the total when longer documents are cut at L;
    tokens_if_dropped: the total when longer documents are left out;
    share_within: the share of documents of at most L ids (the quantile rank of L).
    """
    block = F.floor(F.col("length") / BLOCK).alias("block")
    rows = histogram.select("length", "documents", (F.col("length") * F.col("documents")).alias("tokens"), block)
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("block_documents"), F.sum("tokens").alias("block_tokens"))
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_documents").over(later), F.lit(0)).alias("later_documents"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_documents").over(everything).alias("all_documents"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    summed = (
        rows.join(blocks, "block")
        .withColumn("documents_at_least", F.col("later_documents") + F.sum("documents").over(inside))
        .withColumn("tokens_at_least", F.col("later_tokens") + F.sum("tokens").over(inside))
    )
    longer = F.col("documents_at_least") - F.col("documents")
    return summed.select(
        "length",
        "documents",
        "tokens",
        "documents_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("documents_at_least")).alias("tokens_if_truncated"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("tokens")).alias("tokens_if_dropped"),
        ((F.col("all_documents") - longer) / F.col("all_documents")).alias("share_within"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens): the corpus total when every document is cut at ``context`` ids, for any limits.

    A limit between two lengths is answered from the next longer length:
    tokens below it plus the limit for each document at least that long.
    """
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])).alias("context")
    below = F.coalesce(F.sum(F.when(F.col("length") < F.col("context"), F.col("tokens"))), F.lit(0))
    above = F.coalesce(F.sum(F.when(F.col("length") >= F.col("context"), F.col("documents"))), F.lit(0))
    return sums.select("length", "documents", "tokens", asked).groupBy("context").agg((below + F.col("context") * above).cast("long").alias("tokens"))


def length_quantiles(sums: DataFrame, ranks: list[float]) -> DataFrame:
    """(rank, length): the least length within which a share of at least ``rank`` of the documents lies."""
    least = [F.min(F.when(F.col("share_within") >= r, F.col("length"))).alias(f"q{k}") for k, r in enumerate(ranks)]
    pairs = F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.col(f"q{k}").alias("length")) for k, r in enumerate(ranks)])
    return sums.agg(*least).select(F.explode(pairs).alias("answer")).select("answer.*")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    # written once: the suffix sums read the histogram twice, which would encode the corpus twice
    return suffix_sums(materialise(length_histogram(documents(spark, sf_dir)), "token-lengths"))


def brute_force(lengths: list[int]) -> dict[int, tuple]:
    """What ``suffix_sums`` must give, from plain lengths; for tests."""
    held = np.array(lengths)
    return {
        int(x): (int((held == x).sum()), int((held >= x).sum()), int(held[held >= x].sum()), int(np.minimum(held, x).sum()), int(held[held <= x].sum()), float((held <= x).mean()))
        for x in np.unique(held)
    }

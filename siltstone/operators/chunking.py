"""Chunking: fixed sizes in Catalyst expressions, content-defined cuts in Arrow batches; content identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import derived_table
from ..sources.audit_files import written
from . import spans
from .batches import record_batch, slices

GEAR = derived_table("gear") & 0xFFF  # no more bits are looked at


def content_id(data: Column) -> Column:
    """Lower-case SHA-256 of bytes."""
    return F.sha2(data, 256)


def fixed_chunks(files: DataFrame, size: int, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, chunk_index, offset, length, content_id) of chunks of ``size`` bytes; the last may be short.

    Empty and null contents have no chunks.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    held = files.where(F.length(content) > 0)
    starts = F.sequence(F.lit(0), F.length(content) - 1, F.lit(size))
    parts = held.select(key, content, F.posexplode(starts).alias("chunk_index", "start"))
    piece = F.substring(F.col(content), F.col("start") + 1, F.lit(size))
    return parts.select(
        key,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("start").cast("long").alias("offset"),
        F.length(piece).cast("long").alias("length"),
        content_id(piece).alias("content_id"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: file_id, path, content."""
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


# Content-defined chunking -------------------------------------------------------------------------

#: A byte is a cut candidate when the low bits of the rolling hash are under this; mask of at most 12 bits.
CUT_BELOW, MASK_BITS, REACH = 32, 12, 12


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in bytes: least < average < most, the average a power of two."""

    least: int = 8 * 1024
    average: int = 64 * 1024
    most: int = 256 * 1024

    def __post_init__(self) -> None:
        if not (0 < self.least < self.average < self.most) or self.average & (self.average - 1):
            raise ValueError("sizes must rise and the average be a power of two")

    @property
    def mask(self) -> int:
        return (1 << min(MASK_BITS, self.average.bit_length() - 1)) - 1


def cut_candidates(data: bytes, config: ChunkConfig, below: int = CUT_BELOW) -> np.ndarray:
    """Ends, in order, after which the hash of the last 12 bytes lets a chunk end; of the first 11 bytes as far as they go."""
    total = len(data)
    terms = GEAR[np.frombuffer(data, np.uint8)].astype(np.int64)
    sums = np.zeros(total, np.int64)
    for back in range(min(REACH, total)):
        sums[back:] += terms[: total - back] << back
    return np.flatnonzero((sums & config.mask) < below) + 1


def cut_points(data: bytes, config: ChunkConfig, below: int = CUT_BELOW) -> list[int]:
    """Chunk ends. The hash restarts with each chunk, but its tested bits depend on the last 12 bytes only, so for
    least sizes of 12 or more the candidates of the whole content are found at once; a short walk picks the cuts.
    The last bytes, once fewer than the largest chunk are left, are one chunk."""
    if config.least < REACH:
        raise ValueError(f"least sizes under {REACH} bytes are not supported")
    total, candidates = len(data), cut_candidates(data, config, below)
    ends, start = [], 0
    while total - start >= config.most:
        at = int(np.searchsorted(candidates, start + config.least))
        end = int(candidates[at]) if at < len(candidates) else total
        ends.append(min(end, start + config.most))
        start = ends[-1]
    if start < total:
        ends.append(total)
    return ends


def _chunk_rows(batches: Iterator[pa.RecordBatch], config: ChunkConfig, key: str) -> Iterator[pa.RecordBatch]:
    """Batches of chunks from batches (key, content), a slice of contents at a time."""
    for batch in slices(batches, 1):
        rows: list[tuple] = []
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = 0
            for i, end in enumerate(cut_points(data, config) if data else []):
                piece = data[start:end]
                rows.append((k, i, start, end - start, hashlib.sha256(piece).hexdigest(), not any(piece)))
                start = end
        yield record_batch(rows, {key: batch.column(0).type, "chunk_index": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "content_id": pa.string(), "is_zero": pa.bool_()})


def content_chunks(files: DataFrame, config: ChunkConfig = ChunkConfig(), key: str = "file_id", content: str = "content") -> DataFrame:  # noqa: B008
    """(key, chunk_index, offset, length, content_id, is_zero) of content-defined chunks; no rows for empty content.

    Arrow batches in, one row a chunk out; no shuffle.
    """
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(lambda batches: _chunk_rows(batches, config, key), f"`{key}` {kind}, chunk_index long, offset long, length long, content_id string, is_zero boolean")


def large_content_chunks(pieces: DataFrame, config: ChunkConfig = ChunkConfig(), key: str = "file_id", least_span: int = 1 << 20) -> DataFrame:  # noqa: B008
    """The rows of ``content_chunks`` for files given in pieces (key, offset, data), a file being many tasks' work.

    A span and the largest chunk after it have all that cuts which start in the
    span depend on, since no chunk is as short as the hash's reach. Null keys
    are left out.
    """
    if config.least < REACH:
        raise ValueError(f"least sizes under {REACH} bytes are not supported")
    pieces = pieces.where(F.col(key).isNotNull())
    size = max(least_span, 2 * config.most)
    kind = pieces.schema[key].dataType.simpleString()
    held = written(spans.spans_of(pieces, size, config.most, key), "chunk-spans")

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = np.arange(size)
        for frame in frames:
            rows = []
            for k, span, data in frame.itertuples(index=False):
                places = np.append(cut_candidates(data, config), size + 2 * config.most)
                ends = np.minimum(places[np.searchsorted(places, starts + config.least)], starts + config.most)
                rows.append((k, span, *spans.jump_table(ends, starts.copy(), size, config.most)))
            yield pd.DataFrame(rows, columns=[key, "span", "at", "leave", "last"])

    tables = written(held.select(key, "span", "data").mapInPandas(table, f"`{key}` {kind}, {spans.TABLE}"), "chunk-tables")
    total = pieces.groupBy(key).agg(F.max(F.col("offset") + F.length("data")).alias("total"))
    entered = spans.entries(tables, size, key).join(total, key)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, span, data, start, before, total in frame.itertuples(index=False):
                places, begin = cut_candidates(data, config), span * size
                # a chunk that starts here is one only if the file did not end with that before
                going = start < total and (start == 0 or total - before >= config.most)
                while going and start < begin + size:
                    end = total
                    if total - start >= config.most:
                        at = int(np.searchsorted(places, start - begin + config.least))
                        end = min(begin + int(places[at]) if at < len(places) else total, start + config.most)
                    piece = data[start - begin : end - begin]
                    rows.append((k, span, start, end - start, hashlib.sha256(piece).hexdigest(), not any(piece)))
                    going, start = end < total and total - start >= config.most, end
            yield pd.DataFrame(rows, columns=[key, "span", "offset", "length", "content_id", "is_zero"])

    placed = held.join(entered, [key, "span"]).select(key, "span", "data", "entry", "pending", "total")
    chunks = written(placed.mapInPandas(cut, f"`{key}` {kind}, span long, offset long, length long, content_id string, is_zero boolean"), "chunk-rows")
    ahead = W.partitionBy(key).orderBy("span").rowsBetween(W.unboundedPreceding, -1)  # one row a span
    counts = chunks.groupBy(key, "span").agg(F.count("*").alias("n")).select(key, "span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    place = F.row_number().over(W.partitionBy(key, "span").orderBy("offset")) - 1
    return chunks.join(counts, [key, "span"]).select(key, (F.col("ahead") + place).cast("long").alias("chunk_index"), "offset", "length", "content_id", "is_zero")


def is_zero(data: Column) -> Column:
    """All bytes are 0."""
    return F.hex(data).rlike("^(00)+$")


def sparse_stats(files: DataFrame, granularity: int = 1 << 20, mode: str = "auto", least: int = 64 * 1024, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, size, holes, bytes_saved, physical, density): zero chunks of ``granularity`` as holes.

    Holes count if the mode is always, or auto with files of at least ``least`` bytes; density is 1 for an empty file.
    """
    total = F.length(content).cast("long")
    enabled = F.lit(True) if mode == "always" else total >= least if mode == "auto" else F.lit(False)
    starts = F.when(total > 0, F.sequence(F.lit(0), F.length(content) - 1, F.lit(granularity))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.substring(F.col(content), s + 1, F.lit(granularity)))
    zeros = F.filter(pieces, is_zero)
    holes = F.when(enabled, F.size(zeros)).otherwise(0).cast("long")
    saved = F.when(enabled, F.aggregate(zeros, F.lit(0).cast("long"), lambda a, z: a + F.length(z))).otherwise(F.lit(0).cast("long"))
    rows = files.select(key, total.alias("size"), holes.alias("holes"), saved.alias("bytes_saved"))
    physical = F.col("size") - F.col("bytes_saved")
    return rows.withColumn("physical", physical).withColumn("density", F.when(F.col("size") > 0, F.round(physical / F.col("size"), 9)).otherwise(F.lit(1.0)))


def size_distribution(chunks: DataFrame) -> DataFrame:
    """chunks, least, most and mean length."""
    return chunks.agg(F.count("*").alias("chunks"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 6).alias("avg_length"))

"""Sequential choices along a large file, made by many tasks.

A file is cut into spans of equal size. What a walk does in a span depends only
on where it enters, so each span gives a jump table, found by pointer doubling
over its places: where the walk leaves, for every place it may enter at. The
tables, one row a span, are then followed in order to find where each span is
really entered, and each span makes its own choices from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces_of(files: DataFrame, size: int, key: str, content: str) -> DataFrame:
    """(key, offset, data): contents held in one value as pieces of ``size`` bytes."""
    held = files.where(F.length(content) > 0).select(key, content, F.explode(F.sequence(F.lit(0), F.length(content) - 1, F.lit(size))).alias("at"))
    return held.select(key, F.col("at").cast("long").alias("offset"), F.substring(F.col(content), F.col("at") + 1, F.lit(size)).alias("data"))


def spans_of(pieces: DataFrame, size: int, overlap: int, key: str) -> DataFrame:
    """(key, span, data): bytes from span * ``size`` on, ``size`` and ``overlap`` more of them, of files given in pieces (key, offset, data).

    Pieces touch each other and may have any size; a span is gathered from the
    few it meets, never from the whole file.
    """
    end = F.col("offset") + F.length("data")
    first = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0))
    held = pieces.where(F.length("data") > 0).withColumn("span", F.explode(F.sequence(first, F.floor((end - 1) / size))))
    begin = F.col("span") * size
    skipped = F.greatest(begin - F.col("offset"), F.lit(0))
    length = F.least(end, begin + size + overlap) - F.col("offset") - skipped
    parts = held.where(length > 0).select(key, "span", (F.col("offset") + skipped).alias("from"), F.substring(F.col("data"), (skipped + 1).cast("int"), length.cast("int")).alias("part"))
    gathered = parts.groupBy(key, "span").agg(F.array_sort(F.collect_list(F.struct("from", "part"))).alias("parts"), F.min("from").alias("least"))
    data = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["part"]).otherwise(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), "")))
    return gathered.where(F.col("least") < begin + size).select(key, "span", data.alias("data"))


def doubled(following: np.ndarray, length: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the walk leaves, where its last choice ends) for every place below ``length``, from the next place of each.

    ``last`` has the end of the choice made on the way to the next place, -1 for
    none. Rounds double the steps taken, so they are few.
    """
    at, held = following.copy(), last.copy()
    while True:
        inside = np.flatnonzero(at < length)
        if not len(inside):
            return at, held
        onward = at[inside]
        held[inside] = np.where(held[onward] >= 0, held[onward], held[inside])
        at[inside] = at[onward]


def jump_table(following: np.ndarray, last: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, leave, last): where the walk leaves a span entered at ``at`` or later, up to the next ``at``; entries are at most ``reach`` in."""
    leave, held = doubled(following, size, last)
    leave, held = leave[: reach + 1], held[: reach + 1]
    changes = np.flatnonzero(np.concatenate(([True], (leave[1:] != leave[:-1]) | (held[1:] != held[:-1]))))
    return changes, leave[changes], held[changes]


TABLE = "span long, at array<long>, leave array<long>, last array<long>"


def entries(tables: DataFrame, size: int, key: str) -> DataFrame:
    """(key, span, entry, pending): where the walk enters each span that has a table, and the ``last`` before, 0 at first.

    One row a span is followed in order; spans without a table are passed by.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, at, pending = None, 0, 0
        for frame in frames:
            out = []
            for k, span, places, leave, last in frame[[key, "span", "at", "leave", "last"]].itertuples(index=False):
                if k != name:
                    name, at, pending = k, 0, 0
                begin = span * size
                entry = max(at, begin)
                out.append((k, span, entry, pending))
                row = int(np.searchsorted(places, entry - begin, side="right")) - 1
                at = begin + int(leave[row])
                pending = begin + int(last[row]) if last[row] >= 0 else pending
            yield pd.DataFrame(out, columns=[key, "span", "entry", "pending"])

    kind = tables.schema[key].dataType.simpleString()
    ordered = tables.repartition(key).sortWithinPartitions(key, "span")
    return ordered.mapInPandas(walk, f"`{key}` {kind}, span long, entry long, pending long")

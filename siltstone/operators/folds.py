"""Sequential walks over each key's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def walked(rows: DataFrame, key: str, order: tuple[str, ...], begin: Callable, step: Callable, schema: str) -> DataFrame:
    """``step(state, row)`` gives (next state, rows made); ``begin()`` the state before a key's first row.

    A row needs the state after the one before, so one task walks a key, but as
    a stream of batches: the sort spills and no group is held in memory.
    """
    names = T.StructType.fromDDL(schema).names

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, started = None, None, False
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                name = None if pd.isna(row[0]) else row[0]
                if not started or name != at:
                    at, state, started = name, begin(), True
                state, made = step(state, row)
                out.extend(made)
            yield pd.DataFrame(out, columns=names)

    ordered = rows.select(key, *[c for c in rows.columns if c != key]).repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInPandas(walk, schema)

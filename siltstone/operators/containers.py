"""Packing chunks into containers of limited size, a sequential fold over each pool."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .folds import walked

HEADER = 16


def pack_containers(chunks: DataFrame, max_size: int) -> DataFrame:
    """(pool, ordinal, container_id, offset, length, error) for chunks (pool, ordinal, length) in order.

    Offsets start after a 16-byte header; a chunk that does not fit opens the
    next container; one that fits none opens it and is an error there.
    """

    def step(state: tuple[int, int], r) -> tuple[tuple[int, int], list[tuple]]:
        number, at = state
        if at + r.length > max_size:
            number, at = number + 1, HEADER
        name = f"container_{number:06d}"
        if at + r.length > max_size:
            return (number, at), [(r.pool, r.ordinal, name, -1, r.length, "too large")]
        return (number, at + r.length), [(r.pool, r.ordinal, name, at, r.length, None)]

    wanted = chunks.select("pool", "ordinal", "length")
    return walked(wanted, "pool", ("ordinal",), lambda: (0, HEADER), step, "pool string, ordinal long, container_id string, offset long, length long, error string")

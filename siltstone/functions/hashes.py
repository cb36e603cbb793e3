"""Byte hashes that Catalyst lacks, as Arrow functions over whole batches."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Unsigned Adler-32; null for null."""
    return data.map(lambda b: None if b is None else zlib.adler32(bytes(b))).astype("Int64")


def derived_table(label: str) -> np.ndarray:
    """256 unsigned 64-bit numbers from SHA-256 of the label and each index."""
    return np.array([int.from_bytes(hashlib.sha256(f"{label}:{i}".encode()).digest()[:8], "little") for i in range(256)], np.uint64)


BLOCK_TABLE = derived_table("block-hash")


def rotating_hash(data: bytes) -> int:
    """h = rotl(h, 1) ^ T[b] over a block: position j's term is rotated by what follows it."""
    terms = BLOCK_TABLE[np.frombuffer(data, np.uint8)]
    turns = (np.arange(len(terms))[::-1] % 64).astype(np.uint64)
    with np.errstate(over="ignore"):
        turned = np.where(turns == 0, terms, (terms << turns) | (terms >> ((np.uint64(64) - turns) % np.uint64(64))))
    return int(np.bitwise_xor.reduce(turned)) if len(terms) else 0

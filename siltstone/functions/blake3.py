"""BLAKE3, the public tree hash, by numpy over whole batches.

A content is cut into leaves of 1024 bytes; a leaf's chaining value comes from
its 64-byte blocks, a parent's from its two children; the last compression has
the root flag. All leaves of a batch advance together, then all parents of a
level. A large file is hashed by spans, which are whole subtrees, and the
subtrees' values are paired in groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash's definition: initial words, permutation of a block's words between rounds, flags, sizes.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
START, END, PARENT, ROOT = 1, 2, 4, 8
LEAF, BLOCK, ROUNDS = 1024, 64, 7

#: Leaves hashed together, 4 MB of them.
TOGETHER = 4096
#: Bytes of a span of a large file, and subtrees paired in one group; powers of two, so that each is a subtree.
SPAN, GROUP = 1 << 20, 1024


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values, of shape (8, n), of n blocks of 16 words."""
    n = chain.shape[1]
    a, b = chain[:4].copy(), chain[4:].copy()
    c = np.repeat(IV[:4, None], n, axis=1)
    d = np.stack([(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)])

    def mix(first: np.ndarray, second: np.ndarray) -> None:
        nonlocal a, b, c, d
        for more, turn_d, turn_b in ((first, 16, 12), (second, 8, 7)):
            a = a + b + more
            d = _turned(d ^ a, turn_d)
            c = c + d
            b = _turned(b ^ c, turn_b)

    for _ in range(ROUNDS):
        mix(words[0:8:2], words[1:8:2])
        b, c, d = (np.roll(x, -k, axis=0) for k, x in ((1, b), (2, c), (3, d)))  # columns become diagonals
        mix(words[8:16:2], words[9:16:2])
        b, c, d = (np.roll(x, k, axis=0) for k, x in ((1, b), (2, c), (3, d)))
        words = words[PERMUTATION]
    return np.concatenate((a ^ c, b ^ d))


def leaf_values(data: np.ndarray, lengths: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of leaves, rows of ``data`` filled up with 0; those ``alone`` are roots."""
    words = data.view("<u4").reshape(len(data), LEAF // BLOCK, 16)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    chain = np.repeat(IV[:, None], len(data), axis=1)
    for k in range(int(blocks.max(initial=0))):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = (START if k == 0 else 0) + np.where(last, END + np.where(alone[on], ROOT, 0), 0)
        chain[:, on] = compress(chain[:, on], words[on, k].T, counter[on], np.where(last, lengths[on] - BLOCK * k, BLOCK), flags)
    return chain


def paired(values: np.ndarray, owner: np.ndarray, root: bool | np.ndarray = True) -> np.ndarray:
    """One value (8, owners) for each run of equal owners, in order: neighbours are paired level by level, an odd one waits.

    The last pair of an owner is a root, where ``root`` is.
    """
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(starts, len(owner)))
    roots = np.broadcast_to(root, counts.shape)
    while counts.max(initial=1) > 1:
        within = np.arange(values.shape[1]) - np.repeat(starts, counts)
        held = np.repeat(counts, counts)
        left = np.flatnonzero((within % 2 == 0) & (within + 1 < held))
        flags = PARENT + np.where((held[left] == 2) & np.repeat(roots, counts)[left], ROOT, 0)
        zero = np.zeros(len(left), np.int64)
        merged = compress(np.repeat(IV[:, None], len(left), axis=1), np.concatenate((values[:, left], values[:, left + 1])), zero, zero + BLOCK, flags)
        values = values.copy()
        values[:, left] = merged
        values = values[:, within % 2 == 0]
        counts = -(-counts // 2)
        starts = np.cumsum(counts) - counts
    return values


def _leaves(content: bytes, first: int, alone: bool) -> np.ndarray:
    """Chaining values of a content whose first leaf has number ``first`` in its file, some leaves at a time."""
    out = []
    for at in range(0, max(1, len(content)), LEAF * TOGETHER):
        part = content[at : at + LEAF * TOGETHER]
        n = max(1, -(-len(part) // LEAF))
        data = np.frombuffer(part.ljust(n * LEAF, b"\0"), np.uint8).reshape(n, LEAF)
        lengths = np.full(n, LEAF)
        lengths[-1] = len(part) - LEAF * (n - 1)
        number = first + at // LEAF + np.arange(n)
        out.append(leaf_values(data, lengths, number, np.full(n, alone and len(content) <= LEAF)))
    return np.concatenate(out, axis=1)


def _named(values: np.ndarray) -> list[str]:
    return [v.astype("<u4").tobytes().hex() for v in values.T]


def hashes(contents: list[bytes]) -> list[str]:
    """Lower-case hexadecimal digests of 32 bytes; short contents are hashed together."""
    out: list[str] = []
    at = 0
    while at < len(contents):
        leaves, owner, size = [], [], 0
        data, lengths, number, alone = [], [], [], []
        start = at
        while at < len(contents) and (at == start or size + len(contents[at]) <= LEAF * TOGETHER):
            content = contents[at]
            n = max(1, -(-len(content) // LEAF))
            if n > TOGETHER:
                leaves.append(_leaves(content, 0, True))
                owner.append(np.full(n, at))
                at += 1
                break
            data.append(content.ljust(n * LEAF, b"\0"))
            own = np.full(n, LEAF)
            own[-1] = len(content) - LEAF * (n - 1)
            lengths.append(own)
            number.append(np.arange(n))
            alone.append(np.full(n, n == 1))
            owner.append(np.full(n, at))
            size += len(content)
            at += 1
        if data:
            held = np.frombuffer(b"".join(data), np.uint8).reshape(-1, LEAF)
            leaves.insert(0, leaf_values(held, np.concatenate(lengths), np.concatenate(number), np.concatenate(alone)))
        out += _named(paired(np.concatenate(leaves, axis=1), np.concatenate(owner)))
    return out


@F.pandas_udf(T.StringType())
def blake3(data: pd.Series) -> pd.Series:
    """BLAKE3 of bytes, lower-case hexadecimal; null for null."""
    known = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[known] = hashes([bytes(b) for b in data[known]])
    return out


def large_hashes(held: DataFrame, key: str) -> DataFrame:
    """(key, blake3) of files given as spans (key, span, data) of ``SPAN`` bytes, the last maybe shorter, a file being many tasks' work.

    A span is a subtree; values of ``GROUP`` neighbours are paired in one task,
    then those of ``GROUP`` groups, until a file has one. Empty files have no span.
    """
    kind = held.schema[key].dataType.simpleString()
    counts = held.groupBy(key).agg(F.count("*").alias("n"))

    def subtree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, span, data, n in frame.itertuples(index=False):
                leaves = _leaves(data, int(span) * (SPAN // LEAF), n == 1)
                rows.append((k, span, n, paired(leaves, np.zeros(leaves.shape[1]), n == 1)[:, 0].astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=[key, "span", "n", "value"])

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("span")
        values = np.frombuffer(b"".join(map(bytes, rows["value"])), "<u4").reshape(-1, 8).T.astype(np.uint32)
        n = int(rows["n"].iloc[0])
        made = paired(values, np.zeros(values.shape[1]), n <= GROUP)[:, 0]
        return pd.DataFrame({key: [rows[key].iloc[0]], "span": [rows["span"].iloc[0] // GROUP], "n": [-(-n // GROUP)], "value": [made.astype("<u4").tobytes()]})

    schema = f"`{key}` {kind}, span long, n long, value binary"
    values = held.join(counts, key).select(key, "span", "data", "n").mapInPandas(subtree, schema)
    most = counts.agg(F.max("n")).first()[0] or 0
    while most > 1:
        values = values.groupBy(key, F.floor(F.col("span") / GROUP).alias("group")).applyInPandas(pair, schema)
        most = -(-most // GROUP)
    return values.select(key, F.lower(F.hex("value")).alias("blake3"))

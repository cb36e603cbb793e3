"""Contents of files after a journal's replay: who wrote each byte last, and the bytes.

A journal's operations are laid over their files in blocks. In a block the
newest operation claims its bytes first, an older one what is left, so a block
is walked as a stream with one mask. Claims of parts of a block's operations can
be claimed from again, so a block with very many operations is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.audit_files import written

BLOCK = 64 * 1024
#: Operations of a block that one task takes in the first of two passes.
HOT = 10_000
#: The ordinal of files that were there before the replay, and of bytes that nothing wrote.
EXISTING, ZEROS = -1, -2

_PIECE = "path string, block long, ordinal long, step int, start int, length int, `from` long, data binary"


def steps(entries: DataFrame) -> DataFrame:
    """Entries (ordinal, path, op, data, size, ops array<struct<kind, length, data>>) as operations (path, ordinal, step, op, offset, data, size).

    An update's writes and copies follow each other from offset 0; its last step
    sets the size. A created file is its data, then cut or filled up to its
    size. Other entries than create_file, update_file and delete_file touch no bytes.
    A null size is the length of the data; a null data is empty.
    """
    base = entries.where(F.col("op").isin("create_file", "update_file", "delete_file") & F.col("path").isNotNull())
    empty = F.lit(b"")
    size = F.coalesce("size", F.length("data"), F.lit(0)).cast("long")
    whole = base.where("op != 'update_file'").select(
        "path", "ordinal", F.lit(0).alias("step"), "op", F.lit(0).cast("long").alias("offset"),
        F.when(F.col("op") == "create_file", F.coalesce("data", empty)).alias("data"), F.when(F.col("op") == "delete_file", F.lit(0).cast("long")).otherwise(size).alias("size"),
    )
    updates = base.where("op = 'update_file'")
    parts = updates.select("path", "ordinal", F.posexplode("ops").alias("step", "o"))
    long = F.when(F.col("o.kind") == "write_chunk", F.length(F.coalesce("o.data", empty))).otherwise(F.coalesce("o.length", F.lit(0)))
    before = W.partitionBy("ordinal", "path").orderBy("step").rowsBetween(W.unboundedPreceding, -1)  # an entry's operations
    parts = parts.withColumn("offset", F.coalesce(F.sum(long).over(before), F.lit(0)).cast("long"))
    writes = parts.where("o.kind = 'write_chunk'").select("path", "ordinal", "step", F.lit("write_chunk").alias("op"), "offset", F.coalesce("o.data", empty).alias("data"), F.lit(None).cast("long").alias("size"))
    sizes = updates.where("size is not null").select("path", "ordinal", F.coalesce(F.greatest(F.size("ops"), F.lit(0)), F.lit(0)).alias("step"), F.lit("set_size").alias("op"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("binary").alias("data"), F.col("size").cast("long"))
    return whole.unionByName(writes).unionByName(sizes)


def _sized(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are there at the end (path, final), and the operations since each file's last creation or deletion.

    Tables are written, so that the journal is read twice in all: for when files
    were last made anew, and for what counts since.
    """
    at = F.struct("ordinal", "step")
    last = operations.groupBy("path").agg(
        F.max(F.when(F.col("op").isin("create_file", "delete_file"), at)).alias("reset"),
        F.max(F.when(F.col("size").isNotNull(), F.struct("ordinal", "step", "size"))).alias("sizer"),
        F.max(F.struct("ordinal", "step", "op")).alias("newest"),
    ).where("newest.op != 'delete_file'").drop("newest")
    last = written(last, "journal-last")  # so that its size is known: a small one needs no shuffle of operations by path
    since = operations.withColumn("end", F.when(F.col("op") == "write_chunk", F.col("offset") + F.length("data")))
    since = written(since.join(last, "path").where(F.col("reset").isNull() | (at >= F.col("reset"))).drop("reset"), "journal")
    later = F.col("sizer").isNull() | (at > F.struct("sizer.ordinal", "sizer.step"))
    finals = since.groupBy("path").agg(F.greatest(F.coalesce(F.max(F.when(later, F.col("end"))), F.lit(0)), F.coalesce(F.max("sizer.size"), F.lit(0))).cast("long").alias("final"))
    return written(finals, "journal-files"), since.drop("sizer", "end")


def _over_blocks(rows: DataFrame, block: int, data: Column) -> DataFrame:
    """Rows (path, ordinal, step, low, high) below ``high``, cut at blocks."""
    rows = rows.where("low < high").withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    first = F.greatest("low", F.col("block") * block)
    length = F.least("high", (F.col("block") + 1) * block) - first
    rows = rows.select("path", "block", "ordinal", "step", first.alias("first"), length.alias("length"), (first - F.col("low")).alias("from"), data.alias("whole"))
    piece = F.substring("whole", (F.col("from") + 1).cast("int"), F.col("length").cast("int"))
    return rows.select("path", F.col("block").cast("long").alias("block"), "ordinal", "step", (F.col("first") - F.col("block") * block).cast("int").alias("start"), F.col("length").cast("int").alias("length"), F.col("from").cast("long").alias("from"), piece.alias("data"))


def pieces(operations: DataFrame, existing: DataFrame | None = None, block: int = BLOCK, content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files that are there at the end with their size, what operations put into which block of them).

    Each block has a piece of zeros older than all others. Without ``content`` no bytes are carried.
    """
    if existing is not None:
        old = existing.select("path", F.lit(EXISTING).cast("long").alias("ordinal"), F.lit(0).alias("step"), F.lit("create_file").alias("op"), F.lit(0).cast("long").alias("offset"), "data", F.length("data").cast("long").alias("size"))
        operations = operations.unionByName(old)
    finals, since = _sized(operations)
    both = since.join(finals, "path")
    nothing = F.lit(None).cast("binary")
    long = F.length("data")
    wrote = both.where("data is not null").withColumn("low", F.col("offset")).withColumn("high", F.least(F.col("offset") + long, F.col("final"), F.when(F.col("op") == "create_file", F.col("size")).otherwise(F.col("final"))))
    cut = both.where("op = 'set_size' and size < final").withColumn("low", F.col("size")).withColumn("high", F.col("final"))
    floor = finals.select("path", F.lit(ZEROS).cast("long").alias("ordinal"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("low"), F.col("final").alias("high"))
    made = _over_blocks(wrote, block, F.col("data") if content else nothing)
    return finals, made.unionByName(_over_blocks(cut, block, nothing)).unionByName(_over_blocks(floor, block, nothing))


def _claim(frames: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    at, taken, left = None, None, 0
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if (r[0], r[1], r[-1]) != at:
                at, taken, left = (r[0], r[1], r[-1]), np.zeros(block, bool), block
            if not left:
                continue
            free = np.flatnonzero(~taken[r[4] : r[4] + r[5]])
            if not len(free):
                continue
            taken[r[4] : r[4] + r[5]] = True
            left -= len(free)
            breaks = np.flatnonzero(np.diff(free) > 1)
            for a, b in zip(free[np.r_[0, breaks + 1]], free[np.r_[breaks, len(free) - 1]], strict=True):
                a, n = int(a), int(b - a) + 1
                out.append((r[0], r[1], r[2], r[3], r[4] + a, n, r[6] + a, None if r[7] is None else r[7][a : a + n]))
        if out:
            yield pd.DataFrame(out, columns=["path", "block", "ordinal", "step", "start", "length", "from", "data"])


def _claimed(rows: DataFrame, block: int) -> DataFrame:
    """What is left of pieces (path, block, ..., slice) when newer ones of their block and slice have claimed theirs."""
    ordered = rows.repartition("path", "block", "slice").sortWithinPartitions("path", "block", "slice", F.desc("ordinal"), F.desc("step"))
    return ordered.mapInPandas(lambda frames: _claim(frames, block), _PIECE)


def _resolved(made: DataFrame, block: int, hot: int) -> DataFrame:
    """Pieces as they stand at the end. Those under a newer piece of the whole block go first; of hot blocks, slices are claimed first."""
    at = F.struct("ordinal", "step")
    counts = made.groupBy("path", "block").agg(F.count("*").alias("n"), F.max(F.when((F.col("start") == 0) & (F.col("length") == block), at)).alias("whole"))
    counts = written(counts, "journal-blocks")
    rows = made.join(counts, ["path", "block"]).where(F.col("whole").isNull() | (at >= F.col("whole")))
    if not counts.where(F.col("n") > hot).isEmpty():
        sliced = rows.where(F.col("n") > hot).withColumn("slice", F.pmod(F.xxhash64("ordinal", "step"), F.ceil(F.col("n") / hot)))
        rows = rows.where(F.col("n") <= hot).select(*made.columns).unionByName(_claimed(sliced.select(*made.columns, "slice"), block))
    return _claimed(rows.select(*made.columns).withColumn("slice", F.lit(0)), block)


def extents(operations: DataFrame, existing: DataFrame | None = None, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(path, offset, length, ordinal, step, from): which operation wrote a file's bytes last, and from which place of its data.

    Extents end at blocks. Ordinal -1 is the file before the replay, -2 bytes
    that nothing wrote; a step that sets a smaller size writes zeros from there
    on, if the file grows again. Files that are empty or gone have no extents.
    Copies leave bytes as they are, and are taken to be verified.
    """
    _, made = pieces(operations, existing, block, content=False)
    return _resolved(made, block, hot).select("path", (F.col("block") * block + F.col("start")).alias("offset"), F.col("length").cast("long").alias("length"), "ordinal", "step", "from")


def blocks(operations: DataFrame, existing: DataFrame | None = None, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(path, block, data): the files' bytes at the end, by block."""
    return _assembled(pieces(operations, existing, block)[1], block, hot)


def _assembled(made: DataFrame, block: int, hot: int) -> DataFrame:
    bytes_of = F.coalesce("data", F.unhex(F.repeat(F.lit("00"), F.col("length"))))
    held = _resolved(made, block, hot).groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("start", bytes_of.alias("data")))).alias("parts"))  # at most a block's bytes
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return held.select("path", "block", joined.alias("data"))


def contents(operations: DataFrame, existing: DataFrame | None = None, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(path, size, blocks, digest) of files that are there at the end: SHA-256 over the SHA-256 digests of the blocks, as hex, in order."""
    finals, made = pieces(operations, existing, block)
    hashed = _assembled(made, block, hot).select("path", "block", F.sha2("data", 256).alias("own"))
    roots = hashed.groupBy("path").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("block", "own"))).alias("all"))  # 64 hex digits a block
    digest = F.sha2(F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<block:bigint,own:string>>")), lambda p: p["own"]), ""), 256)
    return finals.join(roots, "path", "left").select("path", F.col("final").alias("size"), F.coalesce("blocks", F.lit(0)).alias("blocks"), digest.alias("digest"))

"""Operator 3: placing documents on shards by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size,
(offset + j * skip) mod size. The shards take turns; at its turn a shard claims
its next free slot. The filled table is broadcast (its size is the parameter
``slots``, so it is bounded) and a document is placed by one lookup of its
key's hash. Taking a shard away moves few other keys.

Defined cases: a null key hashes as the empty string; equal keys go to the same
slot; an empty table gives an empty result; other columns are kept by
``place`` and its two new columns replace columns of the same names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
#: A prime over 100 times the number of shards keeps shares within a percent.
SLOTS = 4099


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's index in every slot; ``slots`` claims, made in turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        table[at[i]] = i
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the first 60 bits of the key's md5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; one broadcast join of ``slots`` rows, no shuffle."""
    table = lookup_table(shards, slots)
    filled = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("__slot", "__index"))
    named = filled.select("__slot", F.element_at(F.array(*map(F.lit, shards)), F.col("__index").cast("int") + 1).alias("__shard"))
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("slot", "shard")]
    rows = docs.select(*kept, slot_of(docs[f"`{key}`"], slots).alias("slot"))
    return rows.join(F.broadcast(named), F.col("slot") == F.col("__slot")).drop("__slot").withColumnRenamed("__shard", "shard")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id", "source", "n_chars"))


#: The same turns as a recursive query: one claim a step.
SQL = f"""
WITH RECURSIVE k AS (
  SELECT i, ('0x' || substr(md5('offset:' || n), 1, 15))::BIGINT % {SLOTS} AS off,
         ('0x' || substr(md5('skip:' || n), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS n FROM range({len(SHARDS)}) t(i))),
q AS (SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM k),
c(turn, slot, used, nxt) AS (
  SELECT 0, -1::BIGINT, list_transform(range({SLOTS}), lambda x: false), list_transform(range({len(SHARDS)}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT turn + 1, (offs[s] + j * skips[s]) % {SLOTS},
         list_concat(list_concat(used[1:((offs[s] + j * skips[s]) % {SLOTS})], [true]), used[((offs[s] + j * skips[s]) % {SLOTS}) + 2:]),
         list_concat(list_concat(nxt[1:s - 1], [j + 1]), nxt[s + 1:])
  FROM (SELECT *, (SELECT min(x) FROM (SELECT unnest(range(nxt[s], {SLOTS})) AS x) WHERE NOT used[((offs[s] + x * skips[s]) % {SLOTS}) + 1]) AS j
        FROM (SELECT c.*, q.*, (turn % {len(SHARDS)}) + 1 AS s FROM c, q) WHERE turn < {SLOTS})),
t AS (SELECT slot, 'shard-' || lpad(((turn - 1) % {len(SHARDS)})::VARCHAR, 2, '0') AS shard FROM c WHERE turn > 0)
SELECT doc_id, source, n_chars, t.slot::INT AS slot, shard
FROM documents JOIN t ON t.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS}
"""

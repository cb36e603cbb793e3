"""Operator 2: exact deduplication by an extendible-hash index on shared files.

1. Every scan task normalises its texts and merges its own copies by comparing
   bytes: it remembers the texts it met last, and those met again stay longest,
   so a text that many of its rows share makes one entry. The entries (63-bit
   hash, text, size of the group) are written to shared files; how many rows an
   entry gained later, and the best of them, follows in a supplement.
2. From the hashes the directory is built: a bucket with more hash values than
   its capacity is split on the next bit, as deep as it takes, and the directory
   doubles when a bucket as deep as the directory splits. Equal hash values
   cannot be split and count once: they become a chain.
3. The entries of a hash value that has many, as a text that all tasks share,
   are merged in salted groups first.
4. Owner tasks take whole buckets, which are ranges of keys. An owner streams its
   entries in hash order; entries of equal hash are chained and told apart by
   their bytes. Only the distinct texts of one hash value, and the numbers of
   their entries, are in memory.
5. Owners' answers go back to the rows by the entry they belong to.

Texts are equal when identical after replacing each run of the characters
space, \\t, \\n, \\v, \\f, \\r by one space. Defined cases: null counts as the
empty text; empty texts are equal to each other; null ids come after all
others when the row that stays is chosen; of rows with equal id and text one
stays; an empty table gives an empty result; other columns, whatever their
names, are handed through by ``deduplicated`` and not read by ``duplicate_groups``.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import HOT_KEYS, documents, materialise, slices

#: Hash values a bucket may hold before it is split.
CAPACITY = 4096
#: A directory of up to so many slots (24 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SLOTS = 1 << 16
#: Bytes of text that a scan task takes at once, and those it remembers.
COMBINE_BYTES, MEMORY_BYTES = 8 << 20, 24 << 20
#: From so many entries on a hash value with a thousandth of all entries is merged in salted groups first.
MANY = 64
SPACES = b" \t\n\x0b\x0c\r"
INF = 1 << 62


def normalise(data: bytes) -> bytes:
    """Each run of white space as one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[0] in SPACES else b"") + b" ".join(words) + (b" " if data[-1] in SPACES else b"")


def hash64(data: bytes, bits: int = 63) -> int:
    """The index's key: 63 bits, so that a signed column keeps the order of the bits; with fewer ``bits`` the rest are 0."""
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "big") >> (64 - bits) << (63 - bits)


def _rank(key: int | None, row: int) -> tuple[int, int]:
    return (INF if key is None else key, row)


class _Known:
    """An entry that a scan task remembers: what its later rows add."""

    __slots__ = ("text", "entry", "hash", "best", "gained", "document")

    def __init__(self, text: bytes, entry: int, hash_: int, best: tuple[int, int]):
        self.text, self.entry, self.hash, self.best, self.gained, self.document = text, entry, hash_, best, 0, None


def _entries(docs: DataFrame, carry: bool, hash_bits: int) -> DataFrame:
    """Rows (row, entry, hash, id, best, size, text, document), merged within each scan task.

    A row has its entry's number. The first best row of an entry has its hash
    and size and carries the normalised text, or with ``carry`` its whole
    document. Supplements have no row of their own: ``size`` is what the entry
    gained, ``id`` and ``best`` are the best of the gained rows, which is
    carried only if it is better than the entry's.
    """
    wanted = F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if carry else F.struct(docs["text"])
    source = docs.select(docs["doc_id"].cast("long").alias("id"), wanted.alias("document"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        known: OrderedDict[int, _Known] = OrderedDict()
        held, kind, closed = 0, None, []

        def batch(columns: list, document: pa.Array) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [document], names=["row", "entry", "hash", "id", "best", "size", "text", "document"])

        def supplements() -> pa.RecordBatch:
            rows = [(None, k.entry, k.hash, None if k.best[0] == INF else k.best[0], k.best[1], k.gained, None) for k in closed]
            document = pa.concat_arrays([pa.nulls(1, kind) if k.document is None else k.document for k in closed])
            closed.clear()
            return batch(list(zip(*rows, strict=True)), document)

        for part in slices(batches, lambda b: b.column(1).field("text"), COMBINE_BYTES):
            ids, document = part.column(0).to_pylist(), part.column(1)
            n, kind = len(ids), document.type
            groups: dict[bytes, list[int]] = {}
            for i, text in enumerate(document.field("text").cast(pa.binary()).to_pylist()):
                groups.setdefault(normalise(text or b""), []).append(i)
            entry, size = [0] * n, [None] * n
            texts, hashes = [None] * n, [None] * n
            for text, rows in groups.items():
                best = min(rows, key=lambda i: _rank(ids[i], i)) if len(rows) > 1 else rows[0]
                h = hash64(text, hash_bits)
                old = known.get(h)
                if old is not None and old.text == text:
                    known.move_to_end(h)
                    old.gained += len(rows)
                    rank = _rank(ids[best], number + best)
                    if rank < old.best:
                        old.best = rank
                        old.document = document.take(pa.array([best])) if carry else None
                else:
                    size[best], hashes[best] = len(rows), h
                    texts[best] = None if carry else text
                    if old is None:
                        old = known[h] = _Known(text, number + best, h, _rank(ids[best], number + best))
                        held += len(text) + 300
                    else:
                        old = _Known(text, number + best, h, (0, 0))  # another text of this hash is remembered
                for i in rows:
                    entry[i] = old.entry
            carried = document.take(pa.array([i if s and carry else None for i, s in enumerate(size)], pa.int64()))
            numbers = range(number, number + n)
            yield batch([numbers, entry, hashes, ids, numbers, size, texts], carried)
            number += n
            while held > MEMORY_BYTES and len(known) > 1:
                _, old = known.popitem(last=False)
                held -= len(old.text) + 300
                if old.gained:
                    closed.append(old)
            if len(closed) >= 1000:
                yield supplements()
        closed += [k for k in known.values() if k.gained]
        if closed:
            yield supplements()

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("row", "entry", "hash", "id", "best", "size")] + [T.StructField("text", T.BinaryType()), T.StructField("document", source.schema["document"].dataType)])
    return source.mapInArrow(combine, schema)


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of every slot, written to the shared folder, and the global depth.

    ``hashes`` has each hash value once. A bucket of depth d is a prefix of d
    bits; it is split while it holds more than ``capacity`` hash values, so
    those above the capacity, counted at every depth, are the inner nodes of
    the tree that splitting grows, and their other children are the buckets.
    A bucket is named by its first slot.
    """
    spark = hashes.sparkSession
    finest = min(63, max(0, math.ceil(math.log2(max(1, hashes.count()) / capacity))) + 4)
    while True:
        counts = materialise(hashes.groupBy(F.shiftright("hash", 63 - finest).alias("prefix")).agg(F.count("*").alias("n")), "dedup-prefixes")
        if finest == 63 or not counts.where(F.col("n") > capacity).limit(1).count():
            break
        finest = min(63, finest + 8)
    levels = counts.select("n", F.posexplode(F.expr(f"transform(sequence(0, {finest}), d -> shiftright(prefix, {finest} - d))")).alias("depth", "prefix"))
    inner = materialise(levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select("depth", "prefix"), "dedup-splits")
    deepest = inner.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([(0, 0, 0)], "slot long, bucket long, depth int"), 0
    depth = deepest + 1
    children = inner.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    leaves = children.join(inner, ["depth", "prefix"], "left_anti")
    first, end = (F.expr(f"shiftleft(prefix + {k}, {depth} - depth)") for k in (0, 1))
    return materialise(leaves.select(F.explode(F.sequence(first, end - 1)).alias("slot"), first.alias("bucket"), "depth"), "dedup-directory"), depth


def _merge(records: DataFrame, carry: bool, last: bool) -> DataFrame:
    """Records, sorted by hash, salt and entry within partitions, merged by hash, salt and text; the salt falls away.

    When ``last``, the text's SHA-256 in hexadecimal stands in place of the
    text. Supplements (``extra``) follow their entry.
    """
    plain = ["hash", "entry", "extra", "members", "id", "best", "size"]
    held_in = "document" if carry else "text"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain, newest = None, [], None  # chain: [text, members, size, best, document] of the current hash and salt
        out: list[tuple] = []
        heavy = 0

        def made() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            *rows, held = zip(*out, strict=True)
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            columns.append(pa.concat_arrays(held) if carry else pa.array(held, pa.string() if last else pa.binary()))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*plain, held_in])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal heavy
            for text, members, size, best, document in chain:
                held = document if carry else hashlib.sha256(text).hexdigest() if last else text
                out.append((current[0], members[0], False, members, None if best[0] == INF else best[0], best[1], size, held))
                heavy += document.nbytes if carry else 0 if last else len(text)
                if len(out) >= 2000 or heavy > 4 << 20:
                    yield made()
                    heavy = 0

        for part in slices(batches, (lambda b: b.column(8).field("text")) if carry else 8):
            hashes, entries, extras, members, ids, bests, sizes, salts = (part.column(k).to_pylist() for k in range(8))
            held = part.column(8)
            texts = [t and normalise(t) for t in held.field("text").cast(pa.binary()).to_pylist()] if carry else held.to_pylist()
            for i, key in enumerate(zip(hashes, salts, strict=True)):
                if key != current:
                    yield from close()
                    current, chain = key, []
                rank = _rank(ids[i], bests[i])
                if not extras[i]:
                    text = texts[i] or b""
                    newest = next((x for x in chain if x[0] == text), None)
                    if newest is None:
                        newest = [text, array("q", members[i]), sizes[i], rank, held.slice(i, 1) if carry else None]
                        chain.append(newest)
                        continue
                    newest[1].extend(members[i])
                newest[2] += sizes[i]
                if rank < newest[3]:
                    newest[3] = rank
                    newest[4] = held.slice(i, 1) if carry else None
        yield from close()
        if out:
            yield made()

    kept = records.select(*plain, "salt", held_in)
    fields = [kept.schema[c] for c in plain] + [T.StructField("text", T.StringType()) if last and not carry else kept.schema[held_in]]
    return kept.mapInArrow(merge, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def build_index(docs: DataFrame, capacity: int = CAPACITY, carry: bool = False, hash_bits: int = 63) -> tuple[DataFrame, DataFrame]:
    """(entries, index) on shared files: what scan tasks wrote, and its records with the bucket the directory gives them."""
    entries = materialise(_entries(docs, carry, hash_bits), "dedup-entries")
    lone = F.col("row").isNull()
    records = entries.where("hash is not null").select(
        "hash", "entry", lone.alias("extra"), F.when(lone, F.array().cast("array<bigint>")).otherwise(F.array("entry")).alias("members"), "id", "best", "size", "document" if carry else "text"
    )
    hashes = materialise(records.groupBy("hash").agg(F.count("*").alias("n")), "dedup-hashes")
    total = hashes.agg(F.sum("n")).first()[0] or 0
    often = hashes.where(F.col("n") > max(MANY, total / HOT_KEYS)).select("hash", F.ceil(F.sqrt("n")).alias("salts"))
    if often.limit(1).count():
        often = F.broadcast(often)  # fewer than HOT_KEYS rows, each with more than a thousandth of all entries
        salted = records.join(often, "hash").withColumn("salt", F.pmod(F.xxhash64("entry"), "salts"))
        dealt = salted.repartition(_parts(docs), "hash", "salt").sortWithinPartitions("hash", "salt", "entry", "extra")
        records = records.join(often, "hash", "left_anti").unionByName(_merge(dealt, carry, last=False))
    slots, depth = directory(hashes, capacity)
    slots = F.broadcast(slots) if 1 << depth <= BROADCAST_SLOTS else slots
    return entries, records.withColumn("slot", F.shiftright("hash", 63 - depth)).join(slots, "slot").drop("slot")


def _parts(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _owners(index: DataFrame, carry: bool) -> DataFrame:
    """One row per distinct text: members, id and best of the row that stays, size, and the text's SHA-256 or that row's document."""
    dealt = index.repartition(_parts(index), "bucket").sortWithinPartitions("bucket", "hash", "entry", "extra")
    return _merge(dealt.withColumn("salt", F.lit(0).cast("long")), carry, last=True)


def duplicate_groups(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 63) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Fewer ``hash_bits`` only lengthen chains."""
    entries, index = build_index(docs, capacity, hash_bits=hash_bits)
    owned = _owners(index, carry=False).select(F.explode("members").alias("entry"), F.col("best").alias("keep_row"), F.col("id").alias("keep_id"), F.col("size").alias("group_size"), F.col("text").alias("text_sha256"))
    rows = entries.where("row is not null").select("row", "entry", F.col("id").alias("doc_id"))
    return rows.join(owned, "entry").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, all columns kept; one shuffle of the merged texts."""
    return _owners(build_index(docs, capacity, carry=True)[1], carry=True).select("document.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, t, sha256(t) AS text_sha256, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place FROM n)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       place = 1 AS kept, text_sha256 FROM h
"""

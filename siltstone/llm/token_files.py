"""Operator 4: token-id files with Re-Pair grammar compression and random-access decoding.

Documents are sorted by id over range partitions, encoded, and written in
shards of about ``SHARD_TOKENS`` ids. In each shard frequent pairs of ids are
replaced by nonterminals, again and again until no pair is worth a rule; the
pairs of one round are chosen so that no two replacements can overlap, which
lets a round be a few numpy operations. A shard holds its rules with their
expansion lengths, the symbols, and where each document's symbols begin, so a
document, or a range of its ids, is decoded without the rest. Pairs never run
across two documents.

A rule takes two symbols and an expansion length, a replacement saves one
symbol, so a pair that occurs fewer than ``LEAST`` times saves nothing.

A shard's bytes are a row of a Parquet table in the shared folder: Spark's
commit protocol makes the files whole when an executor is lost.

Shard layout, little-endian: magic ``RPS2``; unsigned 32-bit documents, rules,
symbols, first nonterminal, bits of a symbol and bytes of an expansion length;
the rules' pairs as packed symbols, their expansion lengths; for each document
the number of its symbols and of its ids (unsigned 32-bit); the packed symbols;
last the crc32 of all before.

Defined cases: a null or empty text is the end id alone; null ids come first;
rows with equal ids are ordered by a hash of their texts; repeated rows are
written each time; an empty table gives no shards and an empty result; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialise, slices, text_of
from ._tokens import encoder, vocabulary_path

END_ID = 1
SHARD_TOKENS = 1 << 20
#: The least count of a pair that is replaced; the first rounds take more frequent pairs only.
LEAST = 4
FIRST = (64, 16)
#: Up to so many shards their starts are broadcast; beyond, they are joined by shuffle.
BROADCAST_SHARDS = 500_000
MAGIC = b"RPS2"


def choose_pairs(keys: np.ndarray, counts: np.ndarray, least: int, bits: int) -> list[int]:
    """Frequent pairs, the most frequent first, such that no id is the left of one and the right of another."""
    frequent = np.flatnonzero(counts >= least)
    order = frequent[np.lexsort((keys[frequent], -counts[frequent]))]
    asked, lefts, rights, chosen = keys[order], set(), set(), []
    for key, a, b in zip(asked.tolist(), (asked >> bits).tolist(), (asked & ((1 << bits) - 1)).tolist(), strict=True):
        if a in rights or b in lefts or (a == b and (a in lefts or a in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(key)
    return chosen


def _sorted_pairs(left: np.ndarray, right: np.ndarray, bits: int, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted pairs as numbers, their places), without those skipped: one plain sort of pair and place together where both fit 63 bits."""
    keys, last = left.astype(np.int64) << bits | right, np.iinfo(np.int64).max  # no pair is that large
    low, n = len(keys).bit_length(), len(keys) - len(skipped)
    if 2 * bits + low > 63:
        keys[skipped] = last
        order = np.argsort(keys)[:n]
        return keys[order], order
    both = keys << low | np.arange(len(keys))
    both[skipped] = last
    both.sort()
    return both[:n] >> low, both[:n] & ((1 << low) - 1)


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules): the grammar of documents' ids laid end to end.

    No pair is left that occurs ``least`` times. A pair is one number; of a run
    of equal ids every second place counts, as only those can be replaced. A
    round looks only at places that can still matter (``live``): a pair without
    a new symbol never becomes more frequent.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    live = np.ones(len(ids), bool)
    rules: list[np.ndarray] = []
    fresh, thresholds = base, [t for t in FIRST if t > least]
    while len(symbols) > 1:
        bits = fresh.bit_length()
        asked = np.flatnonzero(live[:-1] & ~last[:-1])
        left, right = symbols[asked], symbols[asked + 1]
        skipped = np.zeros(0, np.int64)
        same = np.flatnonzero(left == right)
        if len(same):
            at = asked[same]
            opens = np.concatenate(([True], np.diff(at) > 1))
            skipped = same[(at - at[opens][np.cumsum(opens) - 1]) % 2 == 1]
        inside, order = _sorted_pairs(left, right, bits, skipped)
        odd = asked[skipped]
        edges = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1]))) if len(inside) else np.zeros(0, np.int64)
        known, counts = inside[edges], np.diff(np.concatenate((edges, [len(inside)])))
        bound = thresholds.pop(0) if thresholds else least
        chosen = choose_pairs(known, counts, bound, bits)
        if not chosen:
            if bound == least:
                break
            continue
        pairs = np.array(chosen, np.int64)
        replaced = np.searchsorted(known, pairs)
        n = counts[replaced]
        ends = np.cumsum(n)
        places = asked[order[np.repeat(edges[replaced] - (ends - n), n) + np.arange(ends[-1])]]
        rare = edges[counts < least]
        few = counts[counts < least]
        for k in range(least - 1):
            live[asked[order[rare[few > k] + k]]] = False
        live[odd] = True
        live[places] = True
        live[np.maximum(places, 1) - 1] = True
        symbols[places] = np.repeat(np.arange(fresh, fresh + len(pairs), dtype=np.uint32), n)
        last[places] = last[places + 1]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        kept = np.flatnonzero(keep)
        symbols, last, live = symbols.take(kept), last.take(kept), live.take(kept)
        rules.append(np.stack((pairs >> bits, pairs & ((1 << bits) - 1)), axis=1))
        fresh += len(pairs)
    ends = np.flatnonzero(last) + 1
    grammar = np.concatenate(rules).astype("<u4") if rules else np.zeros((0, 2), "<u4")
    return symbols.astype("<u4"), np.diff(np.concatenate(([0], ends))).astype("<u4"), grammar


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Each value in ``bits`` bits, the lowest first."""
    spread = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits], bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.int64)


def generations(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that use none of their own run, so that a run is worked out at once; rules come after those they use."""
    newest, start = rules.max(axis=1, initial=0).astype(np.int64) - base, 0
    while start < len(rules):
        later = newest[start + 1 :] >= start
        stop = start + 1 + int(later.argmax()) if later.any() else len(rules)
        yield start, stop
        start = stop


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    size = np.ones(base + len(rules), np.int64)
    for start, stop in generations(rules, base):
        size[base + start : base + stop] = size[rules[start:stop]].sum(axis=1)
    return size[base:].astype("<u4")


def write_shard(ids: np.ndarray, lengths: np.ndarray, base: int) -> bytes:
    """The bytes of a shard."""
    symbols, per, rules = compress(ids, lengths, base)
    sizes = expansion_lengths(rules, base)
    bits, wide = int(max(base + len(rules), 2) - 1).bit_length(), 2 if sizes.max(initial=0) < 1 << 16 else 4
    body = MAGIC + struct.pack("<6I", len(lengths), len(rules), len(symbols), base, bits, wide) + pack_bits(rules.ravel(), bits) + sizes.astype(f"<u{wide}").tobytes()
    body += per.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + pack_bits(symbols, bits)
    return body + struct.pack("<I", zlib.crc32(body))


def _laid_out(flat: np.ndarray, place: np.ndarray, size: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of symbols one after the other, each taken from its place in ``flat``."""
    n = size[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(place[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Shard:
    """A shard's bytes, checked, for decoding."""

    def __init__(self, data: bytes):
        if len(data) < 32 or data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a shard, or damaged")
        docs, rules, symbols, self.base, bits, wide = struct.unpack("<6I", data[4:28])
        at, after = 28, 28 + (2 * rules * bits + 7) // 8
        self.rules = unpack_bits(data[at:after], 2 * rules, bits).reshape(-1, 2)
        self.sizes = np.frombuffer(data, f"<u{wide}", rules, after).astype("<u4")
        at = after + wide * rules
        self.per = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        self.lengths = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        self.symbols = unpack_bits(data[at:-4], symbols, bits)
        self.begins = np.concatenate(([0], np.cumsum(self.per.astype(np.int64))))
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All expansions in one array, with each symbol's place and size in it."""
        if self._flat is None:
            size = np.concatenate((np.ones(self.base, np.int64), self.sizes.astype(np.int64)))
            place = np.concatenate(([0], np.cumsum(size)[:-1]))
            flat = np.empty(int(size.sum()), "<u4")
            flat[: self.base] = np.arange(self.base)
            for start, stop in generations(self.rules, self.base):
                made = _laid_out(flat, place, size, self.rules[start:stop].ravel())
                flat[(at := place[self.base + start]) : at + len(made)] = made
            self._flat = flat, place, size
        return self._flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return _laid_out(*self._table(), symbols)

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of document ``i`` from ``start`` to ``stop``, expanding only the symbols that hold them."""
        length = int(self.lengths[i])
        stop = length if stop is None else min(stop, length)
        symbols = self.symbols[self.begins[i] : self.begins[i + 1]]
        if start <= 0 and stop == length:
            return self._expand(symbols)
        if stop <= start:
            return np.zeros(0, "<u4")
        ends = np.cumsum(self._table()[2][symbols])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[start - before : stop - before]


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Shards of all documents in ascending id order, written and read back: task, shard, tokens, doc_ids, payload."""
    path = path or vocabulary_path("word_bpe_49k.json")
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        base = tokens.tokenizer.get_vocab_size()
        task, shard, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        keys: list = []
        size = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[task], [shard], [len(ids)], [list(keys)], [write_shard(ids, lengths, base)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["task", "shard", "tokens", "doc_ids", "payload"])

        for part in slices(batches, 1):
            for key, raw in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist()), strict=True):
                if held and size + len(raw) // 4 + 1 > shard_tokens:
                    yield close()
                    held.clear()
                    keys.clear()
                    size, shard = 0, shard + 1
                held.append(raw + end)
                keys.append(key)
                size += len(raw) // 4 + 1
        if held:
            yield close()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    # Equal ids are ordered, and dealt out, by their texts; rows equal in both, in any order, by a number drawn with a fixed seed.
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("split", F.rand(7))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie", "split").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "task long, shard long, tokens long, doc_ids array<long>, payload binary"), "token-files")


def _starts(shards: DataFrame) -> DataFrame:
    """(task, shard, start): the ids of all shards before."""
    held = materialise(shards.select("task", "shard", "tokens"), "token-starts")
    inside = W.partitionBy("task").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    tasks = held.groupBy("task").agg(F.sum("tokens").alias("task_tokens"))
    tasks = tasks.select("task", F.coalesce(F.sum("task_tokens").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("tasks_before"))
    starts = held.join(tasks, "task").select("task", "shard", (F.col("tasks_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start"))
    return F.broadcast(starts) if held.count() <= BROADCAST_SHARDS else starts


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, each decoded by itself; start counts the ids of all documents before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, start, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(payload)
                sizes = shard.lengths.astype(np.int64)
                begins = np.cumsum(sizes) - sizes + start
                for k in range(0, len(sizes), 1000):
                    ids = [shard.document(i).tobytes() for i in range(k, min(k + 1000, len(sizes)))]
                    arrays = [pa.array(keys[k : k + 1000], pa.int64()), pa.array(begins[k : k + 1000]), pa.array(sizes[k : k + 1000]), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])

    held = shards.join(_starts(shards), ["task", "shard"]).select("doc_ids", "start", "payload")
    return held.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_ranges(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, first, stop, ids) for rows (doc_id, first, stop) of ``wanted``: ids ``first`` to ``stop`` of the documents.

    Only the symbols that hold a range are expanded. A shard's bytes travel once, followed by the ranges asked of it.
    """
    places = shards.select("task", "shard", F.posexplode("doc_ids").alias("place", "doc_id"))
    asked = wanted.select("doc_id", "first", "stop").join(places, "doc_id").withColumn("payload", F.lit(None).cast("binary"))
    files = shards.select("task", "shard", "payload").join(asked.select("task", "shard").distinct(), ["task", "shard"], "left_semi")
    both = asked.unionByName(files, allowMissingColumns=True).repartition("task", "shard").sortWithinPartitions("task", "shard", F.col("payload").isNull())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for part in slices(batches, 4):
            out: list[tuple] = []
            for key, first, stop, place, payload in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if payload is not None:
                    shard = Shard(payload)
                else:
                    out.append((key, first, stop, shard.document(place, first, stop).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["doc_id", "first", "stop", "ids"])

    columns = [F.col(c).cast("long") for c in ("doc_id", "first", "stop", "place")]
    return both.select(*columns, "payload").mapInArrow(read, "doc_id long, first long, stop long, ids binary")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    shards = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

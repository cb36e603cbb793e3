"""Operator 1: n-gram Jaccard join by MinHash banding, verified on the full shingle sets.

1. Every text becomes its set of five-word shingles (lower-cased words, 64-bit
   hashes), a MinHash signature of ``BANDS`` x ``ROWS`` minima and one hash per
   band. ``recall`` says how likely two sets of a similarity share a band: more
   than 0.999 at 0.8.
2. Texts with the same shingles are one class of copies, found by a 128-bit
   sum; only one of them goes on.
3. A shuffle on the band hashes finds the buckets with several texts. A bucket
   all of whose texts also share an earlier band has no pair of its own and is
   left out.
4. Every pair of a bucket is verified on the full shingle sets, in the bucket of
   the first band that the two share and there only. Buckets are dealt out in
   blocks bounded by texts and by bytes: a task sees two blocks, intersects
   their sets as matrix products, and returns counts and a spanning forest,
   never the pairs. A chain of half-similar texts makes many small buckets, so
   its cost grows with its length.
5. Components of the verified links give each document its class.

Links are those between documents whose sets have a similarity of at least the
threshold; ``n_links`` counts a document's links, copies included.

Defined cases: null counts as the empty text; texts without words are copies
of each other; a text of fewer than five words is one shingle of them all; the
class id is the least id in the class, null only if all its ids are null; rows
repeated count as copies; an empty table gives an empty result; other columns,
whatever their names, are handed through by ``distinct_documents`` and not
read by ``similar_classes``. A long text is hashed ``PIECE`` bytes at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, join_with_hot, materialise, slices, text_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
#: A block of a bucket has about so many texts, and shingle sets of about so many bytes, at most.
BLOCK, BLOCK_BYTES = 500, 16 << 20
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20
SEED = 977

SPACES = tuple(bytes([c]) for c in (32, *range(9, 14)))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2 ** 64."""
    one = np.full(n, _STEP, np.uint64)
    back = np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    one[0] = back[0] = 1
    return np.cumprod(one), np.cumprod(back)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """How likely two sets of this similarity share at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def _word(data: np.ndarray) -> np.ndarray:
    """The hash of one word longer than a piece, in an array."""
    forward, _ = _powers(PIECE)
    total = 0
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        total += int((_BYTE[part] * forward[: len(part)]).sum(dtype=np.uint64)) * pow(_STEP, at, 1 << 64)
    return mixed(np.array([total % (1 << 64)], np.uint64))


def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: its bytes' polynomial, from one running sum, moved to place 0 by the inverse power."""
    data = np.frombuffer(joined + b"\n", np.uint8)
    forward, back = _powers(1 << max(16, len(data).bit_length()))
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * forward[: len(data)])))
    return mixed((sums[ends] - sums[starts]) * back[starts]), starts


def _long_text(text: bytes) -> np.ndarray:
    """The word hashes of a text longer than a piece, cut at white space."""
    found, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        part = text[at:end]
        if len(part) <= 2 * PIECE:
            found.append(_words(part)[0])
        else:  # up to a piece of words, then one very long word
            last = max(part.rfind(c) for c in SPACES) + 1
            found += [_words(part[:last])[0], _word(np.frombuffer(part, np.uint8, offset=last))]
        at = end
    return np.concatenate(found)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where each text's hashes begin, and the end): hashed word shingles, repeats kept."""
    parts, n, run, held = [], np.zeros(len(texts), np.int64), [], 0

    def close() -> None:
        if run:
            found, starts = _words(b"\n".join(texts[i] for i in run))
            begins = np.concatenate(([0], np.cumsum([len(texts[i]) + 1 for i in run])))
            n[run] = np.diff(np.searchsorted(starts, begins))
            parts.append(found)
            run.clear()

    for i, text in enumerate(texts):
        if held + len(text) > PIECE:
            close()
            held = 0
        if len(text) > PIECE:
            parts.append(_long_text(text))
            n[i] = len(parts[-1])
        else:
            run.append(i)
            held += len(text) + 1
    close()
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(n)))
    whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += words[k : k + len(whole)] * _PLACE[k]
    whole = mixed(whole)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    inside = owner[: len(whole)] == owner[WORDS - 1 :] if len(whole) else np.zeros(0, bool)
    hashes, owners = whole[inside], owner[: len(whole)][inside]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        extra = [mixed((words[first[i] : first[i + 1]] * _PLACE[: n[i]]).sum(dtype=np.uint64)[None] + np.uint64(int(n[i])))[0] for i in short]
        hashes, owners = np.concatenate((hashes, np.array(extra, np.uint64))), np.concatenate((owners, short))
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, np.searchsorted(owners, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each band of the MinHash signatures of nonempty sets that begin at ``offsets``."""
    bands = np.zeros((len(offsets), BANDS), np.uint64)
    for b in range(BANDS):
        total = np.full(len(offsets), b + 1, np.uint64)
        for r in range(ROWS):
            total += mixed(np.minimum.reduceat(hashes * _FACTORS[b * ROWS + r], offsets)) * _ROW[r]
        bands[:, b] = mixed(total)
    return bands


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, doc_id, text_hash, set_a, set_b, size, bands) of every row, written to the shared folder.

    ``uid`` numbers the rows by task and place; ``set_a`` and ``set_b`` are
    equal for rows with the same shingles; ``size`` counts these, repeats
    included; ``bands`` is null without words.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part in slices(batches, 2, 2 << 20):
            n = part.num_rows
            hashes, bounds = shingles(part.column(2).cast(pa.binary()).to_pylist())
            some = np.flatnonzero(np.diff(bounds))
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            rows: list = [None] * n
            if len(some):
                offsets = bounds[:-1][some]
                a[some] = np.add.reduceat(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)), offsets)
                b[some] = np.add.reduceat(mixed(hashes + np.uint64(0xD1B54A32D192ED03)), offsets)
                bands = signatures(hashes, offsets).view(np.int64)
                for i, held in zip(some.tolist(), bands, strict=True):
                    rows[i] = held
            arrays = [pa.array(np.arange(number, number + n)), part.column(0), part.column(1), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(bounds)), pa.array(rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["uid", "doc_id", "text_hash", "set_a", "set_b", "size", "bands"])
            number += n

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), F.lower(text_of(docs[text])).alias("text"))
    return materialise(source.mapInArrow(sketch, "uid long, doc_id long, text_hash long, set_a long, set_b long, size long, bands array<long>"), "near-sketches")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, by large and small stars.

    ``edges`` is (a, b), any direction. Every step groups with partial
    aggregates and joins; no neighbourhood is gathered in one place, and the
    centres of large stars are broadcast. A step's edges are written to the
    shared folder.
    """
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    held = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "near-edges")
    seen = held.agg(*mark).first()
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
        large = join_with_hot(both.where("b > a"), least, ["a"], "degree", 2 * seen["n"])
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        held = materialise(small, "near-edges")
        before, seen = seen, held.agg(*mark).first()
        if before == seen:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _forest(links: np.ndarray) -> np.ndarray:
    """The least index of each index's component in a boolean link matrix."""
    label = np.arange(len(links))
    far = len(links)
    while True:
        near = np.minimum(np.where(links, label[None], far).min(axis=1), label)
        near = near[near]
        if (near == label).all():
            return label
        label = near


def linked(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, bands: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set, least index of its component) among sets of one or two sides, across sides if there are two.

    ``sets`` hold sorted hashes. Sizes of intersections come from products of
    0/1 matrices, some thousand shingles at a time; a shingle that only one set
    has is left out. Pairs with an equal entry in ``bands``, the hashes of the
    earlier bands, are another bucket's.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
    times = np.diff(edge)
    shared = times > 1
    name = np.repeat(np.arange(int(shared.sum())), times[shared])
    owner = owner[np.repeat(shared, times)]
    common = np.zeros((n, n))
    width = max(256, (1 << 21) // n)
    cuts = np.searchsorted(name, np.arange(0, int(name[-1]) + 1 + width, width)) if len(name) else [0]
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((n, min(width, int(name[-1]) + 1)), np.float32)
        held[owner[s:e], name[s:e] - k * width] = 1
        common += held @ held.T
    links = common * (1 + threshold) >= threshold * (size[:, None] + size[None]) - 1e-6
    np.fill_diagonal(links, False)
    if side.any() and not side.all():
        links &= side[:, None] != side[None]
    for band in bands.T:
        links &= band[:, None] != band[None]
    return links @ weights, _forest(links)


def _sets(texts: DataFrame) -> DataFrame:
    """(uid, copies, bands, hashes) from (uid, copies, bands, text): the sorted shingle hashes as bytes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3, 2 << 20):
            first = np.unique(part.column(0).to_numpy(), return_index=True)[1]
            part = part.take(pa.array(first))  # equal rows find one entry several times
            found, bounds = shingles(part.column(3).cast(pa.binary()).to_pylist())
            rows = [np.unique(found[s:e]).tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.binary())], names=["uid", "copies", "bands", "hashes"])

    return texts.select("uid", "copies", "bands", "text").mapInArrow(hashed, "uid long, copies long, bands array<long>, hashes binary")


def _verified(tasks: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(uid, links, root): partial link counts and spanning edges of the buckets in ``tasks`` (band, place, uid, blocks)."""
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    dealt = (
        tasks.join(sets, "uid")
        .withColumn("own", own)
        .select("band", "uid", "copies", "hashes", F.slice("bands", F.lit(1), F.col("place")).alias("bands"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "uid", "copies", "bands", "hashes")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        at = None
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(group) > 1:
                side, uids, copies, bands, sets = zip(*group, strict=True)
                count, root = linked(list(sets), np.array(copies, np.int64), np.array(side) == at[2], np.array(bands, np.int64).reshape(len(uids), -1), threshold)
                out.extend((uids[i], int(count[i]), uids[root[i]]) for i in np.flatnonzero(count))
            group.clear()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["uid", "links", "root"])

        for part in slices(batches, 7, 4 << 20):
            keys = zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)
            rows = zip(*(part.column(k).to_pylist() for k in range(3, 7)), map(lambda h: np.frombuffer(h, np.uint64), part.column(7).to_pylist()), strict=True)
            for key, row in zip(keys, rows, strict=True):
                if key != at:
                    close()
                    at = key
                if not group or group[-1][1] != row[1]:  # sorted, so equal rows are neighbours
                    group.append(row)
            if out:
                yield made()
                out.clear()
        close()
        if out:
            yield made()

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(n, "band", "low", "high").sortWithinPartitions("band", "low", "high", "uid")
    return spread.mapInArrow(verify, "uid long, links long, root long")


def _buckets(reps: DataFrame, rows: int) -> DataFrame:
    """(band, place, uid, blocks): the members of buckets with pairs of their own, written to the shared folder.

    ``reps`` has uid, size and bands of one text of each class of copies.
    """
    exploded = reps.select("uid", F.posexplode("bands").alias("place", "band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(join_with_hot(exploded, shared, ["band"], "n", rows * BANDS).select("band", "place", "uid"), "near-buckets")
    bounds = [f(F.col("bands")[k]).alias(f"{name}{k}") for k in range(BANDS - 1) for name, f in (("low", F.min), ("high", F.max))]
    buckets = members.join(reps.select("uid", "size", "bands"), "uid").groupBy("band", "place").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), *bounds)
    earlier = F.lit(False)
    for k in range(BANDS - 1):
        earlier = earlier | ((F.col("place") > k) & (F.col(f"low{k}") == F.col(f"high{k}")))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("hashes") / BLOCK_BYTES)).cast("int")
    own = materialise(buckets.where(~earlier).select("band", "n", blocks.alias("blocks")), "near-own-buckets")
    return materialise(join_with_hot(members, own, ["band"], "n", members.count()).select("band", "place", "uid", "blocks"), "near-tasks")


def classify(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(uid, doc_id, text_hash, class_root, n_links) for every row of ``docs``."""
    sketch = sketches(docs, text)
    rows = sketch.count()
    classes = materialise(sketch.groupBy("set_a", "set_b").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "near-copies")
    reps = sketch.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    tasks = _buckets(reps, rows)
    wanted = (
        tasks.select("uid")
        .distinct()
        .join(classes.select(F.col("rep").alias("uid"), "copies"), "uid")
        .join(sketch.select("uid", "bands", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")), "uid")
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs[text]).alias("own_hash"), F.lower(text_of(docs[text])).alias("text"))
    found = texts.join(wanted, (F.col("own_hash") == F.col("wanted_hash")) & F.col("own_id").eqNullSafe(F.col("wanted_id")))
    sets = materialise(_sets(found), "near-sets")
    verified = materialise(_verified(tasks, sets, threshold), "near-links")
    links = verified.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    placed = classes.join(links, classes["rep"] == links["uid"], "left").drop("uid").join(roots, F.col("rep") == F.col("node"), "left")
    placed = placed.select("set_a", "set_b", "copies", F.coalesce("root", "rep").alias("class_root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = materialise(placed, "near-placed")
    return join_with_hot(sketch, placed, ["set_a", "set_b"], "copies", rows).select("uid", "doc_id", "text_hash", "class_root", "n_links")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links."""
    rows = materialise(classify(docs, threshold), "near-classes")
    named = rows.groupBy("class_root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return join_with_hot(rows, named, ["class_root"], "class_size", rows.count()).select("doc_id", "class_id", "class_size", "n_links")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the least id, all columns kept."""
    rows = materialise(classify(docs, threshold), "near-classes")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "uid", "text_hash")
    kept = rows.groupBy("class_root").agg(F.min(order).alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs["text"]).alias("own_hash"))
    stays = whole.join(kept, (F.col("own_hash") == F.col("kept_hash")) & F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if repeated:  # of rows with equal id and text one stays; tasks merge their own first
        stays = stays.groupBy("own_hash", "own_id").agg(F.first("document").alias("document"))
    return stays.select("document.*")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir))

"""Operator 11: the prefix trie of conversations, by distributed MSD radix partitioning.

Turns are dictionary-encoded; a conversation is a sequence of turn ids. A bucket
holds the conversations that share a first part. Round by round, each bucket of
more than ``LOCAL`` turns is looked at as a whole: the first place where its
members differ or one ends is found by sums per place, the places before it are
nodes with all members, and at that place the members are dealt to one bucket a
turn id. So a round costs one pass over the turns of large buckets, and rounds
are as many as a path has branchings, however long shared parts are. Buckets of
one conversation are chains and need no order. All others, once small, are
finished by tasks that stream them one at a time: multikey quicksort on the
turn ids, whose recursion emits the nodes. Sums over subtrees go up from the
last round to the first.

No conversation or bucket above ``LOCAL`` turns is ever in one row, group or
task; keys that many rows share are joined by broadcast of the keys.

Defined cases: null roles and texts are empty; turns of equal number are in the
order of the hash of role and text, rows repeated are turns of their own; null
turns come first; rows without a conv_id belong to no conversation; a rebuilt
conversation without turns is a member of the root; an empty table has no root
and gives an empty result; other columns are not read. conv_ids are whole
numbers; the remainder of a negative one has its sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import WORD_CLASS, join_with_hot, map_arrow, materialise, scratch, spread, text_of

#: A bucket of at most so many turns is finished by one task.
LOCAL = 4096
#: Conversations are rebuilt on the first turns, fewer than ``HEADS``, of the first of their block of ``BLOCK``.
BLOCK, HEADS = 20, 4
SINGLE, SMALL, LARGE = 0, 1, 2
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]


def _shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns in order, from 1. Sorted in ranges, so that a long conversation is many tasks' work."""
    role, text = text_of("role"), text_of("text")
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(f"{WORD_CLASS}+")).cast("long")
    rows = spread(conversations).where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(named, 256)).alias("digest"), words.alias("words"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.append(begins[1:], len(keys))
            place = np.arange(len(keys)) - np.repeat(begins, ends - begins)
            if keys[0] == last:
                place[: ends[0]] += held
            last, held = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(place), pa.array(np.full(len(keys), part, np.int64))], names=["conv_id", "digest", "words", "place", "part"])

    order = ("conv_id", "turn", "digest")
    ranged = rows.repartitionByRange(_shuffles(rows), *order).sortWithinPartitions(*order)
    placed = materialise(map_arrow(ranged, number, "conv_id long, digest binary, words long, place long, part long"), "trie-placed")
    # only the first conversation of a part can have turns in parts before it, so these rows are at most one a part
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(earlier)).where("ahead is not null").drop("n")
    pos = F.col("place") + 1 + F.coalesce("ahead", F.lit(0))
    return placed.join(F.broadcast(ahead), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "digest", "words")


def encoded_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, turn_id, words), the dictionary (digest, turn_id, n)); a digest is SHA-256 of role and text."""
    placed = materialise(numbered_turns(conversations), "trie-turns")
    dictionary = materialise(placed.groupBy("digest").agg(F.count("*").alias("n")).withColumn("turn_id", F.monotonically_increasing_id()), "trie-dictionary")
    coded = join_with_hot(placed, dictionary, ["digest"], "n", placed.count())
    return materialise(coded.select("conv_id", "pos", "turn_id", "words"), "trie-coded"), dictionary


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, turn_id, words, len), (conv_id, len)): conversations on the first turns of their block's first.

    h = crc32(conv_id) % ``heads`` turns of conversation conv_id - conv_id %
    ``block``, or all it has, then the own turns after the first h.
    """
    sizes = materialise(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-sizes")
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h, base = F.crc32(F.col("conv_id").cast("string")) % heads, F.col("conv_id") - F.col("conv_id") % block
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = sizes.withColumn("h", h).withColumn("base", base).join(lent, "base", "left").withColumn("head", head)
    plan = materialise(plan.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-plan")
    own = turns.join(plan.select("conv_id", "h", "head", "len"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "turn_id", "words", "len")
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "turn_id", "words")
    lent_turns = first.join(plan.where("head > 0").select("conv_id", "base", "head", "len"), "base").where("pos <= head")  # at most block conversations a base
    return own.unionByName(lent_turns.select(*own.columns)), plan.select("conv_id", "len")


def _quicksorted(convs: list[int], ids: list[list[int]], words: list[list[int]]) -> list[list]:
    """Nodes [conv, place, parent node or -1, members, words, ended conversations] of sequences that share their first id.

    Multikey quicksort: a group whose members agree on all ids before a place is
    split by that of its middle member into less, equal and more. The equal part
    is a node; those of it that go on are sorted at the next place.
    """
    nodes: list[list] = []
    stack = [(list(range(len(convs))), 0, -1)]
    while stack:
        group, at, parent = stack.pop()
        middle = sorted(ids[i][at] for i in group)[len(group) // 2]
        less, equal, more = [], [], []
        for i in group:
            mine = ids[i][at]
            (equal if mine == middle else less if mine < middle else more).append(i)
        for part in (less, more):
            if part:
                stack.append((part, at, parent))
        going = [i for i in equal if len(ids[i]) > at + 1]
        ended = sorted(convs[i] for i in equal if len(ids[i]) == at + 1)
        nodes.append([min(convs[i] for i in equal), at, parent, len(equal), words[equal[0]][at], ended])
        if going:
            stack.append((going, at + 1, len(nodes) - 1))
    return nodes


def _finished(bucket_parent: int, first: int, convs: list[int], ids: list[list[int]], words: list[list[int]]) -> Iterator[tuple]:
    """Rows of NODE for a bucket; sums go up from the last node, since a node comes after its parent."""
    nodes = _quicksorted(convs, ids, words)
    children, leaves = [0] * len(nodes), [0] * len(nodes)
    saved = [(n - 1) * w for _, _, _, n, w, _ in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        if (parent := nodes[k][2]) >= 0:
            children[parent] += 1
            leaves[parent] += leaves[k]
            saved[parent] += saved[k]
    for k, (conv, at, parent, n, _, ended) in enumerate(nodes):
        yield conv, first + at, bucket_parent if parent < 0 else nodes[parent][0], n, children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()


def _local_nodes(rows: DataFrame) -> DataFrame:
    """NODE rows of small buckets, which come to a task in order and are finished one at a time."""
    columns = ("bucket", "first", "parent", "conv_id", "pos", "turn_id", "words")
    kinds = [pa.int64()] * 7 + [pa.string()]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: np.ndarray) -> pa.RecordBatch:
            out: list[tuple] = []
            changes = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            begins = np.concatenate(([0], np.flatnonzero(changes) + 1, [rows.shape[1]]))
            for s, e in zip(begins[:-1], begins[1:], strict=True):
                own = rows[:, s:e]
                cuts = np.concatenate(([0], np.flatnonzero(own[3, 1:] != own[3, :-1]) + 1, [e - s]))
                ids, words = own[5].tolist(), own[6].tolist()
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                out.extend(_finished(int(own[2, 0]), int(own[1, 0]), own[3, cuts[:-1]].tolist(), [ids[a:b] for a, b in spans], [words[a:b] for a, b in spans]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NODE_NAMES)

        held = np.zeros((7, 0), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1) if batch.num_rows else held
            if held.shape[1]:
                same = (held[0] == held[0, -1]) & (held[1] == held[1, -1])
                start = int(np.argmax(same))  # of the last bucket, which may go on
                if start:
                    yield made(held[:, :start])
                    held = held[:, start:]
        if held.shape[1]:
            yield made(held)

    ordered = rows.select(*columns).repartition(_shuffles(rows), "bucket", "first").sortWithinPartitions("bucket", "first", "conv_id", "pos")
    return map_arrow(ordered, finish, NODE)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (bucket, end, conv_id): ids in order, joined in ranges, then hashed as a stream of their texts."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket, end, conv = (c.to_numpy() for c in batch.columns)
                begins = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (end[1:] != end[:-1])) + 1))
                stops = np.append(begins[1:], len(conv)).tolist()
                texts = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(begins.tolist(), stops, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(end[begins]), pa.array(conv[begins]), pa.array(texts, pa.string())], names=["bucket", "end", "from", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        names = ["conv_id", "depth", "ends_sha256"]
        kinds = (pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out: list[tuple] = []
            for bucket, end, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if at == (bucket, end):
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (bucket, end), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, digest.hexdigest()), kinds, strict=True)], names=names)

    order = ("bucket", "end", "conv_id")
    n = _shuffles(ends)
    texts = map_arrow(ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order), joined, "bucket long, end long, `from` long, ids string")
    return map_arrow(texts.repartition(n, "bucket", "end").sortWithinPartitions("bucket", "end", "from"), hashed, "conv_id long, depth long, ends_sha256 string")


def _by_kind(rows: DataFrame, label: str) -> DataFrame:
    """Written in folders by ``kind``, so that a later read of one kind reads it alone."""
    path = scratch(rows.sparkSession, label)
    rows.write.partitionBy("kind").parquet(path)
    kinds = T.StructType([f for f in rows.schema.fields if f.name != "kind"]).add("kind", T.IntegerType())
    return rows.sparkSession.read.schema(kinds).parquet(path)


class _Round:
    """What a round leaves: places (bucket, first, pos, words, n), stops (bucket, first, parent, n_convs, size, stop, end), children, ends, rows by kind."""

    def __init__(self, rows: DataFrame, members: DataFrame, buckets: DataFrame, extra: DataFrame | None, local: int):
        key = ["bucket", "first"]
        total = rows.count()
        places = rows.groupBy(*key, "pos").agg(F.count("*").alias("n"), F.min("turn_id").alias("lo"), F.max("turn_id").alias("hi"), F.min("words").alias("words"))
        self.places = materialise(places.unionByName(extra) if extra else places, "trie-places")
        differ = (F.col("n") < F.col("n_convs")) | (F.col("lo") < F.col("hi"))
        found = self.places.join(buckets.select(*key, "n_convs"), key).groupBy(*key).agg(F.min(F.when(differ, F.col("pos"))).alias("stop"), F.max("pos").alias("last"))
        ends = F.coalesce(F.col("stop") - 1, F.col("last")).alias("end")
        self.stops = materialise(buckets.join(found, key).select(*buckets.columns, "stop", ends), "trie-stops")
        self.ends = materialise(join_with_hot(members, self.stops.select(*key, "end", "n_convs"), key, "n_convs", members.count()).where("len = end").select("bucket", "end", "conv_id"), "trie-ends")
        at = materialise(join_with_hot(rows, self.stops.select(*key, "stop", "size"), key, "size", total).where("pos = stop").select(*key, "turn_id", "conv_id", "stop", "len"), "trie-at")
        parted = [*key, "turn_id"]
        groups = at.groupBy(*parted).agg(F.min("conv_id").alias("child"), F.count("*").alias("child_convs"), F.sum(F.col("len") - F.col("stop") + 1).alias("child_size"), F.min("stop").alias("child_first"))
        kind = F.when(F.col("child_convs") == 1, SINGLE).when(F.col("child_size") <= local, SMALL).otherwise(LARGE)
        self.children = materialise(groups.withColumn("kind", kind), "trie-children")
        moved = join_with_hot(at.select(*parted, "conv_id"), self.children.select(*parted, "child", "child_first", "child_convs", "kind"), parted, "child_convs", at.count())
        moved = moved.select("conv_id", "child", "child_first", F.col("bucket").alias("parent"), "kind")
        kept = rows.drop(*key, "parent").join(moved, "conv_id").where("pos >= child_first")
        self.rows = _by_kind(kept.select(F.col("child").alias("bucket"), F.col("child_first").alias("first"), "parent", "conv_id", "pos", "turn_id", "words", "len", "kind"), "trie-rows")

    def of(self, kind: int) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).drop("kind")

    def large(self) -> DataFrame:
        return self.children.where(F.col("kind") == LARGE).select(F.col("child").alias("bucket"), F.col("child_first").alias("first"), F.col("bucket").alias("parent"), F.col("child_convs").alias("n_convs"), F.col("child_size").alias("size"))

    def nodes(self, below: DataFrame) -> DataFrame:
        """Nodes of the buckets' shared places, without ends; ``below`` has (bucket, first, leaves, saved) of children that are no single conversation."""
        key = ["bucket", "first"]
        theirs = below.select(F.col("bucket").alias("child"), F.col("first").alias("child_first"), "leaves", "saved")
        sums = self.children.join(theirs, ["child", "child_first"], "left").groupBy(*key).agg(F.count("*").alias("children"), F.sum(F.coalesce("leaves", F.lit(1))).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).alias("saved"))
        held = self.stops.join(sums, key, "left")
        shared = self.places.select(*key, "pos", "words").join(held, key).where("pos <= end")
        # what later places save: within blocks of places, and by blocks
        shared = shared.withColumn("block", F.floor(F.col("pos") / 4096)).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
        blocks = shared.groupBy(*key, "block").agg(F.sum("own").alias("later"))
        after = W.partitionBy(*key).orderBy("block").rowsBetween(1, W.unboundedFollowing)
        blocks = blocks.withColumn("later", F.coalesce(F.sum("later").over(after), F.lit(0)))
        onward = W.partitionBy(*key, "block").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
        rows = shared.withColumn("onward", F.sum("own").over(onward)).join(blocks, [*key, "block"])
        return rows.select(
            F.col("bucket").alias("conv_id"),
            F.col("pos").alias("depth"),
            F.when(F.col("pos") == F.col("first"), F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"),
            "n_convs",
            F.when(F.col("pos") < F.col("end"), F.lit(1)).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + F.col("onward") + F.col("later")).cast("long").alias("saved_tokens"),
            "first",
        )


def trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """NODE rows of conversations (conv_id, pos, turn_id, words, len) and (conv_id, len), the turnless among the latter."""
    spark = turns.sparkSession
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("len").alias("size")).first()
    if not total["n"]:
        return spark.createDataFrame([], NODE)
    least = F.lit(total["least"]).cast("long")
    zero = F.lit(0).cast("long")
    rows = materialise(turns.select(least.alias("bucket"), zero.alias("first"), F.lit(None).cast("long").alias("parent"), "conv_id", "pos", "turn_id", "words", "len"), "trie-all")
    members = convs.select(least.alias("bucket"), zero.alias("first"), "conv_id", "len")
    buckets = spark.range(1).select(least.alias("bucket"), zero.alias("first"), F.lit(None).cast("long").alias("parent"), F.lit(total["n"]).cast("long").alias("n_convs"), F.lit(total["size"]).cast("long").alias("size"))
    extra = buckets.select("bucket", "first", zero.alias("pos"), F.col("n_convs").alias("n"), zero.alias("lo"), zero.alias("hi"), zero.alias("words"))  # the root has no turn
    rounds: list[_Round] = []
    while True:
        rounds.append(_Round(rows, members, buckets, extra, local))
        buckets, extra = rounds[-1].large(), None
        if buckets.isEmpty():
            break
        rows = rounds[-1].of(LARGE)
        members = rows.where("pos = first").select("bucket", "first", "conv_id", "len")

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    small = all_of([r.of(SMALL) for r in rounds])
    tops = small.where("pos = first").select(F.col("bucket").alias("conv_id"), F.col("first").alias("depth")).distinct()
    finished = materialise(_local_nodes(small), "trie-local")
    below = finished.join(tops, ["conv_id", "depth"], "left_semi").select(F.col("conv_id").alias("bucket"), F.col("depth").alias("first"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    upper, sums = [], below
    for r in reversed(rounds):
        made = materialise(r.nodes(sums), "trie-upper")
        upper.append(made)
        sums = below.unionByName(made.where("depth = first").select(F.col("conv_id").alias("bucket"), "first", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    digests = materialise(_end_digests(all_of([r.ends for r in rounds])), "trie-digests")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    shared = all_of(upper).drop("first").join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    last = F.col("pos") == F.col("len")
    one = F.lit(1).cast("long")
    chains = all_of([r.of(SINGLE) for r in rounds]).select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return shared.unionByName(finished).unionByName(chains)


def conversation_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """NODE rows of conversations (conv_id, turn, role, text) as they are."""
    turns, _ = encoded_turns(conversations)
    sizes = materialise(turns.groupBy("conv_id").agg(F.max("pos").alias("len")), "trie-sizes")
    return trie(turns.join(sizes, "conv_id"), sizes, local)


def node_turns(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes below the root of the trie of conversations as they are, with the role and text of their last turn.

    A node's least member has the turn at the node's depth.
    """
    text = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    places = numbered_turns(conversations).select("conv_id", F.col("pos").alias("depth"), "digest")
    wanted = nodes.join(places, ["conv_id", "depth"])
    return wanted.join(text.select("conv_id", digest.alias("digest"), "role", "text").dropDuplicates(["conv_id", "digest"]), ["conv_id", "digest"]).drop("digest")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, _ = encoded_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return trie(*rebuilt(turns))


SQL = r"""
WITH a AS (SELECT conv_id AS c, turn, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, g, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS p FROM a),
o AS (SELECT c, max(p) AS n, c - c % 20 AS b, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda r, x: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(r, x)), 4294967295)) % 4 AS h FROM t GROUP BY c),
k AS (SELECT o.c, o.b, o.h, least(o.h, coalesce(q.n, 0)) AS m FROM o LEFT JOIN o q ON q.c = o.b),
r AS (SELECT k.c, t.p - k.h + k.m AS p, g, w FROM k JOIN t ON t.c = k.c AND t.p > k.h UNION ALL SELECT k.c, t.p, g, w FROM k JOIN t ON t.c = k.b AND t.p <= k.m),
s AS (SELECT c, 0::BIGINT AS d, '' AS key, 0::BIGINT AS w FROM k UNION ALL SELECT c, p, sha256(string_agg(g, '') OVER (PARTITION BY c ORDER BY p)), w FROM r),
l AS (SELECT c, max(d) AS len FROM s GROUP BY c),
n AS (SELECT d, key, min(s.c) AS conv, count(*) AS n, max(w) AS w, sha256(coalesce(string_agg(s.c::VARCHAR, ',' ORDER BY s.c) FILTER (d = len), '')) AS ends FROM s JOIN l ON l.c = s.c GROUP BY d, key),
u AS (SELECT n.*, q.key AS above, q.conv AS parent FROM n LEFT JOIN s x ON x.c = n.conv AND x.d = n.d - 1 LEFT JOIN n q ON q.d = x.d AND q.key = x.key),
y AS (SELECT d - 1 AS d, above AS key, count(*) AS children FROM u WHERE d > 0 GROUP BY ALL),
z AS (SELECT x.d, x.key, sum((u.n - 1) * u.w)::BIGINT AS saved, count(*) FILTER (y.children IS NULL) AS leaves FROM u LEFT JOIN y ON y.d = u.d AND y.key = u.key JOIN s x ON x.c = u.conv AND x.d <= u.d GROUP BY ALL)
SELECT u.conv AS conv_id, u.d AS depth, u.parent AS parent_conv_id, u.n AS n_convs, coalesce(y.children, 0) AS n_children, z.leaves AS n_leaves, z.saved AS saved_tokens, u.ends AS ends_sha256
FROM u LEFT JOIN y ON y.d = u.d AND y.key = u.key JOIN z ON z.d = u.d AND z.key = u.key
"""

"""Operator 12: ranked lexical search, impact-ordered and score-at-a-time.

Documents are partitioned, as in a search engine of many servers. A first scan
counts the query terms of every whole text and writes these counts; from them
come the document frequencies and with them every posting's exact impact, the
integer that it adds to a score. A second scan indexes blocks of documents: the
postings of a term are grouped by exact impact, largest first. Each query is
answered block by block: groups are added to the scores in descending impact, a
level of them at a time; as long as the largest impacts left, summed over its
terms, could lift an unseen document into the answer, the next level follows.
Then only documents whose scores can still reach the answer are completed, from
the groups not yet read. A task carries a query's best scores from block to
block, so that later blocks stop sooner. The best of the tasks meet in a
ranking of Spark's, a few rows a task and query.

Queries go to the tasks in blocks of bounded size, each with its own two scans.

Defined cases: a null text has no terms; a document without terms is never an
answer and not counted; equal scores rank by ascending doc_id, null last; rows
repeated are documents of their own, so one doc_id may have two ranks; an item
without terms has no answers, and items repeated are answered each time; empty
tables give an empty result; other columns are not read. doc_ids are whole
numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import documents, map_arrow, materialise, slices

TOP = 10
#: Query blocks have at most so many characters of text, and so a bounded number of terms (a longer query has a block of its own).
QUERY_CHARS = 4 << 20
#: A block of documents has at most so many postings, some 40 MB with their index (a document with more has a block of its own).
BLOCK_POSTINGS = 1 << 20
#: A level goes down to this share of the largest impact that is left.
LEVEL = 0.6
NO_ID = np.iinfo(np.int64).max

#: Bytes that separate terms become spaces and A-Z lower case; letters beyond ASCII are bytes from 0x80 on, which stay.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TERM_BYTES).split()


@dataclass
class Queries:
    """Items as arrays of term numbers; every term's number."""

    items: list[int]
    terms: list[np.ndarray]
    numbers: dict[bytes, int]

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Queries:
        numbers: dict[bytes, int] = {}
        found = [sorted({numbers.setdefault(t, len(numbers)) for t in terms((text or "").encode())}) for _, text in rows]
        return Queries([i for i, _ in rows], [np.array(t, np.int64) for t in found], numbers)


def term_counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, numbers, counts) of documents with terms: how often each has the terms that have numbers; written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        for part in slices(batches, 1):
            ids, totals, held, counts = [], [], [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text) if text else []
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    ids.append(key)
                    totals.append(len(words))
                    held.append(list(found))
                    counts.append(list(found.values()))
            arrays = [pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "numbers", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(map_arrow(rows, count, "doc_id long, n long, numbers array<int>, counts array<int>"), "search-counts", "zstd")


@dataclass(frozen=True)
class Weights:
    """Documents with terms, their terms in all, and each term's weight: floor(1000 ln((2 N + 2) / (2 df + 1)))."""

    documents: int
    length: int
    of_term: np.ndarray

    def impacts(self, number: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term that occurs ``tf`` times in a document of ``n`` terms adds to its score; 64-bit integers."""
        m = 100 - 90 + (90 * n * self.documents) // self.length
        return self.of_term[number] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weights(counts: DataFrame, terms_held: int) -> Weights:
    """Sums of the whole table; a document frequency for each query term comes to the driver, as many as a block of queries has terms."""
    total = counts.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    frequency = np.zeros(terms_held, np.int64)
    for r in counts.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("df")).collect():
        frequency[r["number"]] = r["df"]
    n = total["documents"]
    return Weights(n, total["length"], np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64))


class ImpactIndex:
    """Postings of a block of documents by term, grouped by exact impact, largest first.

    ``docs[first[g]:first[g + 1]]`` are the documents of group g, ``impact[g]``
    what each gets; the groups of a term are ``begin[term]`` up to ``begin[term + 1]``.
    """

    def __init__(self, number: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms_held: int, size: int):
        order = np.lexsort((doc, -impact, number))
        number, impact, self.docs, self.size = number[order], impact[order], doc[order], size
        fresh = np.ones(len(number), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (impact[1:] != impact[:-1])
        self.first = np.append(np.flatnonzero(fresh), len(number))
        self.impact = impact[fresh]
        self.begin = np.searchsorted(number[fresh], np.arange(terms_held + 1))

    def search(self, query: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], top: int = TOP) -> list[tuple[int, int]]:
        """(score, doc_id) of the ``top`` best among ``best`` and this block's documents above 0, best first."""
        at, end = self.begin[query], self.begin[query + 1]
        held = at < end
        at, end = at[held].copy(), end[held]
        scores = np.zeros(self.size, np.int64)
        floor = best[top - 1][0] if len(best) == top else 0  # what an answer must reach
        while True:
            going = at < end
            left = np.where(going, self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(at) else np.zeros(0, np.int64)
            bound = int(left.sum())  # no document gets more from what is left
            reach = floor
            if self.size >= top:
                reach = max(reach, int(np.partition(scores, self.size - top)[self.size - top]))
            if bound == 0 or bound < reach:  # an unseen document stays below the answer
                break
            least = left.max() * LEVEL
            for k in np.flatnonzero(left >= least).tolist():
                s, e = int(at[k]), int(end[k])
                stop = s + int(np.searchsorted(-self.impact[s:e], -least, side="right"))  # groups of at least this impact, whole
                self._add(scores, s, stop)
                at[k] = stop
        near = np.flatnonzero((scores > 0) & (scores + bound >= reach))
        if bound and len(near):  # complete the scores of those that can still be answers
            wanted = np.zeros(self.size, bool)
            wanted[near] = True
            for s, e in zip(at.tolist(), end.tolist(), strict=True):
                if s < e:
                    a, b = int(self.first[s]), int(self.first[e])
                    docs, impact = self.docs[a:b], np.repeat(self.impact[s:e], np.diff(self.first[s : e + 1]))
                    mine = wanted[docs]
                    scores[docs[mine]] += impact[mine]
        if len(near):
            # ties at the last place are all kept until ids decide
            if len(near) > top:
                cut = np.partition(scores[near], len(near) - top)[len(near) - top]
                near = near[scores[near] >= cut]
            best = sorted(best + list(zip(scores[near].tolist(), ids[near].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:top]
        return best

    def _add(self, scores: np.ndarray, s: int, e: int) -> None:
        """Add groups ``s`` to ``e`` of one term: a document is in one group of a term at most."""
        scores[self.docs[self.first[s] : self.first[e]]] += np.repeat(self.impact[s:e], np.diff(self.first[s : e + 1]))


def best_of_tasks(counts: DataFrame, queries: Queries, weighed: Weights, top: int = TOP, block: int = BLOCK_POSTINGS) -> DataFrame:
    """(query, doc_id, score): the best of each task, by number of the query."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries.terms]

        def search(parts: list[pa.RecordBatch]) -> None:
            ids = np.concatenate([p.column(0).fill_null(NO_ID).to_numpy() for p in parts])
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            sizes = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            number = np.concatenate([p.column(2).flatten().to_numpy() for p in parts]).astype(np.int64)
            tf = np.concatenate([p.column(3).flatten().to_numpy() for p in parts]).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = weighed.impacts(number, tf, n[doc])
            some = impact > 0
            index = ImpactIndex(number[some], doc[some], impact[some], len(queries.numbers), len(ids))
            if some.any():
                for q, query in enumerate(queries.terms):
                    best[q] = index.search(query, ids, best[q], top)

        held, postings = [], 0
        for batch in batches:
            start, ends = 0, np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + (not held), int(np.searchsorted(ends, before + block - postings, side="right")))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    postings += int(ends[stop - 1]) - before
                if stop < batch.num_rows:
                    search(held)
                    held, postings = [], 0
                start = stop
        if held:
            search(held)
        rows = [(q, None if key == NO_ID else key, score) for q, found in enumerate(best) for score, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return map_arrow(counts.select("doc_id", "n", "numbers", "counts"), answer, "query int, doc_id long, score long")


def query_blocks(items: DataFrame, chars: int = QUERY_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """Items (item_id, text) in blocks of at most ``chars`` characters, streamed to the driver partition by partition."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len(r["text"] or "")
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for rows in query_blocks(items, QUERY_CHARS):
        queries = Queries.of(rows)
        counts = term_counts(docs, queries.numbers)
        best = best_of_tasks(counts, queries, weights(counts, len(queries.numbers)), top)
        order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(queries.items)), f"query int, item_id {kind}")
        answers = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        found = found.unionByName(materialise(answers, "search-answers"))
    return found


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM t WHERE len(ws) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY 1), g),
i AS (SELECT row_number() OVER () AS k, item_id, text FROM benchmark),
q AS (SELECT DISTINCT k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
v AS (SELECT p.term, p.r, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))) AS s FROM p JOIN f ON f.term = p.term JOIN d ON d.r = p.r, g WHERE p.term IN (SELECT term FROM q)),
s AS (SELECT q.k, v.r, sum(s)::BIGINT AS score FROM q JOIN v ON v.term = q.term GROUP BY ALL),
o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o JOIN i ON i.k = o.k WHERE rank <= 10
"""

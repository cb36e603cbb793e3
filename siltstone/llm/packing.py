"""Operator 7: packing token sequences by cutting-stock column generation.

Encoded documents are cut into whole sequences and one remainder each. Only the
histogram of remainder lengths (at most ``CONTEXT`` - 1 numbers) reaches the
driver. There a linear program over patterns, multisets of lengths that fit a
sequence, is solved by column generation from the patterns of single lengths
on: a knapsack dynamic program prices new patterns against the duals until the
value is within ``GAP`` of its proven bound or no pattern improves it.
Rounded-down patterns, and bounded subset sums for the at most one sequence a
pattern that is left, say which ranks of which length go to which sequences;
remainders find their rank from their scan task's counts.

Where whole pieces would leave more than ``LOOSE`` of all tokens as padding, as
when half of all remainders have one awkward length, the pieces of the emptiest
patterns are laid end to end and cut where a sequence is full. Other tables,
all of the tests' among them, have none of these.

Sequences are padded to ``CONTEXT`` except when their length is a power of two.

Defined cases: a null or empty text is the end id alone; equal texts and
repeated rows are packed each time; remainders of one length are ranked by
task and place, so a length that a third of all rows share needs no common
task; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import documents, materialise, slices, text_of
from ._tokens import byte_encoder, vocabulary_path

CONTEXT = 1024
END_ID = 0
#: The linear program stops within this share of its bound, or when no pattern improves it.
GAP = 0.001
#: A turn of pricing values a whole sequence's length more than its parts by this share, so that long pieces go first.
TILT = 0.1
#: Where whole pieces leave a larger share of padding, the emptiest patterns are dissolved and their pieces cut to fit.
LOOSE = 0.01
#: Up to so many (task, length) counts, some 5 MB, are broadcast; beyond, they are joined by shuffle.
BROADCAST_COUNTS = 100_000


def cut_documents(docs: DataFrame, context: int = CONTEXT, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, task, place): whole sequences and remainders, written to the shared folder.

    ``ids`` are little-endian unsigned 32-bit integers; ``place`` counts the
    pieces of the same length ahead in the scan task ``task``.
    """
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (context + 1)
        encode = byte_encoder(json_path, ranks_path).encode
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, 1, 4 << 20):
            keys = part.column(0).to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for key, ids in zip(keys, encode(part.column(1).to_pylist()), strict=True):
                raw = ids.tobytes() + end
                total = len(raw) // 4
                for start in range(0, total, context):
                    length = min(context, total - start)
                    for column, value in zip(rows, (key, start, length, total, raw[4 * start : 4 * (start + length)], seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            kinds = (part.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            arrays.append(pa.array(np.full(len(rows[0]), task, np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "ids", "place", "task"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(docs["doc_id"], text_of(docs["text"]).alias("text"))
    return materialise(source.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, place long, task long"), "packing-pieces", "zstd")


class _Prices:
    """The most valuable patterns: an unbounded knapsack by dynamic programming over the sequence's length."""

    def __init__(self, lengths: np.ndarray, duals: np.ndarray, context: int):
        self.lengths, self.number = lengths, np.full(context + 1, -1)
        self.number[lengths] = np.arange(len(lengths))
        useful, worth = duals > 1e-12, np.full(context + 1, -1.0)
        worth[lengths[useful]] = duals[useful]
        best, chosen = np.zeros(context + 1), np.zeros(context + 1, np.int64)
        for c in range(1, context + 1):
            gains = best[c - 1 :: -1] + worth[1 : c + 1]  # of a last piece of 1, 2, ... c
            g = int(gains.argmax())
            best[c] = best[c - 1]
            if gains[g] > best[c] + 1e-13:
                best[c], chosen[c] = gains[g], g + 1
        self.best, self.chosen = best, chosen.tolist()

    def pattern(self, i: int, context: int) -> Counter:
        """The best pattern that has length number ``i``: copies by length number."""
        found, c = Counter([i]), context - int(self.lengths[i])
        while c > 0:
            if size := self.chosen[c]:
                found[int(self.number[size])] += 1
                c -= size
            else:
                c -= 1
        return found


def _priced_in_turn(lengths: np.ndarray, demand: np.ndarray, duals: np.ndarray, context: int) -> tuple[list[Counter], np.ndarray]:
    """Patterns priced one after the other on the demand that is left, and their uses: a triangular basis, by length number.

    Each has the longest length left and is used until one of its lengths is
    used up, whose column it is; lengths used up at the same time get their
    single-length pattern, used 0 times.
    """
    n = len(lengths)
    left, open_ = demand.copy(), np.ones(n, bool)
    basis, uses, prices = [Counter() for _ in range(n)], np.zeros(n), None
    for longest in range(n - 1, -1, -1):
        while open_[longest]:
            pattern = prices.pattern(longest, context) if prices else None
            if pattern is None or not all(open_[k] for k in pattern):
                prices = _Prices(lengths, np.where(open_, duals, 0), context)
                pattern = prices.pattern(longest, context)
            amount = min(left[k] / c for k, c in pattern.items())
            for k, c in pattern.items():
                left[k] -= amount * c
            ended = [k for k in sorted(pattern) if left[k] <= 1e-9 * demand[k]]
            basis[ended[0]], uses[ended[0]] = pattern, amount
            for k in ended[1:]:
                basis[k] = Counter({k: context // int(lengths[k])})
            open_[ended] = False
    return basis, uses


@dataclass
class Solution:
    """(pattern, uses) of the linear program, uses fractional; its value, the proven bound, columns priced, and why it stopped."""

    patterns: list[tuple[dict[int, int], float]]
    value: float
    bound: float
    columns: int
    reason: str


class _Master:
    """The linear program over the patterns known so far, by the revised simplex method.

    Uses of patterns must cover the demand. Two kinds of columns cost nothing:
    a slot may stay empty, or hold the next shorter length. They bound the
    duals, which makes few rounds of pricing enough.

    A column has a handful of lengths, so products and updates touch the places
    that are not 0 alone. There is no call of BLAS or LAPACK: these hang in a
    driver that has forked, and round differently by number of threads.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, context: int):
        self.lengths, self.demand, self.context, self.n = lengths, demand, context, len(lengths)
        self.known: set[tuple] = set()
        self.at, self.copies, self.starts = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.singles()

    def singles(self) -> None:
        self.start([Counter({k: self.context // int(size)}) for k, size in enumerate(self.lengths)])

    def start(self, basis: list[Counter]) -> None:
        self.basis = [(np.array(sorted(c), np.int64), np.array([float(c[k]) for k in sorted(c)])) for c in basis]
        self.cost = np.ones(self.n)
        self.invert()

    def _direction(self, column: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return (self.inverse[:, column[0]] * column[1]).sum(axis=1)

    def _pivot(self, direction: np.ndarray, out: int) -> np.ndarray:
        """Let a column with this direction take row ``out``; the row afterwards."""
        row = self.inverse[out] / direction[out]
        rows, places = np.flatnonzero(np.abs(direction) > 1e-13), np.flatnonzero(np.abs(row) > 1e-13)
        if 4 * len(rows) * len(places) < self.n * self.n:
            self.inverse[np.ix_(rows, places)] -= direction[rows, None] * row[places]
        else:
            self.inverse -= direction[:, None] * row
        self.inverse[out] = row
        return row

    def invert(self) -> None:
        """The inverse anew, column by column; a triangular basis has one place a step. Columns change places with their rows."""
        self.inverse, free = np.eye(self.n), np.ones(self.n, bool)
        basis, cost = [None] * self.n, np.ones(self.n)
        # rows that few columns have first, so that what is to come seldom has the places that are filled
        use = np.bincount(np.concatenate([c[0] for c in self.basis]), minlength=self.n)
        for p in sorted(range(self.n), key=lambda p: (len(self.basis[p][0]), int(use[self.basis[p][0]].min()))):
            direction = self._direction(self.basis[p])
            out = int(np.where(free, np.abs(direction), -1).argmax())
            if abs(direction[out]) < 1e-9:
                raise ArithmeticError("the basis is singular")
            self._pivot(direction, out)
            free[out], basis[out], cost[out] = False, self.basis[p], self.cost[p]
        self.basis, self.cost = basis, cost
        self.uses = np.maximum((self.inverse * self.demand).sum(axis=1), 0)

    def duals(self) -> np.ndarray:
        return (self.cost[:, None] * self.inverse).sum(axis=0)

    def off(self) -> float:
        """By how much, of the largest demand, what is used differs from the demand."""
        met = np.zeros(self.n)
        for (at, copies), uses in zip(self.basis, self.uses, strict=True):
            met[at] += copies * uses
        return float(np.abs(met - self.demand).max() / self.demand.max())

    def add(self, patterns: list[Counter], duals: np.ndarray) -> int:
        """Take the new ones that improve the value at these duals; how many."""
        fresh = []
        for p in patterns:
            name = tuple(sorted(p.items()))
            if name not in self.known and sum(duals[k] * c for k, c in name) > 1 + 1e-7:
                self.known.add(name)
                fresh.append(name)
        sizes = np.array([len(p) for p in fresh], np.int64)
        self.starts = np.concatenate((self.starts, len(self.at) + np.cumsum(sizes) - sizes))
        self.at = np.concatenate((self.at, np.array([k for p in fresh for k, _ in p], np.int64)))
        self.copies = np.concatenate((self.copies, np.array([c for p in fresh for _, c in p], float)))
        return len(fresh)

    def _entering(self, duals: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int, float] | None:
        """(column, its cost, what a use gains) with the most to gain."""
        gains = np.add.reduceat(duals[self.at] * self.copies, self.starts) - 1 if len(self.starts) else np.zeros(0)
        steps = duals[:-1] - duals[1:]
        best = max(gains.max(initial=0), -duals.min(), steps.max(initial=0))
        if best <= 1e-7:
            return None
        if len(gains) and gains.max() == best:
            j = int(gains.argmax())
            places = slice(self.starts[j], self.starts[j + 1] if j + 1 < len(self.starts) else None)
            return (self.at[places], self.copies[places]), 1, best
        if -duals.min() == best:
            return (np.array([int(duals.argmin())]), np.array([-1.0])), 0, best
        k = int(steps.argmax())
        return (np.array([k, k + 1]), np.array([1.0, -1.0])), 0, best

    def improve(self, enough: float) -> bool:
        """Pivot until no known column improves the value, or it is at most ``enough``; False when rounding stops it."""
        duals = self.duals()
        for pivot in range(1, 40 * self.n + 1000):
            found = self._entering(duals)
            if found is None:
                return True
            column, cost, gain = found
            direction = self._direction(column)
            falls = direction > 1e-7
            if not falls.any():
                return False
            ratios = np.where(falls, self.uses / np.where(falls, direction, 1), np.inf)
            amount = ratios.min()
            out = int(np.where(ratios <= amount + 1e-9, direction, -1).argmax())  # large pivots keep the basis well conditioned
            self.uses = np.maximum(self.uses - amount * direction, 0)
            self.uses[out] = amount
            duals = duals - gain * self._pivot(direction, out)
            self.basis[out], self.cost[out] = column, cost
            if pivot % 100 == 0:
                if self.off() > 1e-7:
                    self.invert()
                duals = self.duals()
            if pivot % 20 == 0 and (self.cost * self.uses).sum() <= enough:
                return True
        return False

    def settled(self) -> list[tuple[Counter, float]]:
        """Patterns whose uses meet the demand exactly: slots that stay empty or hold a shorter length are taken out or replaced."""
        used = [(dict(zip(at.tolist(), copies.tolist(), strict=True)), cost, uses) for (at, copies), cost, uses in zip(self.basis, self.cost, self.uses, strict=True) if uses > 1e-9]
        held = [[Counter(column), uses] for column, cost, uses in used if cost > 0]
        free = [(min(column, key=column.get), len(column) > 1, uses) for column, cost, uses in used if cost == 0]
        for k, shorter, amount in sorted(free, key=lambda f: -f[0]):
            for entry in list(held):
                pattern, uses = entry
                copies = pattern[k]
                if amount <= 1e-9:
                    break
                if not copies or uses <= 1e-9:
                    continue
                part = min(uses, amount / copies)
                changed = Counter({i: c for i, c in pattern.items() if i != k})
                if shorter:
                    changed[k - 1] += copies
                entry[1] -= part
                amount -= part * copies
                held.append([changed, part])
        return [(p, u) for p, u in held if u > 1e-9]


def solve_patterns(histogram: dict[int, int], context: int = CONTEXT, gap: float = GAP) -> Solution:
    """The cutting-stock program of a histogram of lengths below ``context``; the same solution on every machine.

    If rounding ever stops the program twice, its patterns are those of the best
    turn of pricing, and the reason is ``rounding``.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return Solution([], 0.0, 0.0, 0, "optimal")
    demand = np.array([histogram[int(k)] for k in lengths], float)
    master, columns, reason = _Master(lengths, demand, context), 0, ""
    # Duals in proportion to the lengths prove the first bound, the volume; half of the best duals so far steadies each pricing.
    centre, bound = lengths / context, float((demand * lengths).sum() / context)
    best_turn, turning = (float("inf"), [], np.zeros(0)), True
    while not reason:
        value = float((master.cost * master.uses).sum())
        if value <= bound * (1 + gap):
            reason = "bound"
            break
        duals, fresh = master.duals(), 0
        for share in (0.5, 0.0):
            asked = np.maximum(share * centre + (1 - share) * duals, 0)
            prices = _Prices(lengths, asked, context)
            worth = max(prices.best[context], 1.0)
            proven = float((asked * demand).sum() / worth)
            if proven > bound:
                bound, centre = proven, asked / worth
            with_each = asked + prices.best[context - lengths]
            fresh += master.add([prices.pattern(i, context) for i in np.argsort(-with_each, kind="stable")[:100].tolist()], duals)
            if fresh:
                break
        if not fresh:
            reason = "optimal"
            break
        columns += fresh
        try:
            if turning:
                turn, uses = _priced_in_turn(lengths, demand, np.maximum(centre, 1e-9) * (1 + TILT * lengths / context), context)
                columns += master.add(turn, duals)
                best_turn = min(best_turn, (float(uses.sum()), turn, uses), key=lambda t: t[0])
                if turning := bool(uses.sum() < value):
                    master.start(turn)
            steady = master.improve(bound * (1 + gap))
            if master.off() > 1e-9:
                master.invert()
        except ArithmeticError:
            steady = False
        if not steady:  # rounding spoiled the basis: begin again with the patterns known
            master.singles()
            try:
                if not master.improve(bound * (1 + gap)):
                    reason = "rounding"
            except ArithmeticError:
                reason = "rounding"
    if reason == "rounding":
        warnings.warn("rounding stopped the packing program; the patterns of its best turn are used", stacklevel=2)
        value, found = best_turn[0], list(zip(best_turn[1], best_turn[2].tolist(), strict=True))
    else:
        value, found = float((master.cost * master.uses).sum()), master.settled()
    patterns = [({int(lengths[i]): int(round(c)) for i, c in sorted(p.items()) if c > 0.5}, float(u)) for p, u in found if u > 1e-9]
    return Solution([(p, u) for p, u in patterns if p], value, bound, columns, reason)


def _subset(left: Counter, room: int) -> Counter:
    """What fills ``room`` best of the pieces left: a bounded subset sum, the longest pieces first; sums are bits of a number."""
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((k for k, n in left.items() if n > 0 and k <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            steps.append((length, sums))
            sums |= sums << length & mask
        if sums >> room & 1:
            break
    at, found = sums.bit_length() - 1, Counter()
    for length, before in reversed(steps):
        if not before >> at & 1:
            found[length] += 1
            at -= length
    return found


def whole_patterns(histogram: dict[int, int], solved: list[tuple[dict[int, int], float]], context: int = CONTEXT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(((length, copies), ...), sequences): rounded-down uses, then the best fills, longest first, of what is left."""
    left, out = Counter(histogram), []
    for pattern, uses in sorted(solved, key=lambda x: -x[1]):
        n = min([int(uses + 1e-6), *(left[k] // c for k, c in pattern.items())])
        if n > 0:
            out.append((tuple(sorted(pattern.items(), reverse=True)), n))
            for k, c in pattern.items():
                left[k] -= n * c
    rest: Counter = Counter()
    for length in sorted(left, reverse=True):
        while left[length] > 0:
            left[length] -= 1
            found = _subset(left, context - length)
            left -= found
            found[length] += 1
            rest[tuple(sorted(found.items(), reverse=True))] += 1
    return out + sorted(rest.items(), key=lambda x: (-x[1], x[0]))


def _empty(pattern: tuple[tuple[int, int], ...], context: int) -> int:
    fill = sum(k * c for k, c in pattern)
    return context - fill if fill & (fill - 1) else 0


def split_loose(patterns: list[tuple[tuple[tuple[int, int], ...], int]], context: int = CONTEXT, loose: float = LOOSE) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], Counter]:
    """(patterns kept, pieces of the others): the emptiest go until at most ``loose`` of all tokens is padding."""
    padding = sum(_empty(p, context) * n for p, n in patterns) - loose * sum(k * c * n for p, n in patterns for k, c in p)
    kept, loosely = [], Counter()
    for pattern, n in sorted(patterns, key=lambda x: -_empty(x[0], context)):
        empty = _empty(pattern, context)
        gone = min(n, math.ceil(padding / empty)) if padding > 0 and empty else 0
        padding -= gone * empty
        for length, copies in pattern:
            loosely[length] += gone * copies
        if n > gone:
            kept.append((pattern, n - gone))
    return kept, +loosely


def slot_runs(patterns: list[tuple[tuple[tuple[int, int], ...], int]], context: int = CONTEXT, loose: float = LOOSE) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset in it), by length and rank.

    Ranks first rank onwards of a length go to the sequences of one pattern, so
    many to each; the number of rows depends on the patterns, not the corpus.
    Rows with 0 copies are laid end to end from the offset on, across sequences.
    """
    rows, ranks, sequence = [], Counter(), 0
    kept, loosely = split_loose(patterns, context, loose)
    for pattern, n in kept:
        offset = 0
        for length, copies in pattern:
            rows.append((length, ranks[length], sequence, copies, offset))
            ranks[length] += n * copies
            offset += copies * length
        sequence += n
    offset = 0
    for length, n in sorted(loosely.items()):
        rows.append((length, ranks[length], sequence, 0, offset))
        offset += n * length
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, context: int = CONTEXT, end_id: int = END_ID, gap: float = GAP) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    pieces = cut_documents(docs, context, end_id)
    short = pieces.where(F.col("length") < context)
    counts = materialise(short.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most context - 1 rows
    runs = slot_runs(whole_patterns(histogram, solve_patterns(histogram, context, gap).patterns, context), context)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(runs[:, 0] << 40 | runs[:, 1], sizes << 40 | ranks, side="right") - 1
        run = runs[at]
        nth, copies, streamed = ranks - run[:, 1], np.maximum(run[:, 3], 1), run[:, 3] == 0
        place = run[:, 4] + np.where(streamed, nth, nth % copies) * sizes
        further = np.where(streamed, place // context, nth // copies)
        return pd.DataFrame({"sequence_id": run[:, 2] + further, "offset": np.where(streamed, place % context, place)})

    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_COUNTS else bases
    placed = short.join(bases, ["task", "length"]).withColumn("slot", slot("length", F.col("base") + F.col("place")))
    room = F.least(F.col("length"), context - F.col("slot.offset"))

    def part(skipped, length, sequence, offset):
        ids = F.substring(F.col("ids"), (4 * skipped + 1).cast("int"), (4 * length).cast("int"))
        return F.struct((F.col("start") + skipped).alias("start"), length.alias("length"), sequence.alias("sequence_id"), offset.alias("offset"), ids.alias("ids"))

    zero = F.lit(0).cast("long")
    first = part(zero, room, F.col("slot.sequence_id"), F.col("slot.offset"))
    second = part(room, F.col("length") - room, F.col("slot.sequence_id") + 1, zero)
    whole = F.struct("start", "length", F.col("slot.sequence_id").alias("sequence_id"), F.col("slot.offset").alias("offset"), "ids")
    parts = F.when(room < F.col("length"), F.array(first, second)).otherwise(F.array(whole))
    columns = ["doc_id", "start", "length", "doc_tokens"]
    mixed = placed.select("doc_id", "doc_tokens", F.explode(parts).alias("part")).select("doc_id", "part.start", "part.length", "doc_tokens", "part.sequence_id", "part.offset", "part.ids")
    own = ((F.col("task") + 1) * F.lit(1 << 40) + F.col("place")).alias("sequence_id")
    return pieces.where(F.col("length") == context).select(*columns, own, zero.alias("offset"), "ids").unionByName(mixed)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

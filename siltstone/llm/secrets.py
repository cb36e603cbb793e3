"""Operator 5: secret scans by patterns and by two character Markov models.

Patterns find assignments, access keys and hexadecimal runs. Beside them, runs
of key characters are scored by the log-likelihood ratio of two first-order
character models, one of random strings, one of ordinary identifiers, both
trained from labelled samples; a run whose mean ratio per character reaches the
threshold is a span of kind ``markov`` unless a pattern's span overlaps it.
Every span has its ratio, so the models judge the patterns' values too.

Texts are scanned in Arrow slices: classes of bytes, run lengths, ratios and
code point offsets are numpy operations over the slice; only texts that hold a
keyword meet the assignment pattern.

Labelled samples: random strings are drawn with fixed seeds from the usual key
alphabets; together with the patterns' values in a bounded sample of documents
(``SAMPLE`` of them) they are labelled 1, the other words of that sample 0. A
fifth of the sample and other random strings are held apart: on them the
threshold is fitted, and recall and false rate are measured.

Defined cases: a null or empty text has no spans (the digest is that of the
empty string); equal texts have equal spans; an empty table gives an empty
result and trains on the random strings alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, map_arrow, materialise, slices, text_of

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
#: Every assignment holds one of these, lower-cased.
KEYWORDS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 12, "access": 18, "hex": 16, "markov": 16}
#: About so many documents' words train the model of ordinary identifiers.
SAMPLE = 2000
#: The chosen documents meet in so many tasks, after a scan by all.
COUNT_TASKS = 8
RANDOM_STRINGS = 4000
#: Ordinary words of this length and more, held apart, test the threshold; the share found falsely weighs so many times the share missed.
WORD, FALSE_WEIGHT = 8, 10
#: Cells of the grid of mean ratios from -4 to 4 nats on which the threshold is fitted.
CELLS = 1600

_BYTES = np.arange(256)


def _among(characters: bytes) -> np.ndarray:
    return np.isin(_BYTES, list(characters))


_LOWER, _UPPER, _DIGITS = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58))
HEX = _among(_DIGITS + b"abcdef")
ACCESS = _among(_UPPER + _DIGITS)
TOKEN = _among(_LOWER + _UPPER + _DIGITS + b"+/_=-")
#: The models' states: 0 for the start, then one for each token character.
STATE = np.where(TOKEN, np.cumsum(TOKEN), 0)
STATES = int(STATE.max()) + 1


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least`` marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def transitions(tokens: list[bytes]) -> np.ndarray:
    """Counts of (state, next state) over tokens, starts included."""
    counts = np.zeros((STATES, STATES))
    if tokens:
        data = np.frombuffer(b"\n".join([b"", *tokens]), np.uint8)
        states = STATE[data]
        np.add.at(counts, (states[:-1], states[1:]), 1)
    counts[:, 0] = 0
    return counts


def random_strings(n: int = RANDOM_STRINGS, seed: int = 11) -> list[bytes]:
    """Labelled samples of key-like strings: hexadecimal, letters with digits, base64."""
    rnd = random.Random(seed)
    alphabets = [_DIGITS + b"abcdef", _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + b"+/", _LOWER + _UPPER + _DIGITS + b"-_"]
    return [bytes(rnd.choices(alphabets[i % len(alphabets)], k=rnd.randrange(16, 48))) for i in range(n)]


def base_spans(joined: bytes, data: np.ndarray) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) in bytes over texts joined by line feeds, which no pattern crosses."""
    found = []
    for s, e in zip(*(x.tolist() for x in runs(HEX[data], LEAST["hex"])), strict=True):
        found.append((s, e, "hex", s, e))
    at = joined.find(b"AKIA")
    while at >= 0:
        end = at + 4
        while end < len(data) and ACCESS[data[end]]:
            end += 1
        if end - at >= LEAST["access"]:
            found.append((at, end, "access", at, end))
        at = joined.find(b"AKIA", end)
    lowered = joined.lower()
    done = 0
    hits = sorted(h for k in KEYWORDS for h in _places(lowered, k))
    for hit in hits:
        if hit < done:
            continue
        start = joined.rfind(b"\n", 0, hit) + 1
        stop = joined.find(b"\n", hit)
        stop = len(joined) if stop < 0 else stop
        for m in ASSIGN.finditer(joined, start, stop):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
        done = stop
    return found


def _places(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + 1)


class Models:
    """Log-likelihood ratios of the two character models, by pair of states, and the threshold of the mean ratio."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray):
        def logs(counts: np.ndarray) -> np.ndarray:
            smoothed = counts[:, 1:] + 0.5
            return np.log(smoothed / smoothed.sum(axis=1, keepdims=True))

        self.ratio = np.zeros((STATES, STATES))
        self.ratio[:, 1:] = logs(random_counts) - logs(ordinary_counts)
        self.threshold = self.recall_random = self.recall_values = self.false_rate = 0.0

    def means(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The mean ratio of each run."""
        states = STATE[data]
        before = np.concatenate(([0], states[:-1]))
        gains = np.concatenate(([0.0], np.cumsum(self.ratio[before, states])))
        first = self.ratio[before[starts], states[starts]]
        total = gains[ends] - gains[starts] - first + self.ratio[0, states[starts]]
        return total / (ends - starts)

    def fit_threshold(self, random_: np.ndarray, values: np.ndarray, ordinary: np.ndarray) -> None:
        """From counts by cell of samples held apart: the least weighted sum of the shares missed and found falsely.

        Keys nobody labelled count as ordinary words; few as they are, they
        raise the false share of all thresholds below them alike.
        """
        below = lambda n: np.concatenate(([0], np.cumsum(n))) / max(1, n.sum())
        missed, wrong = below(random_ + values), 1 - below(ordinary) if ordinary.sum() else np.zeros(CELLS + 1)
        cost = missed + FALSE_WEIGHT * wrong
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        at = int(best[len(best) // 2])
        self.threshold = at * 8 / CELLS - 4
        self.recall_random, self.recall_values, self.false_rate = float(1 - below(random_)[at]), float(1 - below(values)[at]), float(wrong[at])


def cells(means: np.ndarray) -> np.ndarray:
    """How many mean ratios lie in each cell of the grid."""
    return np.bincount(np.clip(np.floor((means + 4) * CELLS / 8).astype(np.int64), 0, CELLS - 1), minlength=CELLS)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts joined by line feeds, as bytes and array, and where each begins."""
    joined = b"\n".join(texts)
    lengths = np.array([len(t) for t in texts])
    return joined, np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))


def labelled(joined: bytes, data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts and ends of the patterns' values, starts and ends of other runs of key characters) as two rows each."""
    covered, values = np.zeros(len(data) + 1, bool), []
    for s, e, _, a, b in base_spans(joined, data):
        covered[s:e] = True
        values.append((a, b))
    return np.array(values, np.int64).reshape(-1, 2).T, np.array(runs(TOKEN[data] & ~covered[:-1], least))


def _summed(docs: DataFrame, measure: Callable, shape: tuple[int, ...], text: str) -> np.ndarray:
    """The sum of ``measure(joined, data)`` over slices of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for part in slices(batches, 0, 2 << 20):
            joined, data, _ = _joined(part.column(0).cast(pa.binary()).to_pylist())
            if len(data):
                total += measure(joined, data)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    partial = map_arrow(docs.select(text_of(text).alias("text")).repartition(COUNT_TASKS), count, "counts binary")
    return sum((np.frombuffer(r["counts"], float).reshape(shape) for r in partial.collect()), np.zeros(shape))


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> Models:
    """Models from the random strings and about ``sample`` documents chosen by a hash of id and text, the threshold from a fifth of these.

    Rows equal in both count once, so that no group of copies fills the sample.
    """
    every = max(1, docs.count() // sample)
    hashed = docs.select(F.xxhash64("doc_id", text).alias("hash"), F.col(text).alias("text")).withColumn("place", F.pmod("hash", F.lit(5 * every)))
    chosen = hashed.where(F.col("place") % every == 0).groupBy("hash").agg(F.first("text").alias("text"), (F.first("place") == 0).alias("apart"))
    chosen = materialise(chosen.drop("hash"), "secrets-sample")

    def steps(joined: bytes, data: np.ndarray) -> np.ndarray:
        values, others = labelled(joined, data, 5)
        return np.stack([transitions([joined[s:e] for s, e in zip(*x.tolist(), strict=True)]) for x in (others, values)])

    counts = _summed(chosen.where("not apart"), steps, (2, STATES, STATES), "text")
    models = Models(transitions(random_strings()) + counts[1], counts[0])

    def placed(joined: bytes, data: np.ndarray) -> np.ndarray:
        values, others = labelled(joined, data, WORD)
        return np.stack([cells(models.means(data, *x)) for x in (others, values)])

    apart = _summed(chosen.where("apart"), placed, (2, CELLS), "text")
    _, data, begins = _joined(fresh := random_strings(seed=12))
    models.fit_threshold(cells(models.means(data, begins, begins + [len(x) for x in fresh])), apart[1], apart[0])
    return models


def scan(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """(key, spans): for each text an array of (kind, start, end, value_start, value_end, ratio), in code points, end exclusive."""
    least = models.threshold if threshold is None else threshold

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            joined, data, begins = _joined(texts)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            found = base_spans(joined, data)
            starts, ends = runs(TOKEN[data], LEAST["markov"])
            if len(starts):
                good = models.means(data, starts, ends) >= least
                covered = np.zeros(len(data) + 1, np.int32)
                for s, e, *_ in found:
                    covered[s] += 1
                    covered[e] -= 1
                under = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
                good &= under[ends] == under[starts]
                found += [(s, e, "markov", s, e) for s, e in zip(starts[good].tolist(), ends[good].tolist(), strict=True)]
            spans: list[list] = [[] for _ in texts]
            if found:
                owner = np.searchsorted(begins, [f[0] for f in found], side="right") - 1
                ratios = np.round(models.means(data, np.array([f[3] for f in found]), np.array([f[4] for f in found])), 9).tolist()
                for i, (s, e, kind, a, b), ratio in zip(owner.tolist(), found, ratios, strict=True):
                    zero = int(points[begins[i]])
                    spans[i].append((int(points[s]) - zero, KINDS.index(kind), int(points[e]) - zero, int(points[a]) - zero, int(points[b]) - zero, ratio))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "value_start": a, "value_end": b, "ratio": r} for s, k, e, a, b, r in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, spans_type)], names=[key, "spans"])

    spans_type = pa.list_(pa.struct([("kind", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "value_start", "value_end")], ("ratio", pa.float64())]))
    kind = docs.schema[key].dataType.simpleString()
    fields = "kind:string,start:bigint,end:bigint,value_start:bigint,value_end:bigint,ratio:double"
    return map_arrow(docs.select(key, text_of(text).alias("text")), find, f"`{key}` {kind}, spans array<struct<{fields}>>")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    models = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scan(documents(spark, sf_dir), models)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans, start: str = "start", end: str = "end"):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s[start].cast("string"), s[end].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("markov"),
        F.size(F.filter(base, lambda s: s["ratio"] >= models.threshold)).cast("long").alias("n_base_random"),
        listed(base, "value_start", "value_end").alias("value_spans"),
    )


def brute_force(text: str | None) -> tuple:
    """The base spans of one text by the plain patterns over code points; for tests."""
    text = text or ""
    spans = []
    for m in re.finditer(ASSIGN.pattern.decode(), text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return tuple(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(named.encode()).hexdigest(), named

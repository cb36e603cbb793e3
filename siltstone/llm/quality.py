"""Operator 10: quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

A text becomes a vector of statistics. ``FEATURES`` random cosines of the
standardised vector approximate a Gaussian kernel. Partitions sum their normal
equations, the sums are added up in two levels, and the driver solves one
system of that fixed size. Raw scores of the calibration fold are counted on a
fixed grid (at most ``GRID`` rows) and pooled to a monotone curve.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0:
folds 1 to 3 fit the ridge, fold 4 the calibration. Scores depend on nothing
but the text.

Defined cases: null text counts as empty, and empty texts have a score like
any other; null ids take the fold of the empty string and match no label; rows
with null labels are not learned from; of a document labelled several times
the mean label counts, of half or more as 1; without any label, or with one
kind only, every score is the share of label 1 (1 without labels); an empty
table gives an empty result; other columns, whatever their names, are handed
through by ``good_documents`` and read by nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import documents, map_arrow, materialise, slices, text_of

FEATURES = 256
SEED = 20240607
RIDGE = 1e-3
THRESHOLD = 0.3
GRID = 3000
#: Partial sums meet in so many tasks before the driver adds them up.
MEETING_TASKS = 8

_BYTES = np.arange(256)
_ASCII_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_ASCII_LETTER = _ASCII_UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, list(b".,"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_ASCII_LETTER & ~_DIGIT & ~_STOP
_HIGH = _BYTES >= 128
_CLASSES = np.array([_ASCII_UPPER, _ASCII_LETTER, _DIGIT, _SPACE, _STOP, _SYMBOL, _HIGH], float).T
STATISTICS = 18


def statistics(data: bytes) -> list[float]:
    """The vector of one text: sizes, character classes, repetition, entropy."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    upper, letter, digit, space, stop, symbol, high = (counts @ _CLASSES).tolist()
    words = data.split()
    seen = Counter(words)
    n = max(1, len(words))
    top = [c for _, c in seen.most_common(3)] or [0]
    lines = data.split(b"\n")
    share = counts[counts > 0] / size
    bare = sum(c for w, c in seen.items() if len(w) <= 3 and not (w.isalnum() or w[0] >= 128))
    return [
        math.log1p(len(data)),
        math.log1p(len(words)),
        min(len(data) / n, 40.0),
        len(seen) / n,
        top[0] / n,
        sum(top) / n,
        upper / max(1.0, letter),
        digit / size,
        stop / size,
        math.log1p(100 * symbol / size),
        space / size,
        len(lines) / n,
        len(set(lines)) / len(lines),
        high / size,
        float(-(share * np.log2(share)).sum()) if len(data) else 0.0,
        bare / n,
        math.log1p(max(map(len, words), default=0)),
        math.log1p(100 * symbol / n),
    ]


@dataclass
class Model:
    """All a scoring task needs; its size depends on nothing but the parameters."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), float(self.values[0]))
        raw = fourier(x, self.mean, self.scale) @ self.weights
        calibrated = np.interp(raw, self.knots, self.values)
        # A hundredth of the raw score keeps order among scores that the calibration ties.
        return np.round(0.99 * calibrated + 0.01 * np.clip(raw, 0, 1), 9)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random cosines of standardised vectors, and a constant."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(x.shape[1], FEATURES)) / math.sqrt(x.shape[1])
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack((math.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones((len(x), 1))))


def fold(key: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, x): the statistics of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            x = [statistics(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=[key, "x"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text_of(text).alias("text")), measure, f"`{key}` {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed_equations(training: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """[Z'Z | Z'y] over all rows of (x, y): partition sums, met in a few tasks, then on the driver."""
    shape = (FEATURES + 1, FEATURES + 2)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                z, y = fourier(_matrix(batch.column(0)), mean, scale), batch.column(1).to_numpy()
                total += np.hstack((z.T @ z, (z.T @ y)[:, None]))
        if total.any():
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for held in batch.column(0):
                total += np.frombuffer(held.as_buffer(), float).reshape(shape)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    partial = map_arrow(training.select("x", "y"), equations, "sums binary").repartition(MEETING_TASKS)
    return sum((np.frombuffer(r["sums"], float).reshape(shape) for r in map_arrow(partial, meet, "sums binary").collect()), np.zeros(shape))


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Isotonic regression: (first, last, mean) of pooled runs of a weighted sequence."""
    blocks: list[list[float]] = []
    for i, (v, w) in enumerate(zip(values, weights, strict=True)):
        blocks.append([i, i, v * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [(int(a), int(b), s / w) for a, b, s, w in blocks]


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """Learn from (key, x) and (key, label); folds 1 to 3 for the ridge, fold 4 for the calibration."""
    known = labels.select(F.col(key).alias("label_key"), F.col(label).cast("double").alias("label")).where("label is not null and label_key is not null")
    known = known.where(fold("label_key") != 0).groupBy("label_key").agg((F.avg("label") >= 0.5).cast("double").alias("y"))
    rows = materialise(measured.select(F.col(key).alias("label_key"), "x").join(known, "label_key").select("x", "y", fold("label_key").alias("fold")), "quality-training")
    moments = rows.agg(
        F.count("*").alias("n"),
        F.avg("y").alias("share"),
        *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(STATISTICS)],
        *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(STATISTICS)],
    ).first()
    if not moments["n"] or moments["share"] in (0.0, 1.0):
        flat = np.array([1.0 if not moments["n"] else moments["share"]])
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, flat, flat)
    mean = np.round([moments[f"m{k}"] for k in range(STATISTICS)], 9)
    scale = np.round([moments[f"s{k}"] for k in range(STATISTICS)], 9)
    scale[scale < 1e-9] = 1.0
    sums = _summed_equations(rows.where("fold < 4"), mean, scale)
    if not sums.any():
        sums = _summed_equations(rows, mean, scale)
    count = sums[-1, -2]
    penalty = RIDGE * count * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(fourier(_matrix(batch.column(0)), mean, scale) @ weights, -1, 2)
                cell = np.round((raw + 1) * (GRID / 3)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "y"])

    held = rows.where("fold = 4") if rows.where("fold = 4").limit(1).count() else rows
    cells = map_arrow(held.select("x", "y"), place, "cell long, y double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("cell").collect()  # at most GRID + 1 rows
    at = np.array([c["cell"] for c in cells]) * (3 / GRID) - 1
    weight = np.array([c["n"] for c in cells], float)
    pooled = pool_adjacent(np.array([c["ones"] for c in cells]) / weight, weight)
    knots = np.array([x for a, b, _ in pooled for x in ((at[a], at[b]) if b > a else (at[a],))])
    values = np.array([v for a, b, v in pooled for _ in range(2 if b > a else 1)])
    return Model(mean, scale, weights, knots, values)


def score(measured: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) from (key, x)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=[key, "score"])

    kind = measured.schema[key].dataType.simpleString()
    return map_arrow(measured.select(key, "x"), apply, f"`{key}` {kind}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, all columns kept, without a shuffle of texts."""
    measured = materialise(document_statistics(docs), "quality-statistics")
    model = fit(measured, labels)
    whole = docs.select(text_of(docs["text"]).alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            x = np.array([statistics(t) for t in part.column(0).cast(pa.binary()).to_pylist()])
            good = model.score(x) >= threshold
            yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(good))], names=["document"])

    return whole.mapInArrow(keep, T.StructType([whole.schema["document"]])).select("document.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = materialise(document_statistics(docs), "quality-statistics")
    scored = score(measured, fit(measured, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality classification with naive Bayes support vectors.

Features are indicators of hashed character n-grams and of word-repetition patterns. Class counts of every labelled training row give
each feature's log-count ratio; the indicators scaled by those ratios are the input of a linear
hinge-loss model, fitted by dual coordinate descent. Ratios cover all training rows (a distributed sum
into 2**BITS buckets); only the linear model is fitted on a bounded sample, at most ``fit_rows`` rows that a
hash of the id picks, whatever the length of their texts. A row of the sample is at most a bitmap of all features (16 KB). A sigmoid
fitted on a part of the sample that the model has not seen turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import accepted, bitmap, scratch, slices, with_maybe
from .ngrams import codes, hashed

BITS = 17
SIZES = (1, 2, 3, 4)
SMOOTHING = 1.0
#: Rows that the hinge-loss model is fitted on by default.
FIT_ROWS = 4000
COST = 1.0
#: Distances at which words are compared for repetition.
GAPS = (1, 2, 3, 4, 6, 8)
EPOCHS = 12
THRESHOLD = 0.7
#: Size (2**24 bits, 2 MB) of the bitmap over labelled ids.
BITMAP_BITS = 24
#: Places for each repetition pattern, after the buckets of n-grams: one pattern a gap, and the share of distinct words.
PLACES = 16
FEATURES = (1 << BITS) + PLACES * (len(GAPS) + 1)
#: Cells of the sample that the driver holds unpacked; beyond it they are unpacked at each use.
UNPACKED_CELLS = 1 << 25


class Cells:
    """Distinct features of texts; holds the scratch array that finds duplicates."""

    def __init__(self) -> None:
        self.seen = np.zeros(FEATURES, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        parts = list(hashed(codes(text), SIZES, BITS))
        words = text.split()
        if words:
            # How many words repeat the word some places before, and how many are distinct, in eighths.
            ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1]
            levels = [(i, int(8 * (ids[gap:] == ids[:-gap]).mean())) for i, gap in enumerate(GAPS) if len(ids) > gap]
            levels.append((len(GAPS), int(8 * (ids.max() + 1) / len(ids))))
            parts.append(np.array([(1 << BITS) + PLACES * i + level for i, level in levels]))
        if not parts:
            return np.zeros(0, np.int64)
        every = np.concatenate(parts)
        self.seen[every] = np.arange(len(every), dtype=np.int32)
        return every[self.seen[every] == np.arange(len(every), dtype=np.int32)]


def packed(cells: np.ndarray) -> bytes:
    """Cells as sorted integers or as a bitmap, whichever is shorter."""
    if 4 * len(cells) <= FEATURES // 8:
        return b"i" + np.sort(cells).astype("<i4").tobytes()
    flags = np.zeros(FEATURES, bool)
    flags[cells] = True
    return b"b" + np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"i":
        return np.frombuffer(data, "<i4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=FEATURES)).astype(np.int32)


class Sample(Sequence):
    """Packed rows of cells, unpacked all at once where that is small and else at each use."""

    def __init__(self, rows: list[bytes], cells: int):
        self.rows = [unpacked(r) for r in rows] if cells <= UNPACKED_CELLS else rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        row = self.rows[i]
        return unpacked(row) if isinstance(row, bytes) else row

    def only(self, places: np.ndarray) -> Sample:
        part = Sample([], 0)
        part.rows = [self.rows[i] for i in places]
        return part


class QualityModel:
    """Weights per bucket (ratio times hinge-loss weight), bias, and the sigmoid's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, cells: np.ndarray) -> float:
        return float(self.weights[cells].sum()) / np.sqrt(max(1, len(cells))) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60))))


def flat(docs: np.ndarray) -> QualityModel:
    """The model that knows only the numbers of rows of labels 0 and 1."""
    share = min(max(docs[1] / docs.sum(), 0.01), 0.99) if docs.any() else 0.5
    return QualityModel(np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))


def descend(rows: Sequence[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7):
    """Dual coordinate descent for min |w|^2/2 + C sum max(0, 1 - y (w.x + b)), b as the weight of a constant feature.

    Row i is the indicator of ``rows[i]`` times ``ratio``, divided by the root of its length. Returns w times ``ratio``, and b.
    """
    weights, bias = np.zeros(len(ratio)), 0.0
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    diag = np.array([scale[i] ** 2 * np.square(ratio[r]).sum() + 1 for i, r in enumerate(rows)])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            row = rows[i]
            x = ratio[row] * scale[i]
            g = y[i] * (weights[row] @ x + bias) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                weights[row] += step * x
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-4:
            break
    return weights * ratio, bias


def platt(margin: np.ndarray, positive: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the sigmoid by Newton steps on smoothed targets."""
    hits = positive.sum()
    target = np.where(positive, (hits + 1) / (hits + 2), 1 / (len(positive) - hits + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        r, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * margin).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, text, label) of the documents that have a label, written once; of repeated ids every pair of a document and a label.

    A bitmap of fixed size over the labelled ids lets only (nearly) those documents into the shuffle of the join.
    """
    wanted = labels.select(id_col, label_col).filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = docs.select(id_col, F.col(text_col)).filter(F.col(id_col).isNotNull())
    near = with_maybe(rows, bitmap(wanted, [id_col], BITMAP_BITS), [id_col], BITMAP_BITS).filter("__maybe").drop("__maybe")
    return scratch(near.join(wanted.hint("merge"), id_col), "quality-labelled")


def training_rows(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(``__id``, ``__text``, ``__y``) of the rows with a text and a label 0 or 1."""
    rows = labelled.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"), F.col(label_col).cast("int").alias("__y"))
    return rows.filter(F.col("__y").isin(0, 1) & F.col("__text").isNotNull())


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rows by class, rows by class and feature) over all training rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, cells = np.zeros((2, FEATURES + 1), np.int64), Cells()
        for b in batches:
            for y, text in zip(b["__y"].tolist(), b["__text"]):
                sums[y, cells(text)] += 1
                sums[y, -1] += 1
        for y in (0, 1):
            at = np.flatnonzero(sums[y])
            yield pd.DataFrame({"y": y, "cell": at, "n": sums[y, at]})

    got = train.mapInPandas(count, "y int, cell int, n bigint").groupBy("y", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, FEATURES + 1))
    counts[got["y"].to_numpy(), got["cell"].to_numpy()] = got["n"].to_numpy()
    return counts[:, -1], counts[:, :-1]


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """log(p / |p|) - log(q / |q|) of the smoothed counts p of class 1 and q of class 0; 0 for features never seen."""
    p, q = counts[1] + SMOOTHING, counts[0] + SMOOTHING
    return np.where(counts.sum(axis=0) == 0, 0.0, np.log(p / p.sum()) - np.log(q / q.sum()))


def sample(train: DataFrame, fit_rows: int) -> tuple[Sample, np.ndarray]:
    """(rows of cells, labels 1 and -1): of each class the ``fit_rows`` / 2 rows whose ids have the smallest hashes, the hash of the text
    deciding between repeated ids; in a fixed order."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = Cells()
        for b in batches:
            own = [cells(t) for t in b["__text"]]
            yield pd.DataFrame({"y": b["__y"], "n": [len(c) for c in own], "cells": [packed(c) for c in own]})

    picked = train.withColumn("__pick", F.struct(F.xxhash64("__id", F.lit("fit")).alias("a"), F.xxhash64("__text").alias("b")))
    got: list[tuple[int, bytes, int]] = []
    for label in (0, 1):
        own = picked.filter(F.col("__y") == label)
        # Only hashes are sorted; texts are read again for the rows that are picked.
        last = own.select("__pick").orderBy("__pick").limit(fit_rows // 2).agg(F.max("__pick").alias("m")).first().m
        if last is not None:
            mine = own.filter(F.col("__pick") <= F.struct(F.lit(last.a).alias("a"), F.lit(last.b).alias("b")))
            rows = mine.mapInPandas(pack, "y int, n bigint, cells binary").limit(fit_rows // 2).toArrow()
            got += zip(rows["y"].to_pylist(), rows["cells"].to_pylist(), rows["n"].to_pylist())
    got.sort()  # tasks end in any order; the fit must not depend on it
    order = np.random.default_rng(11).permutation(len(got)).tolist()
    return Sample([got[i][1] for i in order], sum(n for _, _, n in got)), np.array([1 if got[i][0] else -1 for i in order])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from rows of text and a label 0 or 1; other labels and null texts are skipped, repeated rows count each time.

    ``fit_rows`` bounds the rows that the linear model is fitted on; counts and ratios are those of all rows.
    Without rows of both classes the model scores everything with the share of label 1 (0.5 for no rows).
    """
    train = training_rows(labelled, id_col, text_col, label_col)
    docs, counts = class_counts(train)
    if not docs.all():
        return flat(docs)
    ratio = log_count_ratios(counts)
    rows, y = sample(train, fit_rows)
    if len(set(y.tolist())) < 2:
        return flat(docs)
    held = np.arange(len(rows)) % 4 == 0
    if not all((y[m] > 0).any() and (y[m] < 0).any() for m in (held, ~held)):
        held[:] = False  # too few rows to spare some for the sigmoid
    fitted = np.flatnonzero(~held)
    weights, bias = descend(rows.only(fitted), y[fitted], ratio)
    model = QualityModel(weights, bias, 1.0, 0.0)
    seen = np.flatnonzero(held) if held.any() else fitted
    model.slope, model.offset = platt(np.array([model.margin(rows[i]) for i in seen]), y[seen] > 0)
    # The sample takes the classes in other shares than the training rows have.
    model.offset += float(np.log(docs[1] / docs[0]) - np.log((y > 0).sum() / (y < 0).sum()))
    return model


def predict(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: id, the columns named in ``keep``, ``score`` (0 to 1), ``predicted`` (1 if score >= threshold).

    Null and empty texts have no features and get the score of the bias. Whole texts of any length are
    scored. Extra columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cells = shared.value, Cells()
        for b in slices(batches):
            score = np.array([model.score(model.margin(cells(t))) for t in b.column("__text").to_pylist()], dtype=float)
            others = [n for n in b.schema.names if n != "__text"]
            made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*map(b.column, others), *made], names=[*others, "score", "predicted"])

    rows = docs.select(id_col, *keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    worker: list[Cells] = []

    def judge(texts: list[str | None]) -> list[bool]:
        if not worker:
            worker.append(Cells())
        return [shared.value.score(shared.value.margin(worker[0](t))) >= threshold for t in texts]

    return accepted(docs, text_col, judge)

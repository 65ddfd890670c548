"""Quality classifier: Naive Bayes support vectors (NB-SVM).

Features are hashed indicators of words and word pairs, as they are and by their shapes, of a pair of equal words, and
of the order of magnitude of the length. The class log-count ratios of the indicators, over a bounded
sample of labelled rows, scale them; a linear model with hinge loss is fitted on the scaled, unit-length rows by dual
coordinate descent; a logistic curve through the held-back margins of an inner fold makes scores of the margins.

Defined results: null or empty texts have no features and get the score of the bias alone; null ids are scored and
never learnt from; a label row without a document or with a null label is ignored, and of several labels of one id
the greatest counts; without both labels in the sample every score is the share of label 1 (0.5 without any);
repeated rows repeat their score; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cindersift.llm.hashing import U, mixed, pieces, returning, word_hashes

BITS = 18
#: Bytes to their shape: letters, digits, bytes above 127; white space and punctuation as they are. Words are lower-cased
#: when hashed, so capitals get a sign of their own.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("^"), ord("a"), ord("a")
#: Labelled rows of each class that are learnt from, chosen by a hash of their id.
SAMPLE = 2500
SMOOTH = 1.0
COST = 1.0
EPOCHS = 30
THRESHOLD = 0.3


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words, word pairs, shapes, shape pairs, repeated words and length of each text, and their offsets."""
    w, wat = word_hashes(data, at)
    s, _ = word_hashes(_SHAPE[data], at)
    shift = U(64 - BITS)
    n = len(w)
    again = np.zeros(n, U)
    again[1:] = np.where(w[1:] == w[:-1], U(0x51ED270B), U(0x2545F491))
    pair = np.zeros(n, U)
    pair[1:] = mixed(w[:-1] * U(3) + w[1:])
    shapes = np.zeros(n, U)
    shapes[1:] = mixed(s[:-1] * U(5) + s[1:])
    every = np.stack([(x >> shift).astype(np.int32) for x in (w, mixed(s + U(9)))] + [(x >> shift).astype(np.int32) for x in (pair, shapes, mixed(again))])
    parts = []
    for lo, hi in zip(wat[:-1].tolist(), wat[1:].tolist()):
        size = (mixed(np.array([int(hi - lo).bit_length() + 1000], U)) >> shift).astype(np.int32)
        x = np.sort(np.concatenate([every[:2, lo:hi].ravel(), every[2:, lo + 1 : hi].ravel(), size if hi > lo else size[:0]]))
        keep = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        parts.append(x[keep])
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))


@dataclass
class Model:
    weights: np.ndarray  # ratio times weight of each feature, for rows of unit length
    squares: np.ndarray  # squared ratios
    bias: float
    slope: float
    offset: float

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(np.diff(at))  # rows with features; each is summed alone, so equal rows score equally
        total, length = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        if len(some):
            total[some] = np.add.reduceat(self.weights[x], at[some])
            length[some] = np.add.reduceat(self.squares[x], at[some])
        margin = total / np.sqrt(np.maximum(length, 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, at most ``cost`` a row; the last weight is the bias.

    The dual's variables lie between 0 and the row's cost; a step minimises over one of them exactly.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            if alpha[i] == 0 and gradient >= 0 or alpha[i] == cost[i] and gradient <= 0:
                continue
            worst = max(worst, abs(gradient))
            new = min(max(0.0, alpha[i] - gradient / norm[i]), cost[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[x] += step * v
            bias += step
        if worst < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - label) * margin).sum() + 1e-3 * a, (p - label).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fitted(rows: list[np.ndarray], label: np.ndarray, prior: float | None = None) -> Model:
    """A model from feature rows and labels of 0 and 1. prior: share of label 1 among all labelled rows, if the sample's differs."""
    size = 1 << BITS
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or not len(label):
        p = min(max(prior if prior is not None else share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.ones(size), 0.0, 1.0, float(np.log(p / (1 - p))))

    def fit(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = [np.full(size, SMOOTH), np.full(size, SMOOTH)]
        for i in idx:
            counts[label[i]][rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        scaled = []
        for i in idx:
            v = ratio[rows[i]]
            scaled.append((rows[i], v / max(np.sqrt(v @ v), 1e-6)))
        y = np.where(label[idx] == 1, 1.0, -1.0)
        cost = COST * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
        w, bias = _svm(scaled, y, cost, size)
        return w * ratio, ratio * ratio, bias

    fold = np.arange(len(rows)) % 4 == 3
    if len(set(label[fold])) < 2 or len(set(label[~fold])) < 2:
        fold = np.zeros(len(rows), bool)
    margins = np.zeros(len(rows))
    held = []
    for part in ([np.arange(len(rows)) % 4 == k for k in range(4)] if fold.any() else [np.ones(len(rows), bool)]):
        train = np.flatnonzero(~part) if fold.any() else np.flatnonzero(part)
        if len(set(label[train])) < 2:
            continue
        w, s, bias = fit(train)
        for i in np.flatnonzero(part):
            margins[i] = w[rows[i]].sum() / np.sqrt(max(s[rows[i]].sum(), 1e-12)) + bias
            held.append(i)
    a, b = _logistic(margins[held], label[held].astype(float))
    if prior is not None:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        b += float(np.log(p / (1 - p)) - np.log(share / (1 - share)))
    w, s, bias = fit(np.arange(len(rows)))
    return Model(w, s, bias, a, b)


@returning
def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in pieces(b.column(2)):
            x, xat = features(data, at)
            own = pa.ListArray.from_arrays(pa.array(xat.astype(np.int32)), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], own], ["id", "label", "x"])


def _scored(model: Model, col: int, threshold: float | None):
    """All columns and the score; with a threshold, all columns of the rows that reach it."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.score(*features(data, at)) for _, _, data, at in pieces(b.column(col))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            if threshold is None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [f"c{i}" for i in range(b.num_columns + 1)])
            else:
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(s >= threshold)).columns, [f"c{i}" for i in range(b.num_columns)])

    return returning(score)


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def trained(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model learnt from at most ``sample`` rows of each label, of ids outside fold 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.where((fold("id") != 0) & F.col("label").isin(0, 1))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    chosen = []
    for label in (0, 1):  # one bounded top-k each
        chosen += [(r["id"], r["label"]) for r in known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not chosen:
        return fitted([], np.zeros(0, int), prior)
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, label int"))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("id", "label", "text")
    rows = texts.mapInArrow(_features, "id long, label int, x array<int>").groupBy("id").agg(F.max("label").alias("label"), F.min("x").alias("x"))
    got = rows.toArrow().sort_by("id")  # at most 2 * sample rows
    x = got.column("x").combine_chunks()
    at = np.append(0, np.cumsum(x.value_lengths().fill_null(0).to_numpy()))
    flat = x.flatten().to_numpy().astype(np.int64)
    return fitted([flat[lo:hi] for lo, hi in zip(at[:-1], at[1:])], got.column("label").to_numpy().astype(int), prior)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns and the score of every row."""
    fields = [*docs.schema.fields, T.StructField(score_col, T.DoubleType())]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return docs.mapInArrow(_scored(model, docs.columns.index(text_col), None), plain).toDF(*docs.columns, score_col)


def kept(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold; all columns pass through."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return docs.mapInArrow(_scored(model, docs.columns.index(text_col), threshold), plain).toDF(*docs.columns)

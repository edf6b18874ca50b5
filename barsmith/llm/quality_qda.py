"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each document is described by transformed statistics of its whole text. Either
class is a normal density whose covariance is shrunk twice: towards the pooled
covariance and towards a multiple of the identity; both amounts are chosen by
cross-validated log-loss. A score is the logistic function of the difference of
the two log-densities (Mahalanobis distances through Cholesky factors that the
model keeps), brought to a probability by a fitted slope and intercept.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sliced

#: Labelled rows whose statistics are read for the fit, at most, of either class.
MAX_ROWS = 10_000
FEATURES = (
    "log words", "log word length", "upper case", "marks", "bars", "exclamations", "digits", "lines", "not ASCII", "new words", "repeated neighbours", "compression", "repeated lines", "stops",
)
_CLASSES = {
    "upper": np.arange(65, 91),
    "marks": np.frombuffer(b"#$%&*@^~\\<>{}[]=+_", dtype=np.uint8),
    "bars": np.frombuffer(b"|", dtype=np.uint8),
    "shout": np.frombuffer(b"!?", dtype=np.uint8),
    "digits": np.arange(48, 58),
    "lines": np.frombuffer(b"\n", dtype=np.uint8),
    "wide": np.arange(128, 256),
    "stops": np.frombuffer(b".,;:", dtype=np.uint8),
}


def _logit(part: float, whole: float, prior: float) -> float:
    """Log-odds of a share, smoothed by ``prior`` counts on either side."""
    return math.log((part + prior) / (max(whole - part, 0.0) + prior))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty text has defined values too."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    c = {k: float(counts[v].sum()) for k, v in _CLASSES.items()}
    words = text.split()
    nw, distinct = len(words), len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(nw),
        math.log((n + 5.0) / (nw + 1.0)),
        _logit(c["upper"], n, 2.0),
        _logit(c["marks"], n, 1.0),
        _logit(c["bars"], n, 1.0),
        _logit(c["shout"], n, 1.0),
        _logit(c["digits"], n, 2.0),
        _logit(c["lines"], n, 2.0),
        _logit(c["wide"], n, 2.0),
        # How far the number of distinct words falls behind the usual growth.
        math.log((distinct + 1.0) / (nw + 1.0)) + 0.25 * math.log1p(nw),
        _logit(again, nw, 1.0),
        math.log((len(zlib.compress(data, 1)) + 20.0) / (n + 20.0)),
        _logit(len(lines) - len(set(lines)), len(lines), 1.0),
        _logit(c["stops"], n, 2.0),
    ]


@dataclass
class Density:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the covariance
    log_det: float

    def log(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T).T
        return -0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    classes: tuple[Density, Density] | None
    slope: float
    intercept: float

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(x, self.low, self.high) - self.center) / self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.classes is not None and len(x):
            x = self.prepare(x)
            d = self.classes[1].log(x) - self.classes[0].log(x)
            z = z + self.slope * np.sign(d) * np.log1p(np.abs(d))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _density(x: np.ndarray, pooled: np.ndarray, to_pooled: float, to_identity: float) -> Density:
    own = np.cov(x.T, bias=True) if len(x) > 1 else pooled
    cov = (1 - to_pooled) * own + to_pooled * pooled
    cov = (1 - to_identity) * cov + to_identity * np.trace(cov) / len(cov) * np.eye(len(cov))
    lower = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov)))
    return Density(x.mean(axis=0), lower, 2 * float(np.log(np.diag(lower)).sum()))


def _slope(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x, w = np.column_stack([np.sign(d) * np.log1p(np.abs(d)), np.ones(len(d))]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, labels: np.ndarray, folds: int = 5) -> Model:
    """Fit on statistics and 0/1 labels. With fewer than two rows of a class the score is the share of ones."""
    x, y = np.asarray(x, dtype=np.float64).reshape(-1, len(FEATURES)), np.asarray(labels) == 1
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    if y.sum() < 2 or (~y).sum() < 2:
        one = np.ones(len(FEATURES))
        return Model(0 * one, one, -1e9 * one, 1e9 * one, None, 0.0, math.log(share / (1 - share)))
    low, high = np.percentile(x, [0.5, 99.5], axis=0)
    span = np.maximum(high - low, 1e-3)
    low, high = low - 0.5 * span, high + 0.5 * span
    cut = np.clip(x, low, high)
    center, scale = cut.mean(axis=0), np.maximum(cut.std(axis=0), 1e-3)
    z = (cut - center) / scale

    def pair(rows: np.ndarray, ones: np.ndarray, a: float, b: float) -> tuple[Density, Density]:
        pooled = ((~ones).sum() * np.cov(rows[~ones].T, bias=True) + ones.sum() * np.cov(rows[ones].T, bias=True)) / len(rows)
        return _density(rows[~ones], pooled, a, b), _density(rows[ones], pooled, a, b)

    part = np.empty(len(z), dtype=int)
    for side in (y, ~y):
        part[side] = np.arange(side.sum()) % folds
    best = (math.inf, 0.1, 0.1, 1.0, 0.0)
    for a in (0.0, 0.05, 0.2, 0.5):
        for b in (0.01, 0.05, 0.2):
            d = np.empty(len(z))
            for k in range(folds):
                train, test = part != k, part == k
                if min(y[train].sum(), (~y[train]).sum()) < 2:
                    d[test] = 0.0
                    continue
                zero, one = pair(z[train], y[train], a, b)
                d[test] = one.log(z[test]) - zero.log(z[test])
            slope, intercept = _slope(d, y.astype(float))
            p = 1 / (1 + np.exp(-np.clip(slope * np.sign(d) * np.log1p(np.abs(d)) + intercept, -30, 30)))
            loss = -float(np.where(y, np.log(p + 1e-12), np.log(1 - p + 1e-12)).mean())
            best = min(best, (loss, a, b, slope, intercept))
    _, a, b, slope, intercept = best
    return Model(center, scale, low, high, pair(z, y, a, b), slope, intercept)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        x = pa.array([statistics(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows of the training part: the smallest ids by hash in each class.

    Only their statistics leave the executors. Null labels and ids are left out;
    of several labels of an id the largest holds.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    rows = rows.where(~held_out(F.col(id_col), 3, 1))
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(13))
    kept = [rows.where(F.col("_y") == v).orderBy(draw, id_col).limit(max_rows) for v in (0, 1)]
    picked = kept[0].unionByName(kept[1]).withColumnRenamed(id_col, "_pick")
    # Bounded by the limits above.
    joined = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_pick"))
    # Of several texts of an id the smallest stands for all, and rows come in one order, so every run fits the same model.
    joined = joined.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").cast("int").alias("_y"))
    found = joined.select("_y", "_text", F.col("_id").cast("string").alias("_name")).orderBy("_y", "_name").select("_y", "_text").mapInArrow(_measured, "y int, x array<double>").collect()
    return fit(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            x = np.array([statistics(t or "") for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.score(x))], names=["id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1, higher: better), predicted (1 from ``threshold``).

    Null and empty texts are scored by the statistics of an empty text; an empty
    table gives no rows, and without labels of both classes every text has the
    share of ones as its score. Repeated rows give the same row each; of several
    texts of a labelled id the smallest is learned from, so ties don't depend on
    the order of rows. Very long texts are read whole. Labels, language, source
    and id are no inputs of a score. Ids keep their type and bits; other columns
    are not read.
    """
    model = model or train(docs, labels, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 3, 1).alias("held_out"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_scored(shared), f"id {id_type}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

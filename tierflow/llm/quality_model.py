"""Operator 8: document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.common import FOLD, batch, col, learnable, map_arrow, texts_of

MAX_LABELLED = 20_000
PAIRS_PER_LOSER = 40
MAX_PAIRS = 200_000
KEEP_SCORE = 0.7

_MARKS = b".,!?;:|#*$%&<>{}()[]\"'-_/@=+~^\\`"
FEATURES = 11 + len(_MARKS)


def features(text: bytes) -> list[float]:
    """Shares of character kinds, repetition of words and lines, and how often each ASCII mark occurs
    per word (as a logarithm). An empty text has the features of a text of no words."""
    size = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    blanks = counts[9] + counts[10] + counts[13] + counts[32]
    marks = counts[:128].sum() - upper - lower - digits - blanks
    words = text.translate(FOLD).split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    kinds = [
        np.log1p(len(words)),
        upper / size,
        lower / size,
        digits / size,
        marks / size,
        blanks / size,
        size / n,
        len(set(words)) / n,
        repeated / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
    ]
    return [*kinds, *np.log(counts[list(_MARKS)] / n + 1e-3)]


@dataclass(frozen=True)
class QualityModel:
    """``weights`` over standardised features; a raw score of ``cut`` becomes a score of 0.7."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        raw = _standard(rows, self.mean, self.spread) @ self.weights
        at = (raw - self.cut) / self.scale + np.log(KEEP_SCORE / (1 - KEEP_SCORE))
        # What lies on the cut must not fall below 0.7 by rounding.
        return np.where(raw >= self.cut, np.maximum(_sigmoid(at), KEEP_SCORE), np.minimum(_sigmoid(at), KEEP_SCORE - 1e-9))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _standard(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((rows - mean) / spread, -6, 6)


def bradley_terry(differences: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights that maximise the likelihood that each preferred document wins, where it wins with the
    logistic function of the difference of the two scores; Newton's method with a ridge penalty."""
    weights = np.zeros(differences.shape[1])
    for _ in range(rounds):
        lost = 1 - _sigmoid(differences @ weights)
        gradient = differences.T @ lost - ridge * weights
        curve = (differences * (lost * (1 - lost))[:, None]).T @ differences + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_id: str = "doc_id",
    label_column: str = "quality",
    max_labelled: int = MAX_LABELLED,
    max_pairs: int = MAX_PAIRS,
    seed: int = 7,
) -> QualityModel:
    """Learn from at most about ``max_labelled`` labelled documents that may be learned (``learnable``),
    chosen by a hash of the id.

    Preference pairs put each document of label 0 below up to ``PAIRS_PER_LOSER`` of label 1, at most
    ``max_pairs`` in all. The cut is the quantile of the training scores that equals the share of
    label 0. A document with several labels counts with its lowest; null labels are left out. Without
    documents of both labels the weights are zero and every document scores the cut.
    """
    rated = (
        labels.select(col(label_id).alias("d"), col(label_column).cast("int").alias("y"))
        .filter(learnable(F.col("d")) & F.col("y").isNotNull())
        .groupBy("d")
        .agg(F.min("y").alias("y"))
    )
    n = rated.count()
    share = min(1.0, max_labelled / n) if n else 1.0
    # The whole range of the hash, so that the share may be as small as it has to be.
    chosen = rated.filter(F.xxhash64("d") < int(share * 2**64) - 2**63) if share < 1 else rated
    # Bounded: two numbers for each of the ``max_labelled`` labels.
    texts = docs.select(col(id_column).alias("d"), col(text_column).alias("t")).join(F.broadcast(chosen), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in texts_of(b.column(2))]
            yield batch(
                {
                    "d": (b.column(0), pa.int64()),
                    "y": (b.column(1), pa.int32()),
                    "x": (rows, pa.list_(pa.float64())),
                }
            )

    got = map_arrow(texts.select(F.col("d").cast("bigint"), "y", "t"), run, "d bigint, y int, x array<double>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i, d=got["d"].to_pylist(), x=got["x"].to_pylist(): (d[i], x[i]))
    y = np.array(got["y"].to_pylist(), dtype=np.int64)[order]
    rows = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, FEATURES)[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES)
    spread = (rows.std(axis=0) if len(rows) else np.ones(FEATURES)) + 1e-6
    if not len(good) or not len(bad):
        return QualityModel(mean, spread, np.zeros(FEATURES), 0.0, 1.0)
    standard = _standard(rows, mean, spread)
    draw = np.random.default_rng(seed)
    each = max(1, min(PAIRS_PER_LOSER, max_pairs // len(bad)))
    losers = np.repeat(bad, each)[:max_pairs]
    winners = draw.choice(good, len(losers))
    weights = bradley_terry(standard[winners] - standard[losers])
    raw = standard @ weights
    cut = float(np.quantile(raw, len(bad) / len(rows)))
    return QualityModel(mean, spread, weights, cut, float(raw.std()) / 4 + 1e-9)


def score_quality(
    docs: DataFrame, model: QualityModel, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document ``doc_id, score`` (0 to 1; 0.7 or more is above the learned quantile), from its
    whole text alone. Null text scores as empty text. Repeated rows and null ids give a row each;
    other columns are not looked at. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t) for t in texts_of(b.column(1))]).reshape(-1, FEATURES)
            yield batch({"doc_id": (b.column(0), pa.int64()), "score": (shared.value.scores(rows), pa.float64())})

    return map_arrow(docs.select(col(id_column).cast("bigint"), col(text_column)), run, "doc_id bigint, score double")


def predict_quality(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """Fit and score: ``doc_id, held_out, score, predicted``."""
    names = {"id_column": id_column, "text_column": text_column}
    return score_quality(docs, fit_quality(docs, labels, **names, **options), **names).select(
        "doc_id",
        (~learnable(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with a score of 0.7 or more; columns and rows are otherwise as they were. A null text is judged as an
    empty one; repeated rows and texts on the cut are all kept or all dropped. An empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, text_column=text_column, **options))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t) for t in texts_of(b.column(at))]).reshape(-1, FEATURES)
            yield b.filter(pa.array(model.value.scores(rows) >= KEEP_SCORE, pa.bool_()))

    return map_arrow(docs, run, docs.schema)

r"""Quality classifier: regularised quadratic discriminant (operator 1).

Every whole text becomes a vector of document statistics, transformed so that each
is near normal (``FEATURES``): logarithms of counts, logits of shares. Each class
has a mean and a covariance, shrunk first towards the pooled covariance and then towards
its diagonal. The model keeps the Cholesky factor of each covariance; a score is the logistic
function of the difference of the two log densities (Mahalanobis distance by forward
substitution, plus log determinant and prior), divided by a temperature.

Fitting: the class moments (count, sum, sum of products) are summed in the tasks and
then by Spark; 2 x (d + d(d+1)/2 + 1) numbers reach the driver, whatever the input. All
labelled rows are used. The temperature brings the mean log-density difference at the two class
centres to ``TEMPERED``, so that scores do not all crowd at 0 and 1.

Defined cases: a null text counts as empty; an empty text is scored from its statistics
(all zero); a label row that repeats counts once per document (a document with
both labels gets the smaller); null labels and ids are not learned from; with fewer than two classes
every score is the share of label 1 (0.5 without labels); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents, keep, prepare

FEATURES = ("log_chars", "log_words", "mean_word_chars", "distinct_words", "top_word_share", "repeat_neighbours",
            "upper_share", "digit_share", "symbol_share", "mark_share", "separator_share", "sentence_marks",
            "line_words", "repeated_lines", "short_word_share")
TEMPERED = 8.0


def _logit(x: float, n: float) -> float:
    """Logit of the share x / n, drawn in by half a count on either side."""
    return math.log((x + 0.5) / (n - x + 0.5)) if n >= x else 0.0


# Characters counted for each share.
_COUNTED = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&<>^~=_{}\\@", "mark": b"!?",
            "separator": b"|", "sentence": b".,;:"}


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    chars = sum(map(len, words))
    counts = Counter(words)
    count = {name: size - len(raw.translate(None, c)) for name, c in _COUNTED.items()}
    lines = [line for line in raw.split(b"\n") if line.strip()]
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(len(text)), math.log1p(n), math.log1p(chars / n if n else 0.0),
        # Distinct words against the count that grows with length by a power.
        math.log((len(counts) + 1) / (n + 1) ** 0.8),
        _logit(max(counts.values(), default=0), n), _logit(neighbours, n),
        _logit(count["upper"], chars), _logit(count["digit"], chars), _logit(count["symbol"], chars),
        _logit(count["mark"], chars), _logit(count["separator"], chars), _logit(count["sentence"], chars),
        math.log1p(n / len(lines) if lines else 0.0), _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(sum(1 for w in words if len(w) <= 3), n)]


@dataclass
class Model:
    """Means, Cholesky factors, log determinants and priors by class 0 and 1, and the temperature."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    temperature: float
    constant: float | None = None  # the score of every text where one class has no rows

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0, for rows of ``x``."""
        dens = []
        for k in (0, 1):
            away = _forward(self.factors[k], (x - self.means[k]).T)
            dens.append(self.log_priors[k] - 0.5 * (away * away).sum(axis=0) - 0.5 * self.log_dets[k])
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        odds = np.clip(self.log_odds(x) / self.temperature, -700, 700)
        return 1.0 / (1.0 + np.exp(-odds))


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve factor @ y = b for a lower triangular factor."""
    y = np.empty_like(b)
    for i in range(len(factor)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float, diagonal: float) -> Model:
    """The model from the class moments. ``pooled`` and ``diagonal`` are the two shrinkage weights."""
    if (n < 2).any():
        total = n.sum()
        return Model(sums, products, n, n, 1.0, float(n[1] / total) if total else 0.5)
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    cov = scatter / n[:, None, None]
    within = scatter.sum(axis=0) / n.sum()
    factors, dets = [], []
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * within
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(low)
        dets.append(2 * np.log(np.diag(low)).sum())
    # The mean log odds between the class centres set the scale of a score.
    model = Model(means, np.array(factors), np.array(dets), np.log(n / n.sum()), 1.0)
    gap = model.log_odds(means)
    model.temperature = max(1.0, float(gap[1] - gap[0]) / (2 * TEMPERED))
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the statistics of every document. A narrow step."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of products by class of ``rows`` (``label``, ``x``)."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, d)
            label = np.array(batch.column("label").to_pylist(), dtype=int)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        size = total.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()),
            pa.array(total.ravel())], ["label", "place", "value"])

    summed = rows.select("label", "x").mapInArrow(run, "label int, place int, value double")
    out = np.zeros((2, 1 + d + d * d))
    for r in summed.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # 2 x (1 + d + d²) rows
        out[r["label"], r["place"]] = r["value"]
    return out[:, 0], out[:, 1:1 + d], out[:, 1 + d:].reshape(2, d, d)


def train(vectors: DataFrame, labels: DataFrame, pooled: float = 0.05, diagonal: float = 0.05) -> Model:
    """Fit on ``labels`` (``doc_id``, ``label``), joined to the vectors of ``features``."""
    once = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    return fit(*moments(vectors.join(once, "doc_id")), pooled, diagonal)


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, pooled: float = 0.05, diagonal: float = 0.05,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document, learned from ``labels`` (``doc_id``, ``label``)."""
    vectors = keep(features(docs, id_col, text_col))  # learned from and scored: computed once
    model = train(vectors, labels, pooled, diagonal)
    return score(vectors, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

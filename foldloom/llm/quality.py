"""Text quality by regularised quadratic discriminant analysis.

Every whole text is reduced to a vector of transformed statistics.  The classes' means and
covariances come from sums that Spark aggregates over all labelled training rows; covariances
are shrunk towards the pooled one and its diagonal.  A score is the difference of the two
Mahalanobis log densities, computed with cached Cholesky factors and calibrated by a logistic
fit on a bounded sample of training rows.

Defined results: null and empty texts have the statistics of an empty text and get a score like
any other; rows repeat as given; without training rows of both classes the score is the share of
the only class (0.5 without any); extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import parts, prepare, texts_of
from foldloom.llm.training import held_out, labelled_sample, lists_of, logistic, sigmoid
from foldloom.session import cut_lineage

#: Most labelled rows that the model is fitted on; bytes of text taken apart at once.
SAMPLE, BATCH_BYTES = 40_000, 1_000_000
#: Shrinkage of a class covariance: towards the pooled one, then towards the diagonal.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.1, 1e-3
SYMBOLS = "#$%&*@^~=+<>\\_{}[]"
NAMES = (
    "log_words", "word_length", "long_words", "log_types", "top_share", "repeat_share", "symbols", "exclaims", "pipes", "digits",
    "capitals", "all_caps", "stops", "commas", "letters", "log_lines", "line_words", "repeat_lines", "short_lines", "symbol_words")
_DROP_LETTERS = {ord(c): None for c in "abcdefghijklmnopqrstuvwxyz"}


def _share(part: float, whole: float) -> float:
    """A smoothed log-odds of a share; finite at 0 and 1."""
    return math.log((part + 0.5) / (whole - part + 0.5)) if part <= whole else math.log(whole + 0.5)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text."""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(text.translate(_NON_LETTERS))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    starts = sum(1 for w in words if w[:1].isupper())
    symbol_count = size - len(text.translate(_NO_SYMBOLS))
    odd = sum(1 for w in words if w[-1] in SYMBOLS)
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        math.log1p(n), math.log1p(sum(map(len, words)) / max(n, 1)), _share(sum(1 for w in words if len(w) > 12), n),
        math.log1p(len(counts)) - math.log1p(n), _share(max(counts.values(), default=0), n), _share(same, n),
        _share(symbol_count, size), _share(text.count("!"), size), _share(text.count("|"), size),
        _share(size - len(text.translate(_NO_DIGITS)), size), _share(starts, n), _share(upper, n),
        _share(text.count("."), n), _share(text.count(","), n), _share(letters, size), math.log1p(len(lines)),
        math.log1p(n / max(len(lines), 1)), _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(1 for x in lines if len(x) < 20), len(lines)), _share(odd, n)]


_NO_SYMBOLS = {ord(c): None for c in SYMBOLS}
_NO_DIGITS = {ord(c): None for c in "0123456789"}
_NON_LETTERS = {c: None for c in range(128) if chr(c).isalpha()}


def measure(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """(…, text) to the kept columns and x, the statistics."""
    for batch in batches:
        x = [statistics(t) for part in parts(batch, "text", BATCH_BYTES) for t in texts_of(part)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])


class Discriminant:
    """Means and inverse Cholesky factors of two classes, and the calibration of their difference."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in moments.values())
        self.prior = moments.get(1, (0.0,))[0] / total if total else 0.5
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        self.slopes, self.offset = np.ones(1), 0.0
        if set(moments) != {0, 1}:
            return
        spread = {k: second / n - np.outer(first / n, first / n) for k, (n, first, second) in moments.items()}
        pooled = sum(moments[k][0] * s for k, s in spread.items()) / total
        for k, (n, first, _) in moments.items():
            own = (1 - TO_POOLED) * spread[k] + TO_POOLED * pooled
            own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.classes[k] = (first / n, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, damped where both are far."""
        density = {k: -0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - log_root for k, (mean, inverse, log_root) in self.classes.items()}
        gap = density[1] - density[0]
        return np.sign(gap) * np.log1p(np.abs(gap))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        return sigmoid(self.difference(x)[:, None] @ self.slopes + self.offset)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Discriminant:
    sample = labelled_sample(docs, labels, "quality", most)
    measured = cut_lineage(sample.select("id", "label", "text").mapInArrow(
        lambda it: measure(it, ["id", "label"]), "id long, label int, x array<double>"))
    d = len(NAMES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = measured.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("first"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in upper]).alias("second")).collect()
    moments = {}
    for row in sums:
        second = np.zeros((d, d))
        for (i, j), value in zip(upper, row["second"], strict=True):
            second[i, j] = second[j, i] = value
        moments[row["label"]] = (float(row["n"]), np.array(row["first"]), second)
    model = Discriminant(moments)
    if model.classes:
        rows = measured.select("label", "x").toArrow()  # at most ``most`` rows
        x = lists_of(rows, "x")
        model.slopes, model.offset = logistic(model.difference(x)[:, None], rows.column("label").to_numpy().astype(float))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for part in parts(batch, "text", BATCH_BYTES) for t in texts_of(part)]
            values = model.score(np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = base.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""What the two classifiers share: folds, a bounded sample of labelled rows, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is a multiple of FOLDS."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """(id, text, label) of at most ``most`` labelled training rows, chosen by a hash of the id.

    ``most`` is the documented bound of the sample; the choice does not depend on partitions.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label in (0, 1)")
    usable = usable.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    chosen = usable.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(most).select("id", "label")
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return base.join(F.broadcast(chosen), "id")


def lists_of(rows: pa.Table, column: str) -> np.ndarray:
    """A column of lists of one length as a matrix, without Python objects in between."""
    flat = rows.column(column).combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1) if rows.num_rows else flat.reshape(0, 1)


def logistic(values: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """(slopes, offset) of P(1) = 1 / (1 + exp(-(values @ slopes + offset))), by Newton steps."""
    x = np.c_[values, np.ones(len(labels))]
    w = np.zeros(x.shape[1])
    if len(set(labels.tolist())) < 2:
        return w[:-1], 4.0 if len(labels) and labels[0] else -4.0
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - labels) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - np.clip(step, -2, 2)
    return w[:-1], float(w[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

"""Optimal superposition: rotations in closed form, batched ones for grouped steps, and the aggregate that feeds them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.operators.fragments import COVARIANCE, rmsd_from_covariance, sealed, singular_values


def rotations(covariance: np.ndarray) -> np.ndarray:
    """Proper rotations R (n,3,3) that best carry b onto a, from covariances sum a_j * b_k."""
    u, _, vt = np.linalg.svd(np.asarray(covariance, dtype=float).reshape(-1, 3, 3))
    flip = np.ones((len(u), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    return np.einsum("nij,nj,njk->nik", u, flip, vt)


def affine(rotation: np.ndarray, to_centre: np.ndarray, from_centre: np.ndarray) -> np.ndarray:
    """3x4 maps that move ``from_centre`` to ``to_centre`` under the rotations."""
    shift = to_centre - np.einsum("...ij,...j->...i", rotation, from_centre)
    return np.concatenate([rotation, shift[..., None]], axis=-1)


def superpose_points(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """3x4 map carrying the ``moving`` points (n,3) onto the ``fixed`` points (n,3)."""
    a, b = fixed.mean(axis=0), moving.mean(axis=0)
    return affine(rotations((fixed - a).T @ (moving - b))[0], a, b)


def move(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    return points @ m[:, :3].T + m[:, 3]


#: Singular values this close, relative to the first, leave the rotation open; it is then settled by a small shift.
OPEN, SHIFT = 1e-6, 1e-4


def with_map(matches: DataFrame) -> DataFrame:
    """Add the affine map ``m`` (12 numbers, row major) of side 2 onto side 1 to rows with covariances and centroids.

    With C the covariance and l the sum of its signed singular values, the best proper rotation is
    ((k + |C|^2) C + l cof(C) - C C^T C) / (k l - det C), k = (l^2 - |C|^2) / 2: plain arithmetic.
    Where it is not unique (points on a line) a small diagonal is added to C first.
    The sum is sharpened by Newton steps on its own equation, (l^2 - |C|^2)^2 = 8 l det C + 4 |cof C|^2,
    and the rotation made orthogonal by steps of R (3 - R^T R) / 2.
    """
    kept = matches.columns
    c = [F.col(n) for n in COVARIANCE]
    first = singular_values(matches)
    scale = F.greatest(F.col("_s1"), F.lit(1e-150))
    open_ = F.col("_s2") + F.col("_s3") <= OPEN * scale
    moved = [  # by a different amount in each direction, so that nothing stays equal
        F.col(n) + F.when(open_, SHIFT / 2 ** (k // 4) * scale).otherwise(0.0) if k % 4 == 0 else F.col(n) for k, n in enumerate(COVARIANCE)]
    others = [n for n in kept if n not in COVARIANCE]
    settled = first.select(
        *others, *[F.col(n).alias(f"_own{n}") for n in COVARIANCE], *[(e / scale).alias(n) for n, e in zip(COVARIANCE, moved, strict=True)])
    second = singular_values(settled)
    total = F.col("_s1") + F.col("_s2") + F.col("_s3")
    square = sum((x * x for x in c[1:]), c[0] * c[0])
    cofactor = g.cofactors_3x3(c)
    minors = sum((x * x for x in cofactor[1:]), cofactor[0] * cofactor[0])
    second = second.select("*", total.alias("_l"), square.alias("_q"), minors.alias("_a"))
    low, q, det = F.col("_l"), F.col("_q"), F.col("_det")
    for _ in range(2):
        slope = 4.0 * low * (low * low - q) - 8.0 * det
        value = (low * low - q) * (low * low - q) - 8.0 * det * low - 4.0 * F.col("_a")
        second = second.withColumn("_l", low - F.when(slope > 0, value / slope).otherwise(0.0))
    second = second.withColumn("_k", (low * low - q) / 2.0)
    gram = [sum((c[3 * r + k] * c[3 * s + k] for k in (1, 2)), c[3 * r] * c[3 * s]) for r in range(3) for s in range(3)]  # C C^T
    second = second.select("*", *[e.alias(f"_g{k}") for k, e in enumerate(gram)])
    cubic = g.multiply_3x3([F.col(f"_g{k}") for k in range(9)], c)
    below = F.col("_k") * F.col("_l") - F.col("_det")
    rotation = [((F.col("_k") + F.col("_q")) * c[k] + F.col("_l") * cofactor[k] - cubic[k]) / below for k in range(9)]
    turned = second.select("*", *[F.when(below > 0, e).otherwise(1.0 if k % 4 == 0 else 0.0).alias(f"_r{k}") for k, e in enumerate(rotation)])
    r = [F.col(f"_r{k}") for k in range(9)]
    for _ in range(2):
        cross = [sum((r[3 * i + k] * r[3 * j + k] for k in (1, 2)), r[3 * i] * r[3 * j]) for i in range(3) for j in range(3)]  # R R^T
        turned = turned.select("*", *[e.alias(f"_p{k}") for k, e in enumerate(cross)])
        back = g.multiply_3x3([F.col(f"_p{k}") for k in range(9)], r)
        turned = turned.withColumns({f"_r{k}": 1.5 * r[k] - 0.5 * back[k] for k in range(9)}).drop(*[f"_p{k}" for k in range(9)])
    rows = []
    for j, x in enumerate("xyz"):
        shift = F.col(f"m1{x}") - sum((r[3 * j + k] * F.col(f"m2{y}") for k, y in ((1, "y"), (2, "z"))), r[3 * j] * F.col("m2x"))
        rows += [*r[3 * j:3 * j + 3], shift]
    return sealed(turned.select(*[F.col(f"_own{n}").alias(n) if n in COVARIANCE else F.col(n) for n in kept], F.array(*rows).alias("m")))


def superposition_aggregate(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Superpose point sets given as rows (keys, ax, ay, az, bx, by, bz).

    A map-side-combinable aggregate: covariances, variances and means in one shuffle of partial
    sums, then the closed-form RMSD.  Adds ``len``, centroids, c00..c22, ``rmsd_fast``, ``rmsd``.
    """
    n = F.count(F.lit(1))
    stats = points.groupBy(*keys).agg(
        n.cast("int").alias("len"),
        *(F.avg(f"a{x}").alias(f"m1{x}") for x in "xyz"),
        *(F.avg(f"b{x}").alias(f"m2{x}") for x in "xyz"),
        (n * sum((F.var_pop(f"{s}{x}") for s in "ab" for x in "xyz"), F.lit(0.0))).alias("_e"),
        *(
            (n * F.covar_pop(f"a{x}", f"b{y}")).alias(f"c{j}{k}")
            for j, x in enumerate("xyz") for k, y in enumerate("xyz")
        ),
    )
    return rmsd_from_covariance(sealed(stats))

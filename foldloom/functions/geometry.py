"""Vector, matrix and quaternion algebra as native Column expressions.

A vector is a tuple of three Columns, an affine map is a tuple of twelve Columns (row major, three
rows of four; the implied last row is 0 0 0 1) and a quaternion is ``(x, y, z, w)``.  Everything
stays inside generated code, so these helpers can be used in hot projections and join filters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def vec(*names: str) -> Vec:
    x, y, z = (F.col(n) for n in names)
    return x, y, z


def unpack(column: Column, size: int = 12) -> tuple[Column, ...]:
    """The elements of an array column as a tuple."""
    return tuple(column[i] for i in range(size))


def add(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def subtract(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Sequence[Column], factor) -> Vec:
    return tuple(p * factor for p in a)


def divide(a: Sequence[Column], divisor: Column) -> Vec:
    """NULL where the divisor is zero (ANSI mode would raise)."""
    return tuple(F.try_divide(p, divisor) for p in a)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def length_squared(a: Sequence[Column]) -> Column:
    return dot(a, a)


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Sequence[Column]) -> Vec:
    return divide(a, length(a))


def distance_squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return length_squared(subtract(a, b))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(distance_squared(a, b))


def apply_affine(m: Sequence[Column], v: Sequence[Column]) -> Vec:
    return tuple(
        m[4 * r] * v[0] + m[4 * r + 1] * v[1] + m[4 * r + 2] * v[2] + m[4 * r + 3] for r in range(3)
    )


def rotation_part(m: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(m[4 * r + c] for r in range(3) for c in range(3))


def multiply_3x3(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(
        a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c]
        for r in range(3)
        for c in range(3)
    )


def cofactors_3x3(m: Sequence[Column]) -> tuple[Column, ...]:
    """Cofactors of a matrix, row major."""
    out = []
    for r in range(3):
        i, j = ((r + 1) % 3, (r + 2) % 3)
        for c in range(3):
            k, l = ((c + 1) % 3, (c + 2) % 3)
            out.append(m[3 * i + k] * m[3 * j + l] - m[3 * i + l] * m[3 * j + k])
    return tuple(out)


def compose_affine(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    """The map that applies ``b`` first and ``a`` second."""
    out = []
    for r in range(3):
        for c in range(4):
            term = sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 3)), a[4 * r] * b[c])
            out.append(term + a[4 * r + 3] if c == 3 else term)
    return tuple(out)


def invert_affine(m: Sequence[Column]) -> tuple[Column, ...]:
    """Inverse of a rigid map: the transposed rotation and the rotated-back translation."""
    shift = (m[3], m[7], m[11])
    out = []
    for r in range(3):
        row = (m[r], m[4 + r], m[8 + r])
        out.extend([*row, -dot(row, shift)])
    return tuple(out)


def determinant_3x3(m: Sequence[Column]) -> Column:
    return (
        m[0] * (m[4] * m[8] - m[5] * m[7])
        - m[1] * (m[3] * m[8] - m[5] * m[6])
        + m[2] * (m[3] * m[7] - m[4] * m[6])
    )


def quaternion_from_rotation(r: Sequence[Column]) -> tuple[Column, ...]:
    """Unit quaternion of a 3x3 rotation, branching on the largest of trace and diagonal."""
    trace = r[0] + r[4] + r[8]
    largest_x = (r[0] >= r[4]) & (r[0] >= r[8])
    largest_y = r[4] >= r[8]

    def root(value: Column) -> Column:
        return F.sqrt(F.greatest(value, F.lit(1e-300))) * 2.0

    sw, sx = root(trace + 1.0), root(1.0 + r[0] - r[4] - r[8])
    sy, sz = root(1.0 + r[4] - r[0] - r[8]), root(1.0 + r[8] - r[0] - r[4])
    a, b, c = r[7] - r[5], r[2] - r[6], r[3] - r[1]
    xy, xz, yz = r[1] + r[3], r[2] + r[6], r[5] + r[7]

    def pick(when_w: Column, when_x: Column, when_y: Column, when_z: Column) -> Column:
        return (
            F.when(trace > 0, when_w).when(largest_x, when_x).when(largest_y, when_y).otherwise(when_z)
        )

    return (
        pick(a / sw, sx / 4.0, xy / sy, xz / sz),
        pick(b / sw, xy / sx, sy / 4.0, yz / sz),
        pick(c / sw, xz / sx, yz / sy, sz / 4.0),
        pick(sw / 4.0, a / sx, b / sy, c / sz),
    )


def rotation_from_quaternion(q: Sequence[Column]) -> tuple[Column, ...]:
    x, y, z, w = q
    return (
        1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - z * w), 2.0 * (x * z + y * w),
        2.0 * (x * y + z * w), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - x * w),
        2.0 * (x * z - y * w), 2.0 * (y * z + x * w), 1.0 - 2.0 * (x * x + y * y),
    )


def half_angle_cosine(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Cosine of half the angle of the relative rotation of two unit quaternions."""
    return F.abs(p[0] * q[0] + p[1] * q[1] + p[2] * q[2] + p[3] * q[3])


def symmetric_eigenvalues(
    xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column
) -> dict[str, Column]:
    """Largest two eigenvalues of a symmetric 3x3 matrix by the trigonometric cubic.

    Returned in two layers so that Catalyst evaluates each layer once: ``base`` columns must be
    projected (under the given names) before ``top``/``second`` are.
    """
    mean = (xx + yy + zz) / 3.0
    spread = F.sqrt(
        ((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean)
         + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0
    )
    return {"mean": mean, "spread": spread}


def eigen_angle(
    mean: Column, spread: Column,
    xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column,
) -> Column:
    a, b, c = xx - mean, yy - mean, zz - mean
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    cube = spread * spread * spread * 2.0
    ratio = F.when(cube > 0, det / F.greatest(cube, F.lit(1e-300))).otherwise(F.lit(0.0))
    return F.acos(F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))) / 3.0


def eigen_top(mean: Column, spread: Column, angle: Column) -> Column:
    return mean + 2.0 * spread * F.cos(angle)


def eigen_second(mean: Column, spread: Column, angle: Column) -> Column:
    return mean + 2.0 * spread * F.cos(angle - 2.0 * math.pi / 3.0)

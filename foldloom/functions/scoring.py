"""Fragment, hinge and significance scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Search limits.
MIN_FRAGMENT = 5
MAX_FRAGMENT = 9
EXTEND_DISTANCE = 5.0
EXTEND_OVERLAP = 5
MAX_SCORED_RMSD = 2.8
MIN_ANGLE = 0.1

# The three relaxation passes (minimum fragment score, largest hinge angle in
# degrees, largest hinge displacement in Angstrom).
SEARCH_PASSES = ((2.0, 45.0, 4.0), (1.6, 45.0, 5.0), (0.6, 45.0, 10.0))

# Pairwise significance model.
SIGNIFICANCE_SLOPE = 0.155
SIGNIFICANCE_OFFSET = 1.6018
SIGNIFICANCE_SCALE = 2.13065

#: Steps of a score table: one value at every 0.001 Angstrom up to the scored range, and one beyond.
TABLE_SIZE = int(MAX_SCORED_RMSD * 1000) + 2
#: Share of the background pairs below which a score follows the volume of small deviations.
TAIL_SHARE = 0.01
#: The share of pairs is read at every 0.02 Angstrom, and drawn straight in between: single counts would make steps.
KNOT = 20


def curve_from_counts(counts: dict[int, int], mean_length: float) -> list[float]:
    """Score table from a background: pairs of unrelated fragments counted by RMSD in 0.001 Angstrom, rounded up.

    A value is the negative log of the share of pairs with so small an RMSD, per residue.  Too few
    pairs are very close to count them; there the share falls with the power of the RMSD that is
    the number of free coordinates of a superposed fragment, 3 n - 6.
    """
    total = sum(counts.values())
    per_bin = np.array([counts.get(m, 0) for m in range(TABLE_SIZE)])
    knots = np.arange(0, TABLE_SIZE, KNOT)
    below = np.cumsum(per_bin)[knots]
    values = -np.log((below + 1) / (total + 1))
    tail = next((k for k in range(1, len(knots)) if total and below[k] >= TAIL_SHARE * total), len(knots) - 1)
    steps = np.arange(TABLE_SIZE)
    close = values[tail] + (3 * mean_length - 6) * np.log(knots[tail] / np.maximum(steps, 1))
    return (np.where(steps < knots[tail], close, np.interp(steps, knots, values)) / mean_length).tolist()


def fragment_score(rmsd: Column | str, size: Column, table: Sequence[float]) -> Column:
    """Length times the negative log probability of so small an RMSD; 0 above the scored range.

    ``table`` holds the values at every 0.001 Angstrom; between them they are interpolated linearly.
    """
    value = F.col(rmsd) if isinstance(rmsd, str) else rmsd
    values = F.lit([float(v) for v in table])
    milli = F.least(value, F.lit(MAX_SCORED_RMSD)) * 1000.0
    low = F.floor(milli).cast("int")
    frac = milli - low
    interpolated = F.get(values, low) * (1.0 - frac) + F.get(values, low + 1) * frac
    return F.when(value > MAX_SCORED_RMSD, F.lit(0.0)).otherwise(size * interpolated)


def rmsd_limit(size: int, min_score: float, table: Sequence[float]) -> float:
    """Largest RMSD (to 0.001, rounded up) at which a fragment of ``size`` reaches ``min_score``."""
    low, high = 0, int(MAX_SCORED_RMSD * 1000)
    while low < high:
        middle = (low + high + 1) // 2
        if size * table[middle] >= min_score:
            low = middle
        else:
            high = middle - 1
    return (low + 1) / 1000.0


def angle_bonus(half_cosine: Column) -> Column:
    """-ln((1 - cos angle) / 2), with the hinge angle floored."""
    angle = F.greatest(2.0 * F.acos(F.least(half_cosine, F.lit(1.0))), F.lit(MIN_ANGLE))
    return -F.log((1.0 - F.cos(angle)) / 2.0)


def displacement_bonus(displacement: Column) -> Column:
    return 4.0 - displacement


MAX_ANGLE_BONUS = -math.log((1.0 - math.cos(MIN_ANGLE)) / 2.0)
MAX_DISPLACEMENT_BONUS = 4.0


def significance_z(rmsd: Column, residues: Column) -> Column:
    """Standard score whose normal CDF is the p-value of a pairwise alignment."""
    return (rmsd - SIGNIFICANCE_SLOPE * residues + SIGNIFICANCE_OFFSET) / SIGNIFICANCE_SCALE


#: Beyond this many deviations the tail is given by its leading terms.
CDF_FAR, CDF_TERMS = 7.0, 120


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function (Spark SQL has no error function).

    1/2 + phi(z) (z + z^3/3 + z^5/15 + ...): all terms of a side have one sign, so nothing cancels.
    """
    z = F.col(z) if isinstance(z, str) else z
    near = F.least(F.greatest(z, F.lit(-CDF_FAR)), F.lit(CDF_FAR))
    start = F.struct(near.alias("term"), near.alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * near * near / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(CDF_TERMS)), start, add)["total"]
    density = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    size = F.abs(z)
    tail = density / size * (1.0 - 1.0 / (size * size))
    return F.when(z.isNull(), None).when(size <= CDF_FAR, 0.5 + density * series).when(z > 0, 1.0 - tail).otherwise(tail)

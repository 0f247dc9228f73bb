import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldloom.functions import scoring  # noqa: E402
from foldloom.session import local_session, ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"
#: A score table for made-up chains, so that expected values do not hang on the chains of a test.
CURVE = scoring.curve_from_counts({m: m // 20 for m in range(2801)}, 7.0)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "foldloom-tests", **{"spark.sql.shuffle.partitions": "4"})
    ship_package(session)
    yield session
    session.stop()


def rotation(seed: int) -> np.ndarray:
    q = np.random.default_rng(seed).normal(size=4)
    x, y, z, w = q / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def walk(n: int, seed: int) -> np.ndarray:
    """A smooth random chain with steps of 3.8."""
    rng = np.random.default_rng(seed)
    step, points = rng.normal(size=3), [np.zeros(3)]
    for _ in range(n - 1):
        step = step / np.linalg.norm(step) + 0.8 * rng.normal(size=3)
        points.append(points[-1] + 3.8 * step / np.linalg.norm(step))
    return np.array(points)


def residue_frame(spark, jobs: dict[int, list[np.ndarray]]):
    """Residue table of point chains (NaN rows are missing residues)."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    rows = [
        (j, c, i, letters[i % 20], *(None if np.isnan(p).any() else float(v) for v in p))
        for j, chains in jobs.items() for c, points in enumerate(chains) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "job_id long, chain long, res_idx int, letter string, x double, y double, z double")

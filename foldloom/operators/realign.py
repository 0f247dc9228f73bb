"""Per-block realignment and greedy extension of multiple alignments before they are merged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.scoring import EXTEND_DISTANCE, EXTEND_OVERLAP
from foldloom.functions.superpose import move, superpose_points
from foldloom.operators.grouped import Group, map_groups, ordered, points_of

SWEEPS = 2
REALIGNED = (
    "grp string, side int, block int, slot int, chain long, t int, res_idx int, "
    "x double, y double, z double, m array<double>"
)
EXTENSION = "grp string, side int, block int, slot int, chain long, t int, res_idx int, x double, y double, z double"


def leave_one_out(source: np.ndarray, current: np.ndarray, chain: int) -> np.ndarray:
    """Map of ``chain``'s source points onto the mean of the other chains' current points."""
    others = np.delete(current, chain, axis=0).mean(axis=0)
    return superpose_points(others, source[chain])


def _realign_block(key: tuple, cells: Group) -> list[tuple]:
    cells = ordered(cells, "slot", "col")
    n = len(np.unique(cells["slot"]))
    source, now = (np.stack([cells[c] for c in names], axis=1).astype(float).reshape(n, -1, 3) for names in (("sx", "sy", "sz"), "xyz"))
    width = now.shape[1]
    # The block moves as a whole so that the representative is back in its own frame.
    m = leave_one_out(source, now, 0)
    inverse = np.hstack([m[:, :3].T, -(m[:, :3].T @ m[:, 3])[:, None]])
    now = now @ inverse[:, :3].T + inverse[:, 3]
    now[0] = source[0]
    maps = [None] * n
    for _ in range(SWEEPS):
        for chain in range(n - 1, -1, -1):
            maps[chain] = leave_one_out(source, now, chain)
            now[chain] = move(maps[chain], source[chain])
    flat = (now.reshape(-1, 3)[:, k].tolist() for k in range(3))
    return list(zip(
        *([k] * (n * width) for k in key), cells["slot"].tolist(), cells["chain"].tolist(), list(range(width)) * n, cells["res_idx"].tolist(),
        *flat, [m for one in maps for m in [one.reshape(12)] * width], strict=True))


def realign_blocks(columns: DataFrame) -> DataFrame:
    """Leave-one-out superposition of every chain, block by block.

    ``columns``: grp, side, block, slot, chain, col, res_idx, x, y, z (current) and sx, sy, sz (source).
    Blocks are independent, so each is its own group.
    """
    return map_groups(columns, ["grp", "side", "block"], _realign_block, REALIGNED)


def _extend_gap(key: tuple, chains: Group) -> list[tuple]:
    chains = ordered(chains, "slot")
    slots, names = chains["slot"].tolist(), chains["chain"].tolist()
    n = len(slots)
    rows: list[tuple] = []
    upper = np.triu_indices(n, 1)
    source = [points_of(chains, k) for k in range(n)]
    #: First columns of the flanks and the chains in their frames; none where the gap has no such flank.
    flanks = {
        side: (chains[side].astype(int).tolist(), [move(m.reshape(3, 4), p) for m, p in zip(chains[f"m_{side}"], source, strict=True)])
        for side in ("low", "high") if not np.isnan(chains[side][0])}

    def step(side: str, offset: int) -> tuple[float, np.ndarray, list[int]] | None:
        """Mean pairwise distance of the residues ``offset`` away from the flank, in its own frame."""
        anchors, moved = flanks[side]
        picked = [a + offset for a in anchors]
        if any(at < 0 or at >= len(p) for at, p in zip(picked, moved, strict=True)):
            return None
        points = np.stack([p[at] for at, p in zip(picked, moved, strict=True)])
        if np.isnan(points).any():
            return None
        gaps = np.linalg.norm(points[upper[0]] - points[upper[1]], axis=1)
        return float(gaps.mean()), points, picked

    room = min(h - w - 1 for h, w in zip(flanks["high"][0], flanks["low"][0], strict=True)) if len(flanks) == 2 else None
    back = forward = skips = 0
    gap = key[2]
    while True:
        overlap = room is not None and back + forward >= room
        if room is not None and skips >= EXTEND_OVERLAP:
            break
        options = []
        if "high" in flanks:
            options.append((step("high", -back - 1), True))
        if "low" in flanks:
            options.append((step("low", forward + 1), False))
        options = [(s, b) for s, b in options if s is not None and s[0] < EXTEND_DISTANCE]
        if not options:
            break
        (_, points, picked), backwards = min(options, key=lambda o: o[0][0])
        skips += overlap
        if backwards:
            back += 1
            block, t = gap, -back
        else:
            forward += 1
            block, t = gap - 1, int(chains["low_width"][0]) - 1 + forward
        rows.extend((*key[:2], block, slot, chain, t, at, *p) for slot, chain, at, p in zip(slots, names, picked, points.tolist(), strict=True))
    return rows


def extend_blocks(realigned: DataFrame, tracks: DataFrame) -> DataFrame:
    """Grow blocks into the gaps between them, one column at a time while chains stay close.

    ``tracks`` holds the source chains (job_id, chain, xs, ys, zs; NULL where missing) and
    ``realigned`` carries job_id.  Gaps are independent, so each is its own group.
    """
    ends = realigned.groupBy("job_id", "grp", "side", "slot", "chain", "block").agg(
        F.min("res_idx").alias("first_idx"), F.max("res_idx").alias("last_idx"),
        F.first("m").alias("m"), (F.max("t") + 1).alias("width"))
    order = Window.partitionBy("grp", "side", "slot").orderBy("block")
    inner = ends.select(
        "job_id", "grp", "side", "slot", "chain", F.col("block").alias("gap"),
        F.col("first_idx").alias("high"), F.col("m").alias("m_high"),
        F.lag("last_idx").over(order).alias("low"), F.lag("m").over(order).alias("m_low"),
        F.lag("width").over(order).alias("low_width"))
    last = ends.withColumn("_next", F.lead("block").over(order)).where(F.col("_next").isNull())
    tail = last.select(
        "job_id", "grp", "side", "slot", "chain", (F.col("block") + 1).alias("gap"),
        F.lit(None).cast("int").alias("high"), F.lit(None).cast("array<double>").alias("m_high"),
        F.col("last_idx").alias("low"), F.col("m").alias("m_low"), F.col("width").alias("low_width"))
    gaps = inner.unionByName(tail).join(tracks, ["job_id", "chain"])
    return map_groups(gaps.drop("job_id"), ["grp", "side", "gap"], _extend_gap, EXTENSION)

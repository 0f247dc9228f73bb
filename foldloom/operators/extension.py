"""Filling of the gaps between core blocks after rigid superposition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.operators.grouped import Group, map_groups, ordered, points_of

DEFAULT_CUTOFF = 5.0
LONGEST_INSERT = 4
INSERTS = "job_id long, aln_id long, gap int, part int, t int, chain long, res_idx int"


def alignment_gaps(columns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Residue range of every chain in every gap: before, between and after the blocks.

    Result: job_id, aln_id, gap, chain, gap_first, gap_last (empty when gap_last < gap_first).
    """
    ends = columns.groupBy("job_id", "aln_id", "chain", "block").agg(
        F.min("res_idx").alias("first_idx"), F.max("res_idx").alias("last_idx"))
    order = Window.partitionBy("job_id", "aln_id", "chain").orderBy("block")
    keys = ["job_id", "aln_id", "chain"]
    inner = ends.select(
        *keys, F.col("block").alias("gap"),
        (F.coalesce(F.lag("last_idx").over(order), F.lit(-1)) + 1).alias("gap_first"),
        (F.col("first_idx") - 1).alias("gap_last"))
    tail = ends.groupBy(*keys).agg((F.max("block") + 1).alias("gap"), (F.max("last_idx") + 1).alias("gap_first")).join(
        lengths, ["job_id", "chain"]).select(*keys, "gap", "gap_first", (F.col("length") - 1).alias("gap_last"))
    return inner.unionByName(tail)


def nearest_segments(gaps: DataFrame, residues: DataFrame, size: int, reach: float) -> DataFrame:
    """For every gap segment of ``size`` residues the nearest segment of each other chain of the gap.

    Candidates come from a grid join on the first residues: two segments whose mean distance is at
    most ``reach`` start at most ``size * reach`` apart.  Result: job_id, aln_id, gap, chain, pos,
    chain2, pos2, distance (summed over the segment); ties go to the first segment.
    """
    from foldloom.operators.radius import radius_join

    inside = gaps.join(residues, ["job_id", "chain"]).where("res_idx BETWEEN gap_first AND gap_last AND x IS NOT NULL")
    run = Window.partitionBy("job_id", "aln_id", "gap", "chain").orderBy("res_idx")
    ahead = [F.lead(c, k).over(run).alias(f"{c}{k}") for k in range(1, size) for c in (*"xyz", "res_idx")]
    segments = inside.select("job_id", "aln_id", "gap", "chain", F.col("res_idx").alias("pos"), *"xyz", *ahead)
    if size > 1:
        segments = segments.where(F.col(f"res_idx{size - 1}") == F.col("pos") + size - 1)
    pairs = radius_join(segments, segments, size * reach, ["job_id", "aln_id", "gap"]).where("a_chain <> b_chain")
    total = F.col("distance")
    for k in range(1, size):
        total = total + g.distance(g.vec(*(f"a_{c}{k}" for c in "xyz")), g.vec(*(f"b_{c}{k}" for c in "xyz")))
    scored = pairs.select(
        "job_id", "aln_id", "gap", F.col("a_chain").alias("chain"), F.col("a_pos").alias("pos"),
        F.col("b_chain").alias("chain2"), F.col("b_pos").alias("pos2"), total.alias("total"))
    return scored.where(F.col("total") <= size * reach).groupBy(
        "job_id", "aln_id", "gap", "chain", "pos", "chain2").agg(
        F.min(F.struct("total", "pos2")).alias("n")).select(
        "job_id", "aln_id", "gap", "chain", "pos", "chain2", "n.pos2", F.col("n.total").alias("distance"))


def _distances(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Summed distance between every run of ``size`` points of a and of b (NaN where missing)."""
    d = np.linalg.norm(a[:, None] - b[None, :], axis=2)
    n, m = len(a) - size + 1, len(b) - size + 1
    return sum(d[k:k + n, k:k + m] for k in range(size))


def _best_insert(chains: list[np.ndarray], spans: list[tuple[int, int]], size: int, cutoff: float):
    """Starts (one per chain) of the segment set with the least mean pairwise distance, or None."""
    n = len(chains)
    if any(b - a + 1 < size for a, b in spans):
        return None
    parts = [c[a:b + 1] for c, (a, b) in zip(chains, spans)]
    sums = {(i, j): _distances(parts[i], parts[j], size) for i in range(n) for j in range(i + 1, n)}

    def between(i: int, j: int) -> np.ndarray:
        return sums[i, j] if i < j else sums[j, i].T

    best, chosen = np.inf, None
    for i in range(n):
        count = len(parts[i]) - size + 1
        nearest = np.zeros((count, n), dtype=int)
        seed = np.zeros(count)
        nearest[:, i] = np.arange(count)
        for j in range(n):
            if j != i:
                d = np.where(np.isnan(between(i, j)), np.inf, between(i, j))
                nearest[:, j] = d.argmin(axis=1)
                seed += d.min(axis=1)
        for s in np.flatnonzero(seed / (n - 1) < 2 * cutoff):
            pick = nearest[s]
            mean = np.mean([sums[a, b][pick[a], pick[b]] / size for a, b in sums])
            if mean < best:
                best, chosen = mean, pick
    if best > cutoff:
        return None
    return [a + int(p) for (a, _), p in zip(spans, chosen)]


def _fill_gap(chains: list[np.ndarray], spans: list[tuple[int, int]], cutoff: float) -> list[tuple[int, list[int]]]:
    """Inserted segments of one gap in order: (size, starts).  Longer sizes go first everywhere."""
    layout: list = [spans]
    for size in range(LONGEST_INSERT, 0, -1):
        at = 0
        while at < len(layout):
            if isinstance(layout[at], tuple):
                at += 1
                continue
            starts = _best_insert(chains, layout[at], size, cutoff)
            if starts is None:
                at += 1
                continue
            before = [(a, s - 1) for (a, _), s in zip(layout[at], starts)]
            after = [(s + size, b) for (_, b), s in zip(layout[at], starts)]
            layout[at:at + 1] = [before, (size, starts), after]
    return [item for item in layout if isinstance(item, tuple)]


def final_extension(gaps: DataFrame, tracks: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Segments added to each gap: greedy, nearest segments, mean distance at most ``cutoff``.

    ``tracks``: job_id, aln_id, chain, xs, ys, zs in the superposed frame; only the slice inside the
    gap travels to the group.  Gaps are independent groups; gaps in which some chain has nothing are
    dropped before the shuffle.
    """
    width = F.col("gap_last") - F.col("gap_first") + 1
    smallest = F.min(width).over(Window.partitionBy("job_id", "aln_id", "gap"))
    cut = gaps.withColumn("_room", smallest).where("_room > 0").join(tracks, ["job_id", "aln_id", "chain"]).select(
        "job_id", "aln_id", "gap", "chain", "gap_first",
        *(F.slice(c, F.col("gap_first") + 1, width).alias(c) for c in ("xs", "ys", "zs")))

    def fill(key: tuple, group: Group) -> list[tuple]:
        group = ordered(group, "chain")
        chains, first = group["chain"].tolist(), group["gap_first"].tolist()
        points = [points_of(group, k) for k in range(len(chains))]
        spans = [(0, len(p) - 1) for p in points]
        return [
            (*key, part, t, chain, base + start + t) for part, (size, starts) in enumerate(_fill_gap(points, spans, cutoff))
            for chain, base, start in zip(chains, first, starts, strict=True) for t in range(size)]

    return map_groups(cut, ["job_id", "aln_id", "gap"], fill, INSERTS)


def insert_blocks(columns: DataFrame, inserts: DataFrame) -> DataFrame:
    """Columns with the inserted blocks in place; blocks and columns renumbered.

    Both inputs have job_id, aln_id, chain and res_idx; coordinates are looked up again by the caller.
    """
    placed = columns.select(
        "job_id", "aln_id", "chain", "res_idx", F.col("block").alias("_gap"), F.lit(1).alias("_kind"),
        F.lit(0).alias("_part"), F.col("col").alias("_t"))
    added = inserts.select(
        "job_id", "aln_id", "chain", "res_idx", F.col("gap").alias("_gap"), F.lit(0).alias("_kind"),
        F.col("part").alias("_part"), F.col("t").alias("_t"))
    order = Window.partitionBy("job_id", "aln_id")
    return placed.unionByName(added).select(
        "job_id", "aln_id", "chain", "res_idx",
        (F.dense_rank().over(order.orderBy("_gap", "_kind", "_part")) - 1).alias("block"),
        (F.dense_rank().over(order.orderBy("_gap", "_kind", "_part", "_t")) - 1).alias("col"))

"""Rigid superposition of multiple alignments along their assembly trees, and moving whole chains."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.functions.superpose import move, superpose_points
from foldloom.operators.grouped import Group, map_groups, ordered
from foldloom.operators.realign import SWEEPS, leave_one_out

MAPS = "job_id long, aln_id long, chain long, m array<double>"


def _superpose_tree(tree, source: dict[int, np.ndarray], maps: dict[int, np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Chains below ``tree`` and their moved points; ``maps`` receives every chain's latest map."""
    if not isinstance(tree, list):
        maps[tree] = np.hstack([np.eye(3), np.zeros((3, 1))])
        return [tree], source[tree][None]
    left, fixed = _superpose_tree(tree[0], source, maps)
    right, moving = _superpose_tree(tree[1], source, maps)
    m = superpose_points(fixed.mean(axis=0), moving.mean(axis=0))
    chains = left + right
    now = np.concatenate([fixed, move(m, moving)])
    points = np.stack([source[c] for c in chains])
    for _ in range(SWEEPS):
        for i in range(len(chains) - 1, -1, -1):
            maps[chains[i]] = leave_one_out(points, now, i)
            now[i] = move(maps[chains[i]], points[i])
    return chains, now


def _rigid_maps(key: tuple, cells: Group) -> list[tuple]:
    cells = ordered(cells, "chain", "col")
    chains, first = np.unique(cells["chain"], return_index=True)
    points = np.stack([cells[c] for c in "xyz"], axis=1).astype(float)
    source = dict(zip(chains.tolist(), np.split(points, first[1:]), strict=True))
    maps: dict[int, np.ndarray] = {}
    _superpose_tree(json.loads(key[2]), source, maps)
    return [(*key[:2], chain, m.reshape(12)) for chain, m in maps.items()]


def rigid_maps(columns: DataFrame, alignments: DataFrame, residues: DataFrame) -> DataFrame:
    """One rigid map per chain: children of each tree node superposed, then leave-one-out sweeps.

    Uses the source coordinates of the aligned residues.  A group is one alignment's core.
    """
    source = columns.select("job_id", "aln_id", "chain", "col", "res_idx").join(
        residues.select("job_id", "chain", "res_idx", *"xyz"), ["job_id", "chain", "res_idx"])
    cells = source.join(alignments.select("job_id", "aln_id", "tree"), ["job_id", "aln_id"]).drop("res_idx")
    return map_groups(cells, ["job_id", "aln_id", "tree"], _rigid_maps, MAPS)


def move_chains(points: DataFrame, maps: DataFrame) -> DataFrame:
    """Apply each chain's map to its points (residues or atoms), natively."""
    others = [c for c in points.columns if c not in ("x", "y", "z")]
    joined = points.join(maps.select("job_id", "chain", "m"), ["job_id", "chain"])
    moved = g.apply_affine(g.unpack(F.col("m")), g.vec("x", "y", "z"))
    return joined.select(*others, *(v.alias(c) for c, v in zip("xyz", moved)))


def move_by_block(points: DataFrame, blocks: DataFrame, maps: DataFrame) -> DataFrame:
    """Bent coordinates: each point follows the block of its residue.

    ``blocks``: job_id, chain, block, first_idx.  ``maps``: job_id, chain, block, m.
    """
    from foldloom.operators.blocks import residue_to_block

    placed = residue_to_block(points, blocks).withColumnRenamed("move_block", "block")
    others = [c for c in points.columns if c not in ("x", "y", "z")]
    joined = placed.join(maps.select("job_id", "chain", "block", "m"), ["job_id", "chain", "block"])
    moved = g.apply_affine(g.unpack(F.col("m")), g.vec("x", "y", "z"))
    return joined.select(*others, "block", *(v.alias(c) for c, v in zip("xyz", moved)))

"""Partial alignment: residues left in gaps are aligned between subsets of the chains.

A residue set holds at most one residue per chain; a list of sets is worth the sum, over all pairs
of residues in a set, of how far they are below the cutoff.  Two ordered lists are merged by the
order-preserving matching that adds most.  Lists are merged along the assembly tree; each merge is
then improved by restricted partitions: a branch of the tree is taken out of all sets and merged
again, the branch that gains most first, until no branch gains anything.  The worth rises with
every step, so this ends by itself.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.grouped import Group, map_groups, ordered, points_of

ROUND_OFF = 1e-5
NONE = -1
SETS = "job_id long, aln_id long, gap int, part int, chain long, res_idx int"


class Gap:
    """Points of the chains of one gap and the worth of residue sets; a set is a row with a residue or NONE per chain."""

    def __init__(self, points: list[np.ndarray], cutoff: float):
        self.points, self.cutoff = points, cutoff

    def _column(self, sets: np.ndarray, chain: int) -> np.ndarray:
        """Points of a chain's residues set by set; NaN where it has none."""
        held = sets[:, chain]
        out = np.full((len(sets), 3), np.nan)
        out[held != NONE] = self.points[chain][held[held != NONE]]
        return out

    def _chains(self, sets: np.ndarray) -> list[int]:
        return np.flatnonzero((sets != NONE).any(axis=0)).tolist()

    def gains(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What uniting each left with each right set adds: one chain pair at a time, so the memory is that of the result."""
        total = np.zeros((len(left), len(right)))
        for c in self._chains(left):
            mine = self._column(left, c)
            for d in self._chains(right):
                apart = np.linalg.norm(mine[:, None] - self._column(right, d)[None], axis=2)
                total += np.nan_to_num(self.cutoff - apart, nan=0.0)
        return total

    def worth(self, sets: np.ndarray) -> float:
        columns = [self._column(sets, c) for c in self._chains(sets)]
        return sum(
            float(np.nansum(self.cutoff - np.linalg.norm(a - b, axis=1))) for k, a in enumerate(columns) for b in columns[k + 1:])

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The two lists as one: sets are united along the order-preserving matching with the largest gain."""
        matched = _best_matching(self.gains(left, right)) if len(left) and len(right) else []
        pieces, i, j = [], 0, 0
        for row, column in [*matched, (len(left), len(right))]:
            pieces += [left[i:row], right[j:column]]
            if row < len(left):
                pieces.append(np.maximum(left[row], right[column])[None])  # NONE is below every residue
            i, j = row + 1, column + 1
        return np.concatenate(pieces)

    def without(self, sets: np.ndarray, branch: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The list without the branch's chains, and the branch's own list."""
        inside = np.isin(np.arange(sets.shape[1]), branch)
        parts = (np.where(inside, NONE, sets), np.where(inside, sets, NONE))
        return tuple(p[(p != NONE).any(axis=1)] for p in parts)

    def improve(self, sets: np.ndarray, branches: list[list[int]]) -> np.ndarray:
        worth = self.worth(sets)
        while True:
            tries = [self.merge(*self.without(sets, b)) for b in branches]
            values = [self.worth(t) for t in tries]
            if not values or max(values) <= worth + ROUND_OFF:
                return sets
            best = int(np.argmax(values))
            sets, worth = tries[best], values[best]


def _best_matching(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the order-preserving matching with the largest sum of positive gains."""
    n, m = gain.shape
    total = np.zeros((n + 1, m + 1))
    for i in range(n):
        total[i + 1, 1:] = np.maximum.accumulate(np.maximum(total[i, 1:], total[i, :-1] + gain[i]))
    pairs, column = [], m
    for i in range(n, 0, -1):
        # the first column that reaches this row's value is where the last match ends, if the row above falls short of it
        reach = int(np.searchsorted(total[i, :column + 1], total[i, column]))
        if reach and total[i - 1, reach] < total[i, reach]:
            pairs.append((i - 1, reach - 1))
            column = reach - 1
    return pairs[::-1]


def _branches(tree) -> list[list[int]]:
    """Chains below every edge of the tree."""
    if not isinstance(tree, list):
        return [[tree]]
    below = [_branches(t) for t in tree]
    return [b for part in below for b in part] + [sorted(sum((part[-1] for part in below), []))]


def _merge_tree(tree, leaves: dict[int, np.ndarray], gap: Gap, place: dict[int, int]) -> np.ndarray:
    if not isinstance(tree, list):
        return leaves[tree]
    merged = gap.merge(*(_merge_tree(t, leaves, gap, place) for t in tree))
    branches = [[place[c] for c in b] for b in _branches(tree)[:-1]]
    return gap.improve(merged, branches) if len(branches) > 2 else merged


def _gap_sets(chains: list[int], points: list[np.ndarray], tree, cutoff: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Residue sets of one gap (numbers among the present residues of a chain) and the place of those in the chain."""
    held = [np.flatnonzero(~np.isnan(p).any(axis=1)) for p in points]
    gap = Gap([p[h] for p, h in zip(points, held, strict=True)], cutoff)
    leaves = {}
    for k, (chain, h) in enumerate(zip(chains, held, strict=True)):
        leaves[chain] = np.full((len(h), len(chains)), NONE)
        leaves[chain][:, k] = np.arange(len(h))
    return _merge_tree(tree, leaves, gap, {c: k for k, c in enumerate(chains)}), held


def partial_alignment(gaps: DataFrame, tracks: DataFrame, alignments: DataFrame, cutoff: float) -> DataFrame:
    """Sets of at least two residues found in each gap, in order (``part``).

    ``gaps`` and ``tracks`` are those of :mod:`foldloom.operators.extension`.  Gaps are independent
    groups; those where fewer than two chains have residues are dropped before the shuffle.
    """
    width = F.col("gap_last") - F.col("gap_first") + 1
    cut = gaps.where(width > 0).join(tracks, ["job_id", "aln_id", "chain"]).join(
        alignments.select("job_id", "aln_id", "tree"), ["job_id", "aln_id"]).select(
        "job_id", "aln_id", "gap", "chain", "gap_first", "tree",
        *(F.slice(c, F.col("gap_first") + 1, width).alias(c) for c in ("xs", "ys", "zs")))

    def prune(tree, held: set[int]):
        """The tree without chains that have nothing in this gap (they only add empty lists)."""
        if not isinstance(tree, list):
            return tree if tree in held else None
        left, right = (prune(t, held) for t in tree)
        return [left, right] if left is not None and right is not None else (right if left is None else left)

    def merge(key: tuple, group: Group) -> list[tuple]:
        group = ordered(group, "chain")
        chains, base = group["chain"].tolist(), group["gap_first"].tolist()
        tree = prune(json.loads(key[3]), set(chains))
        sets, place = _gap_sets(chains, [points_of(group, k) for k in range(len(chains))], tree, cutoff - ROUND_OFF)
        sets = sets[(sets != NONE).sum(axis=1) >= 2]
        return [
            (*key[:3], part, chains[k], base[k] + int(place[k][r]))
            for part, row in enumerate(sets.tolist()) for k, r in enumerate(row) if r != NONE]

    return map_groups(cut, ["job_id", "aln_id", "gap", "tree"], merge, SETS, least=2)

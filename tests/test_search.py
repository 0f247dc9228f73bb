"""Staged search and chaining on long chains against a plain program over all fragment pairs."""

import math

import numpy as np
import pytest
from conftest import CURVE, residue_frame, rotation, walk
from pyspark.sql import functions as F

from foldloom.functions.scoring import SEARCH_PASSES
from foldloom.operators import chaining, fragments
from foldloom.operators.blocks import label_blocks
from foldloom.operators.columns import conflict_pairs
from foldloom.plans import progressive, search
from foldloom.session import cut_lineage


def bent(points, at, angle):
    c, s = np.cos(angle), np.sin(angle)
    out = points.copy()
    out[at:] = (points[at:] - points[at - 1]) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + points[at - 1]
    return out


@pytest.fixture(scope="module")
def long_chains():
    """A chain of 150 residues; a bent and turned copy; a noisy copy of its middle with a residue missing; an unrelated one."""
    base, rng = walk(150, 21), np.random.default_rng(6)
    noisy = base[30:130] + rng.normal(size=(100, 3)) * 0.35
    noisy[40] = np.nan
    return [base, bent(bent(base, 50, 0.5), 100, -0.6) @ rotation(3).T + 5, noisy @ rotation(8).T - 9, walk(60, 77)]


def all_matches(one, two, lowest):
    """Matches as (p1, p2, len, score, R, t) by singular value decompositions of all pairs."""
    found = []
    for n in range(5, 10):
        a = np.lib.stride_tricks.sliding_window_view(one, n, axis=0).transpose(0, 2, 1)
        b = np.lib.stride_tricks.sliding_window_view(two, n, axis=0).transpose(0, 2, 1)
        ia, ib = (np.flatnonzero(~np.isnan(w).any(axis=(1, 2))) for w in (a, b))
        i, j = (x.ravel() for x in np.meshgrid(ia, ib, indexing="ij"))
        ma, mb = a.mean(axis=1), b.mean(axis=1)
        ca, cb = a[i] - ma[i][:, None], b[j] - mb[j][:, None]
        u, s, vt = np.linalg.svd(np.einsum("kij,kil->kjl", ca, cb))
        sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
        error = (ca ** 2).sum((1, 2)) + (cb ** 2).sum((1, 2)) - 2 * (s[:, 0] + s[:, 1] + sign * s[:, 2])
        rmsd = np.sqrt(np.maximum(error, 0) / n)
        score = np.where(rmsd > 2.8, 0, n * np.interp(rmsd * 1000, np.arange(len(CURVE)), CURVE))
        for k in np.flatnonzero(score >= lowest):
            r = u[k] @ np.diag([1, 1, sign[k]]) @ vt[k]
            found.append((int(i[k]), int(j[k]), n, float(score[k]), r, ma[i[k]] - r @ mb[j[k]]))
    return sorted(found, key=lambda m: m[:3])


def plain_search(one, two):
    """[(p1, p2, len, total)] after three passes, each hinge tested on its own."""
    matches = all_matches(one, two, SEARCH_PASSES[-1][0])
    chain = []
    for least, angle, reach in SEARCH_PASSES:
        filled = []
        for left, right in zip([None, *chain], [*chain, None], strict=True):
            low = (0, 0) if left is None else tuple(matches[left[0]][k] + matches[left[0]][2] for k in (0, 1))
            high = (10 ** 6,) * 2 if right is None else matches[right[0]][:2]
            ids = [k for k, m in enumerate(matches) if m[3] >= least and all(low[s] <= m[s] and m[s] + m[2] <= high[s] for s in (0, 1))]
            carried = filled.pop()[1] if left is not None else None
            ids = [*([left[0]] if left else []), *ids, *([right[0]] if right else [])]
            best, back = {}, {}
            rot, shift = np.array([matches[k][4] for k in ids]), np.array([matches[k][5] for k in ids])
            p1, p2, size = (np.array([matches[k][c] for k in ids]) for c in range(3))
            for n, k in enumerate(ids):
                start = 0.0 if left is None else carried - matches[k][3] if n == 0 else -5000.0
                came = None
                prev = np.flatnonzero((p1[:n] + size[:n] <= p1[n]) & (p2[:n] + size[:n] <= p2[n]))
                prev = np.array([q for q in prev if q in best], int)
                if len(prev):
                    half = np.sqrt(np.maximum(np.einsum("kij,ij->k", rot[prev], rot[n]) + 1, 0) / 4)
                    tail, head = two[p2[prev] + size[prev] - 1], two[p2[n]]
                    one_gap = np.linalg.norm(np.einsum("kij,kj->ki", rot[prev], tail) + shift[prev] - tail @ rot[n].T - shift[n], axis=1)
                    gap = (one_gap + np.linalg.norm(rot[prev] @ head + shift[prev] - rot[n] @ head - shift[n], axis=1)) / 2
                    value = np.array([best[q] for q in prev]) - np.log((1 - np.cos(np.maximum(2 * np.arccos(np.minimum(half, 1)), 0.1))) / 2) + 4 - gap
                    value[(half < math.cos(math.radians(angle) / 2)) | (gap > reach)] = -np.inf
                    if value.max() >= start:
                        came, start = prev[int(value.argmax())], value.max()
                if start >= 0:
                    best[n], back[n] = start + matches[k][3], came
            if best:
                at = len(ids) - 1 if right else max(best, key=lambda n: (best[n], -n))
                path = []
                while at is not None:
                    path.append((ids[at], best[at]))
                    at = back[at]
                filled.extend(path[::-1])
        chain = filled
    return [(*matches[k][:3], total) for k, total in chain]


def test_regions_equal_the_plain_search(spark, long_chains):
    regions, _ = progressive.pair_regions(residue_frame(spark, {0: long_chains}), CURVE)
    found = {}
    for r in regions.orderBy("grp", "ord").collect():
        found.setdefault((r.aln1, r.aln2), []).append((r.p1, r.p2, r.len, r.total))
    for one in range(4):
        for two in range(one):
            expected = plain_search(long_chains[one], long_chains[two])
            got = found.get((one, two), [])
            assert [x[:3] for x in got] == [x[:3] for x in expected], (one, two)
            assert np.allclose([x[3] for x in got], [x[3] for x in expected], atol=1e-6)
    assert sum(x[2] for x in found[1, 0]) > 140 and sum(x[2] for x in found[2, 0]) > 80


def test_first_pass_leaves_pairs_out_and_loses_no_match(spark, long_chains, monkeypatch):
    frags = cut_lineage(fragments.with_shape(fragments.sliding_fragments(fragments.chain_side(label_blocks(residue_frame(spark, {0: long_chains}))))))
    least = SEARCH_PASSES[0][0]
    sizes = {(r.side, r.len): r.n for r in frags.groupBy("side", "len").agg(F.count("*").alias("n")).collect()}
    everything = sum(sizes[a, n] * sizes[b, n] for a in range(4) for b in range(a) for n in range(5, 10))
    strong = {(a, b, *m[:3]) for a in range(4) for b in range(a) for m in all_matches(long_chains[a], long_chains[b], least)}
    for crowd in (fragments.CROWD, 3):  # as it is, and with nearly every cell split over salts
        monkeypatch.setattr(fragments, "CROWD", crowd)
        rows = fragments.shape_pairs(frags, frags, least, CURVE).collect()
        pairs = {(r.a_side, r.b_side, r.a_pos, r.b_pos, r.len) for r in rows}
        # the score's limit alone admits e ** -2 of unrelated pairs
        assert len(pairs) == len(rows) and strong <= pairs and len(pairs) < 0.4 * everything


def test_crowded_gaps_give_the_same_regions(spark, long_chains, monkeypatch):
    job = residue_frame(spark, {0: [long_chains[0][:60], long_chains[1][:60]]})
    plain = sorted(tuple(r) for r in progressive.pair_regions(job, CURVE)[0].select("ord", "p1", "p2", "len").collect())
    monkeypatch.setattr(fragments, "CROWD", 5)
    assert sorted(tuple(r) for r in progressive.pair_regions(job, CURVE)[0].select("ord", "p1", "p2", "len").collect()) == plain


def test_conflicting_columns_may_not_follow(spark):
    """A side of two chains whose blocks overlap: an edge over columns that step back is left out."""
    cols = spark.createDataFrame(
        [("g", 1, 0, c, c if c < 12 else c - 3) for c in range(24)] + [("g", 2, 0, c, c) for c in range(24)], "grp string, side int, slot int, col int, res_idx int")
    conflicts = conflict_pairs(cols, ["grp", "side"])
    assert {(r.side, r.earlier, r.later) for r in conflicts.collect()} == {(1, e, x) for e in range(12) for x in range(12, 24) if e >= x - 3}
    still = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    matches = spark.createDataFrame([("g", 1, 2, 2, 5, still), ("g", 2, 7, 7, 5, still), ("g", 3, 12, 12, 5, still), ("g", 4, 17, 17, 5, still)], "grp string, id long, p1 int, p2 int, len int, m array<double>")
    track = spark.createDataFrame([("g", c, 3.8 * c, 0.0, 0.0) for c in range(24)], "grp string, col int, x double, y double, z double")
    edges = {(r.before, r.after) for r in chaining.hinge_edges(matches, track, 45.0, 4.0, conflicts=conflicts).collect()}
    assert edges == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}


def test_open_gaps(spark):
    pairs = spark.createDataFrame([("a", "p", 1, 2), ("b", "p", 1, 2)], "grp string, pool string, side1 int, side2 int")
    regions = spark.createDataFrame([("a", 0, 3, 4, 5), ("a", 1, 20, 30, 6)], "grp string, ord int, p1 int, p2 int, len int")
    gaps = {tuple(r) for r in search.open_gaps(regions, pairs).select("grp", "gap", "low1", "low2", "high1", "high2").collect()}
    far = search.FAR
    assert gaps == {("a", 0, 0, 0, 3, 4), ("a", 1, 8, 9, 20, 30), ("a", 2, 26, 36, far, far), ("b", 0, 0, 0, far, far)}

"""Superposition, fragment join and radius join against brute force."""

import numpy as np
from conftest import CURVE, residue_frame, rotation, walk
from pyspark.sql import functions as F

from foldloom.functions import scoring
from foldloom.functions.superpose import rotations, superpose_points, with_map
from foldloom.operators import fragments, radius
from foldloom.operators.blocks import label_blocks
from foldloom.operators.chaining import hinge_edges


def exact_rmsd(a, b, proper=True):
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    if proper and np.linalg.det(u) * np.linalg.det(vt) < 0:
        s[2] = -s[2]
    return np.sqrt(max((a ** 2).sum() + (b ** 2).sum() - 2 * s.sum(), 0) / len(a))


def chains():
    a, b = walk(24, 1), walk(20, 2)
    a[7] = np.nan
    mirrored = walk(24, 1) * np.array([1, 1, -1])
    return [a, b, mirrored, walk(24, 1)[::-1] @ rotation(3).T + 5]


def density(r):
    return float(np.interp(r * 1000, np.arange(len(CURVE)), CURVE)) if r <= scoring.MAX_SCORED_RMSD else 0.0


def brute_force(points, min_score):
    out = {}
    for i in range(len(points)):
        for j in range(i):
            for size in range(5, 10):
                for p in range(len(points[i]) - size + 1):
                    for q in range(len(points[j]) - size + 1):
                        a, b = points[i][p:p + size], points[j][q:q + size]
                        if np.isnan(a).any() or np.isnan(b).any():
                            continue
                        r = exact_rmsd(a, b)
                        if size * density(r) >= min_score:
                            out[i, j, p, q, size] = (r, exact_rmsd(a, b, proper=False))
    return out


def test_fragment_join_finds_exactly_the_brute_force_matches(spark, monkeypatch):
    monkeypatch.setattr(fragments, "HOT_CELL", 20)  # every cell counts as crowded
    found = fragments.chain_matches(label_blocks(residue_frame(spark, {0: chains()})), 1.6, CURVE)
    got = {(r.side1, r.side2, r.p1, r.p2, r.len): (r.rmsd, r.rmsd_fast) for r in found.collect()}
    want = brute_force(chains(), 1.6)
    assert set(got) == set(want)
    for key, (rmsd, fast) in want.items():
        # Compared as squares: near zero the root magnifies the rounding of the closed form.
        assert abs(got[key][0] ** 2 - rmsd ** 2) < 1e-7 and abs(got[key][1] ** 2 - fast ** 2) < 1e-7
        assert got[key][1] <= got[key][0] + 1e-9


def test_maps_are_proper_and_reach_the_rmsd(spark):
    points = chains()
    rows = with_map(fragments.chain_matches(label_blocks(residue_frame(spark, {0: points})), 2.0)).collect()
    assert rows
    for r in rows:
        m = np.array(r.m).reshape(3, 4)
        assert np.allclose(m[:, :3] @ m[:, :3].T, np.eye(3), atol=1e-9) and np.linalg.det(m[:, :3]) > 0
        a, b = points[r.side1][r.p1:r.p1 + r.len], points[r.side2][r.p2:r.p2 + r.len]
        moved = b @ m[:, :3].T + m[:, 3]
        assert abs(np.sqrt(((a - moved) ** 2).sum(axis=1).mean()) - r.rmsd) < 1e-6


def test_superposition_undoes_a_rigid_move():
    points = walk(12, 4)
    m = superpose_points(points, points @ rotation(5).T + 3)
    assert np.allclose((points @ rotation(5).T + 3) @ m[:, :3].T + m[:, 3], points)
    flat = np.zeros((4, 3))
    assert np.allclose(np.linalg.det(rotations(np.zeros((1, 3, 3)))), 1) and superpose_points(flat, flat).shape == (3, 4)


def test_collinear_and_identical_chains(spark):
    line = np.arange(8)[:, None] * np.array([[3.8, 0, 0]])
    best = fragments.best_match_per_pair(fragments.chain_matches(
        label_blocks(residue_frame(spark, {0: [line, line @ rotation(1).T], 1: [walk(9, 8), walk(9, 8)]})), 0.6)).collect()
    assert len(best) == 2 and all(r.rmsd < 1e-4 for r in best)


def test_score_curve_falls_and_limits_agree():
    counts = {m: 3 for m in range(200, 2800)} | {2802: 900}
    values = scoring.curve_from_counts(counts, 7.0)
    assert len(values) == scoring.TABLE_SIZE and all(a >= b for a, b in zip(values, values[1:]))
    assert abs(values[1500] + np.log((3 * 1301 + 1) / (3 * 2600 + 901)) / 7) < 1e-12 and values[1500] > values[1501] > values[1520]
    limit = scoring.rmsd_limit(5, 2.0, values)
    assert 5 * values[round(limit * 1000) - 1] >= 2.0 > 5 * values[round(limit * 1000) + 1]
    empty = scoring.curve_from_counts({}, 7.0)
    assert empty[0] > empty[100] > empty[2700] >= 0


def test_score_table_replaces_the_curve(spark):
    table = [3.0 - i / 1000 for i in range(3001)]
    got = spark.createDataFrame([(1.2345, 5), (2.9, 5)], "rmsd double, len int").select(
        scoring.fragment_score("rmsd", F.col("len"), table).alias("s")).collect()
    assert abs(got[0].s - 5 * (3 - 1.2345)) < 1e-9 and got[1].s == 0


def test_normal_cdf(spark):
    got = spark.createDataFrame([(0.0,), (-1.96,), (3.0,)], "z double").select(scoring.normal_cdf("z").alias("p")).collect()
    assert [round(r.p, 4) for r in got] == [0.5, 0.025, 0.9987]


def test_radius_join_equals_cross_join(spark):
    rng = np.random.default_rng(0)
    pts = [(int(g), i, *map(float, rng.normal(size=3) * 4)) for i, g in enumerate(rng.integers(0, 2, 200))]
    df = spark.createDataFrame(pts, "g int, id int, x double, y double, z double")
    want = {(a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and np.linalg.norm(np.subtract(a[2:], b[2:])) <= 2.5}
    for hot in (5, 10_000):
        rows = radius.radius_join(df, df, 2.5, ["g"], hot_cell=hot).select("a_id", "b_id").collect()
        assert len(rows) == len(want) and {(r.a_id, r.b_id) for r in rows} == want


def test_hinge_edges_equal_brute_force(spark):
    points = [walk(22, 31), walk(22, 31) @ rotation(8).T + np.random.default_rng(1).normal(size=(22, 3)) * 0.3]
    found = with_map(fragments.chain_matches(label_blocks(residue_frame(spark, {0: points})), 1.6)).select(
        F.lit("g").alias("grp"), F.concat_ws("-", "p1", "p2", "len").alias("id"), "p1", "p2", "len", "m").collect()
    matches = spark.createDataFrame(found)
    track = spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(points[0])], "grp string, col int, x double, y double, z double")
    want = {}
    for a in found:
        for b in found:
            end = a.p2 + a.len - 1
            if a.p1 + a.len > b.p1 or end >= b.p2:
                continue
            ma, mb = np.array(a.m).reshape(3, 4), np.array(b.m).reshape(3, 4)
            half = np.sqrt(max(np.trace(ma[:, :3].T @ mb[:, :3]) + 1, 0) / 4)
            gap = [np.linalg.norm(ma[:, :3] @ p + ma[:, 3] - mb[:, :3] @ p - mb[:, 3]) for p in (points[0][end], points[0][b.p2])]
            if half >= np.cos(np.pi / 8) and np.mean(gap) <= 5:
                want[a.id, b.id] = np.mean(gap)
    got = {(r.before, r.after): r.displacement for r in hinge_edges(matches, track, 45.0, 5.0).collect()}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_closed_form_rotations_of_every_kind_of_covariance(spark):
    rng = np.random.default_rng(0)
    made = [rng.normal(size=(3, 3)) * 10.0 ** k for k in range(-4, 5)]
    made += [np.outer([1, 2, 3], [2, 1, 0.0]), np.zeros((3, 3)), np.diag([3.0, 2, -2]), np.diag([1, 1, 0.0]), np.diag([-1.0, -1, -1])]
    names = ", ".join(f"{n} double" for n in fragments.COVARIANCE)
    rows = [(i, *map(float, c.ravel()), 1.0, 2.0, 3.0, 0.0, 0.0, 0.0) for i, c in enumerate(made)]
    frame = spark.createDataFrame(rows, f"i int, {names}, m1x double, m1y double, m1z double, m2x double, m2y double, m2z double")
    for r in with_map(frame).collect():
        m = np.array(r.m).reshape(3, 4)
        turn, best = m[:, :3], rotations(made[r.i])[0]
        assert np.allclose(turn @ turn.T, np.eye(3), atol=1e-6) and np.linalg.det(turn) > 0.999 and np.allclose(m[:, 3], [1, 2, 3])
        scale = max(np.abs(made[r.i]).max(), 1e-12)
        assert ((best - turn) * made[r.i]).sum() / scale < 1e-5

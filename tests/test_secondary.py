"""Helices, ladders and sheets against plain scans; SHEET records read back."""

import random

import pytest

from foldloom.operators import secondary
from foldloom.sources import pdb

LENGTH = 40


@pytest.fixture(scope="module")
def bonds(spark):
    """Chains of bonds with planted helices and ladders that overlap, and random ones."""
    rnd, rows = random.Random(4), {}
    for chain in range(60):
        found = set()
        for _ in range(rnd.randint(0, 4)):
            i, n, k = rnd.randint(0, 25), rnd.randint(1, 7), rnd.choice((3, 4, 5))
            found |= {(i + x, i + x + k) if rnd.random() < .5 else (i + x + k, i + x) for x in range(n)} if rnd.random() < .3 else (
                {(i + x, i + x + k) for x in range(n)} if rnd.random() < .5 else {(i + x + k, i + x) for x in range(n)})
        for _ in range(rnd.randint(0, 4)):
            i, j, n = rnd.randint(0, 20), rnd.randint(8, 32), rnd.randint(1, 4)
            for x in range(0, 2 * n, 2):
                if rnd.random() < .5 or x == 0:
                    found |= {(i + x, j - x), (j - x, i + x)}
                else:
                    found |= {(i + x, j + x - 1), (j + x + 1, i + x)}
            if rnd.random() < .5:
                found |= {p for x in range(0, 2 * n, 2) for p in ((i + x, j + x - 1), (j + x + 1, i + x))}
        found |= {(rnd.randrange(LENGTH), rnd.randrange(LENGTH)) for _ in range(rnd.randint(0, 12))}
        rows[chain] = sorted(p for p in found if 0 <= min(p) and max(p) < LENGTH and p[1] not in (p[0], p[0] - 1))
    frame = spark.createDataFrame(
        [(0, c, d, a, -900.0, 1) for c, found in rows.items() for d, a in found], "job_id long, chain long, donor int, acceptor int, energy double, rank int")
    return rows, frame


def plain_helices(found):
    have, out = set(found), []
    for step, kind in ((4, 1), (3, 5), (5, 3)):
        free = 0
        for i in range(LENGTH):
            runs = [next(n for n in range(LENGTH) if (i + n, i + n + step)[::way] not in have) for way in (1, -1)]
            back = next((w for w in (0, 1) if runs[w] >= 2), None)
            if i >= free and back is not None:
                free = i + runs[back]
                out.append((i, runs[back] + step - 1 + back, kind))
    return sorted(out)


def plain_ladders(found):
    """Residue pairs of each ladder written out; a bond is passed over if its pair, or the acceptor's successor's, is among them."""
    have, out, told = set(found), [], set()

    def reach(full, single):
        n = next(k for k in range(1, LENGTH) if not full(k))
        return 2 * (n - 1) + single(n)

    for x, y in sorted(found):
        if {(x, y), (y, x), (x, y + 1), (y + 1, x)} & told:
            continue
        z = y + 1
        offers = []
        if (y, x) in have:
            offers.append((-1, y, *(reach(
                lambda k, w=w: (x + 2 * w * k, y - 2 * w * k) in have and (y - 2 * w * k, x + 2 * w * k) in have,
                lambda k, w=w: (x + 2 * w * k, y - 2 * w * k)[::w] in have) for w in (1, -1))))
        if (z + 1, x) in have:
            offers.append((1, z, reach(
                lambda k: (x + 2 * k, z + 2 * k - 1) in have and (z + 2 * k + 1, x + 2 * k) in have, lambda k: (x + 2 * k, z + 2 * k - 1) in have),
                reach(lambda k: (z - 2 * k + 1, x - 2 * k) in have and (x - 2 * k, z - 2 * k - 1) in have, lambda k: (z - 2 * k + 1, x - 2 * k) in have)))
        for way, mate, up, down in offers:
            pairs = [(x + k, mate + way * k) for k in range(-down, up + 1)]
            if len(pairs) > 1:
                # from the strand that begins lower, in its order
                pairs = pairs if pairs[0][0] < pairs[0][1] else [p[::-1] for p in pairs][::way]
                out.append((*pairs[0], way, len(pairs)))
                told |= set(pairs)
                break
    return sorted(out)


def collected(frame, *names):
    out = {}
    for r in frame.collect():
        out.setdefault(r.chain, []).append(tuple(r[n] for n in names))
    return {c: sorted(v) for c, v in out.items()}


def test_helices_as_scanned(bonds):
    rows, frame = bonds
    expected = {c: plain_helices(found) for c, found in rows.items()}
    assert sum(map(len, expected.values())) > 50
    assert collected(secondary.helices(frame), "start", "length", "class") == {c: v for c, v in expected.items() if v}


def test_ladders_as_scanned(bonds):
    rows, frame = bonds
    expected = {c: plain_ladders(found) for c, found in rows.items()}
    assert sum(map(len, expected.values())) > 50 and {d for v in expected.values() for _, _, d, _ in v} == {-1, 1}
    assert collected(secondary.strand_pairs(frame), "start1", "start2", "direction", "length") == {c: v for c, v in expected.items() if v}


def test_sheets_go_on_and_do_not_fold_back(spark):
    """Three strands side by side make one sheet; a third strand on the side of the first one makes another."""
    def strand(k, first, turned=False):
        xs = range(4)[::-1] if turned else range(4)
        return [(first + n, 3.3 * x, 4.8 * k, 0.0) for n, x in enumerate(xs)]

    flat = strand(0, 0) + strand(1, 10, True) + strand(2, 20)
    folded = strand(0, 0) + strand(1, 10, True) + strand(0.2, 20)
    points = [(0, c, i, x, y, z) for c, cells in enumerate((flat, folded)) for i, x, y, z in cells]
    pairs = [(0, c, 0, 13, -1, 4) for c in (0, 1)] + [(0, c, 10, 23, -1, 4) for c in (0, 1)]
    out = secondary.sheets(
        spark.createDataFrame(pairs, "job_id long, chain long, start1 int, start2 int, direction int, length int"),
        spark.createDataFrame(points, "job_id long, chain long, res_idx int, x double, y double, z double"))
    assert collected(out, "sheet", "ord", "start1", "start2", "direction", "length") == {
        0: [(0, 0, 0, 13, -1, 4), (0, 1, 10, 23, -1, 4)], 1: [(0, 0, 0, 13, -1, 4), (1, 0, 10, 23, -1, 4)]}


def test_sheets_grow_to_both_sides(spark):
    """The first ladder lies in the middle: the walk goes out of both its strands."""
    cells = [(first + n, 3.3 * n, 4.8 * k, 0.0) for k, first in ((1, 0), (2, 10), (0, 20), (3, 30)) for n in range(4)]
    pairs = [(0, 0, 0, 10, 1, 4), (0, 0, 0, 20, 1, 4), (0, 0, 10, 30, 1, 4)]
    out = secondary.sheets(
        spark.createDataFrame(pairs, "job_id long, chain long, start1 int, start2 int, direction int, length int"),
        spark.createDataFrame([(0, 0, *c) for c in cells], "job_id long, chain long, res_idx int, x double, y double, z double"))
    assert collected(out, "sheet", "ord", "start1", "start2") == {0: [(0, 0, 20, 0), (0, 1, 0, 10), (0, 2, 10, 30)]}


def test_sheet_registration(spark):
    """Registered pairs reach to both strands' ends; parallel bonds join residues one apart."""
    def record(strand, sheet, first, last, sense, cur=None, prev=None, atom="O", chain="A"):
        head = f"SHEET  {strand:3d} {sheet:>3s} 2 ALA {chain}{first:4d}  ALA {chain}{last:4d} {sense:2d}"
        return head + ("" if cur is None else f"  {atom}  ALA {chain}{cur:4d}   N  ALA {chain}{prev:4d} ")

    lines = [
        record(1, "X", 1, 6, 0), record(2, "X", 11, 15, -1, 13, 3), record(3, "X", 21, 26, 1, 22, 14),
        record(1, "Y", 1, 4, 0), record(2, "Y", 11, 14, 1, 12, 3, "N"), record(1, "Z", 1, 5, 0), record(2, "Z", 30, 35, 1, 35, 99),
        record(3, "Z", 11, 15, -1, 13, 32), record(1, "W", 8, 9, 0), record(2, "W", 11, 11, -1, 11, 9)]
    numbers = spark.createDataFrame([("f", 0, 0, "A", n, " ", n - 1) for n in range(1, 41)], "path string, model_ord int, model_no int, chain_id string, res_num int, ins_code string, res_idx int")
    found = pdb.sheet_pairs(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "path string, line_no int, line string"), numbers)
    assert sorted(tuple(r)[3:] for r in found.collect()) == [("X", 2, 0, 14, -1, 5), ("X", 3, 11, 20, 1, 4), ("Y", 2, 2, 10, 1, 2)]

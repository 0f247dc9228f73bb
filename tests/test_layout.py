"""Column compaction by stretches against a walk over whole alignments."""

import numpy as np

from foldloom.operators import layout


def walked(rows):
    """Columns inserted one by one, each as far left as it may go."""
    order = []
    for column in zip(*rows):
        held = {k for k, c in enumerate(column) if c != "-"}
        at = len(order)
        while at and min(held) < min(order[at - 1][0]) and not held & order[at - 1][0]:
            at -= 1
        order.insert(at, (held, column))
    return ["".join(column[k] for _, column in order) for k in range(len(rows))]


def test_compaction_by_stretches(spark):
    rng = np.random.default_rng(8)
    cells, expected = [], {}
    for job, n in enumerate((1, 2, 3, 5, 70)):
        columns = []
        for _ in range(60):
            held = set(range(n)) if rng.random() < 0.15 else set(rng.choice(n, rng.integers(1, max(2, n // 2 + 1)), replace=False).tolist())
            columns.append(["ACDEFG"[rng.integers(6)] if k in held else "-" for k in range(n)])
        columns.insert(0, ["M"] * n)  # every chain has a letter
        rows = ["".join(c[k] for c in columns) for k in range(n)]
        expected |= {(job, k): r for k, r in enumerate(walked(rows))}
        cells += [(job, 0, k, 100 * job + k, i, c, i) for k, r in enumerate(rows) for i, c in enumerate(r) if c != "-"]
    placed = spark.createDataFrame(cells, "job_id long, aln_id long, slot int, chain long, res_idx int, letter string, pos int")
    packed = layout.compact_columns(placed)
    assert packed.dtypes[-1] == ("pos", "int") and packed.count() == len(cells)
    assert {(r.job_id, r.slot): r.row for r in layout.gapped_rows(packed).collect()} == expected
    assert layout.compact_columns(placed.limit(0)).collect() == []

"""Minimax shards against a brute-force partition, and rows of every odd kind."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import pytest

from foldloom.llm import shard_cuts

DOCS = "doc_id long, text string, digest string, size string, shard int, slot int"
EXTRA = ("d", "s", 1, 2)


def least_largest(sizes: list[int], shards: int) -> int:
    """Dynamic program over all contiguous partitions."""
    before = [0, *accumulate(sizes)]
    best = before
    for _ in range(shards - 1):
        best = [min(max(best[j], before[i] - before[j]) for j in range(i + 1)) for i in range(len(before))]
    return best[-1]


def test_capacity_is_the_least_one():
    rnd = random.Random(1)
    for _ in range(300):
        shards = rnd.randint(1, 9)
        groups = {"".join(rnd.choice("0123") for _ in range(6)): rnd.choice([1, 2, rnd.randint(1, 50), rnd.choice([1, 400])]) for _ in range(rnd.randint(0, 60))}

        def parts(prefixes, groups=groups):
            found = {}
            for digest, size in sorted(groups.items()):
                for p in prefixes:
                    if digest.startswith(p):
                        found.setdefault(digest[:len(p) + 1], []).append(size)
            return [(p, sum(v), len(v), max(v)) for p, v in found.items()]

        capacity, cuts = shard_cuts.minimax_cuts(parts([""]), shards, parts)
        assert capacity == least_largest([groups[g] for g in sorted(groups)], shards)
        filled = Counter()
        for digest, size in groups.items():
            filled[sum(digest >= c for c in cuts)] += size
        assert max(filled.values(), default=0) <= capacity and sorted(filled) == list(range(len(filled)))


@pytest.mark.parametrize("hot", [False, True])
def test_shards_of_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(shard_cuts, "START_DIGITS", 1)
    rows = [(k, f"text {k} " * (k % 17), *EXTRA) for k in range(300)]
    rows += [(None, None, *EXTRA), (None, "ünï 🙂", *EXTRA), (5, "", *EXTRA), (7, "x" * 20_000, *EXTRA), (0, None, *EXTRA)]
    rows += [(k, "copy of one text", *EXTRA) for k in range(1000, 1400 if hot else 1003)] + [(9, "same row", *EXTRA)] * (150 if hot else 2)
    out = shard_cuts.byte_shards(spark.createDataFrame(rows, DOCS).repartition(7), 8).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter((r.size, r.text_crc32) for r in out) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    homes, sizes = {}, Counter()
    for r in out:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert r.text_crc32 in {zlib.crc32((t or "").encode()) for i, t, *_ in rows if i == r.doc_id}
    assert all(len(s) == 1 for s in homes.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= least_largest([groups[g] for g in sorted(groups)], 8)


def test_no_rows_and_one_group(spark):
    assert shard_cuts.byte_shards(spark.createDataFrame([], DOCS)).collect() == []
    out = shard_cuts.byte_shards(spark.createDataFrame([(k, "one", *EXTRA) for k in range(40)], DOCS)).collect()
    assert {r.shard for r in out} == {0} and sorted(r.slot for r in out) == list(range(40))

"""Groups reach Python many in a batch, dealt over all partitions, and none as a pandas frame of its own."""

from __future__ import annotations

import re

import numpy as np
import pytest

from foldloom.operators import extension, grouped, layout, partial, realign, rigid
from foldloom.plans import job

KEYS = "job_id long, aln_id long"
XYZ = "x double, y double, z double"
TRACKS = "xs array<double>, ys array<double>, zs array<double>"


def made_by(spark, name: str):
    def empty(schema: str):
        return spark.createDataFrame([], schema)

    gaps = f"{KEYS}, gap int, chain long, gap_first int, gap_last int"
    tracks, alignments = empty(f"{KEYS}, chain long, {TRACKS}"), empty(f"{KEYS}, tree string")
    block = "grp string, side int, block int, slot int, chain long"
    return {
        "realign": lambda: realign.realign_blocks(empty(f"{block}, col int, res_idx int, {XYZ}, sx double, sy double, sz double")),
        "extend": lambda: realign.extend_blocks(
            empty(f"job_id long, {block}, t int, res_idx int, {XYZ}, m array<double>"), empty(f"job_id long, chain long, {TRACKS}")),
        "rigid": lambda: rigid.rigid_maps(
            empty(f"{KEYS}, chain long, col int, res_idx int"), alignments, empty(f"job_id long, chain long, res_idx int, {XYZ}")),
        "extension": lambda: extension.final_extension(empty(gaps), tracks, 5.0),
        "partial": lambda: partial.partial_alignment(empty(gaps), tracks, alignments, 5.0),
        "layout": lambda: layout.compact_columns(empty(f"{KEYS}, slot int, chain long, res_idx int, letter string, pos int")),
    }[name]()


@pytest.mark.parametrize("name", ["realign", "extend", "rigid", "extension", "partial", "layout"])
def test_no_python_call_for_each_group(spark, name):
    plan = made_by(spark, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_groups_of_a_batch(spark):
    """NULL numbers are NaN, NULL lists None; small groups are left out; few bytes stay in as many partitions as the session has."""
    rows = [(k % 50, "b", k, None if k < 50 else 1.5, None if k < 50 else [1.0, None]) for k in range(100)] + [(99, "b", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "a long, b string, k int, v double, l array<double>")

    def seen(key: tuple, group: dict) -> list[tuple]:
        group = grouped.ordered(group, "k")
        first, second = group["l"]
        return [(*key, int(group["k"].sum()), bool(np.isnan(group["v"][0])), first is None and bool(np.isnan(second[1])))]

    out = grouped.map_groups(df, ["a", "b"], seen, "a long, b string, s int, nan boolean, none boolean", least=2)
    assert sorted(map(tuple, out.collect())) == [(k, "b", 2 * k + 50, True, True) for k in range(50)]
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert grouped.map_groups(df.limit(0), ["a", "b"], seen, "a long, b string, s int, nan boolean, none boolean").collect() == []


def test_blocks_of_bent_alignments_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(job, "cut_lineage", lambda df: df)
    merged = {
        "columns": spark.createDataFrame([], f"{KEYS}, slot int, chain long, block int, col int, res_idx int, {XYZ}"),
        "alignments": spark.createDataFrame([], f"{KEYS}, n_chains int")}
    _, maps = job.bent_blocks(merged, spark.createDataFrame([], f"job_id long, chain long, res_idx int, {XYZ}"))
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(grp#\d+, (?!chain)\S+, block#\d+, \d+\), ENSURE", plan)

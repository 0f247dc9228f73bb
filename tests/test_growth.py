"""Steps whose rows must grow no faster than their input, and the same results from their ways for crowded groups."""

import pytest

import __spark_entry__ as contract
from conftest import CURVE, SMALL, residue_frame, rotation, walk
from pyspark.sql import functions as F

from foldloom.operators import chaining, fragments, radius, secondary
from foldloom.operators.blocks import label_blocks
from foldloom.plans import search
from foldloom.session import cut_lineage


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def frags(spark):
    chains = [walk(40, 5), walk(40, 5) @ rotation(4).T + 3, walk(35, 9)]
    labelled = label_blocks(residue_frame(spark, {0: chains, 1: chains[:2]}))
    return cut_lineage(fragments.with_shape(fragments.sliding_fragments(fragments.chain_side(labelled))))


@pytest.fixture(scope="module")
def matches(frags):
    found = search.strong_matches(frags, F.concat_ws(":", "grp", "side1", "side2"), 1.6, CURVE)
    return cut_lineage(found.withColumn("from2", F.lit(6)))


@pytest.fixture(scope="module")
def track(spark, matches):
    points = spark.createDataFrame([(c, *map(float, p)) for c, p in enumerate(walk(40, 5))], "col int, x double, y double, z double")
    return cut_lineage(matches.select("grp").distinct().crossJoin(points))


def test_hinges_copy_no_match_for_every_column(matches, track, monkeypatch):
    names = ["grp", "gap", "before", "after", "end2"]

    def edges():
        return chaining.hinge_edges(matches, track, 45.0, 4.0, ("grp", "gap"))

    direct = edges()
    assert "Generate" not in plan(direct)
    rows = sorted(tuple(r) for r in direct.select(names).collect())
    sizes = [r.n for r in matches.groupBy("grp").agg(F.count("*").alias("n")).collect()]
    assert min(sizes) < max(sizes)
    monkeypatch.setattr(chaining, "CROWD", min(sizes))  # some merges are crowded, others are not
    assert rows and rows == sorted(tuple(r) for r in edges().select(names).collect())


def test_fragments_of_a_small_pool_are_not_copied(frags, matches, monkeypatch):
    def found():
        return search.strong_matches(frags, F.concat_ws(":", "grp", "side1", "side2"), 1.6, CURVE)

    larger = F.col("a_side") > F.col("b_side")
    assert "Generate" not in plan(found())
    assert "Generate" not in plan(fragments.match_fragments(frags, frags, 1.6, CURVE, larger))
    rows = sorted(tuple(r) for r in found().select("grp", "id").collect())
    sizes = [r.n for r in frags.groupBy("grp", "len").agg(F.count("*").alias("n")).collect()]
    monkeypatch.setattr(fragments, "CROWD", sorted(sizes)[len(sizes) // 2])  # half the pools are large
    assert rows == sorted(tuple(r) for r in found().select("grp", "id").collect())
    scored = fragments.match_fragments(frags, frags, 1.6, CURVE, larger)
    assert len(rows) == scored.count() == scored.select("grp", "side1", "side2", "p1", "p2", "len").distinct().count()


def test_residues_of_short_chains_are_not_copied(spark, monkeypatch):
    residues = [(0, c, i, "A", *map(float, p)) for c, n in ((0, 30), (1, 70)) for i, p in enumerate(walk(n, 40 + c) * 0.6)]
    points = spark.createDataFrame(residues, "job_id long, chain long, res_idx int, letter string, cax double, cay double, caz double")
    shift = {"n": (-0.8, 0.9, 0.2), "c": (0.9, 0.8, 0.1), "o": (1.1, 1.9, 0.4)}
    backbone = points.select("*", *((F.col(f"ca{x}") + by[k]).alias(f"{a}{x}") for a, by in shift.items() for k, x in enumerate("xyz")))

    def bonds():
        return sorted(tuple(r) for r in secondary.hydrogen_bonds(backbone).collect())

    rows = bonds()  # both chains are short
    assert rows and max(r[1] for r in rows) == 1
    copied = [r.n for r in radius.radius_join(
        backbone.select("job_id", "chain", "res_idx", (F.col("chain") < 9).alias("s"), *(F.col(f"ca{x}").alias(x) for x in "xyz")),
        backbone.select("job_id", "chain", "res_idx", (F.col("chain") < 9).alias("s"), *(F.col(f"ca{x}").alias(x) for x in "xyz")),
        9.0, ["job_id", "chain"], hot_cell=None, small="s").groupBy("chain", "a_res_idx", "b_res_idx").agg(F.count("*").alias("n")).collect()]
    assert set(copied) == {1}
    monkeypatch.setattr(secondary, "SHORT_CHAIN", 50)  # one short, one long
    assert bonds() == rows
    monkeypatch.setattr(secondary, "SHORT_CHAIN", 0)
    assert bonds() == rows


def test_many_chains_go_to_python_at_once(spark, matches, track):
    edges = chaining.hinge_edges(matches, track, 45.0, 4.0, ("grp", "gap"))
    chains = chaining.chain_matches(matches.select("grp", "id", "score", F.lit(0).alias("kind")), edges, [(1.6, 45.0, 4.0)])
    read = contract.queries()["sequence_reconciliation"](spark, SMALL)
    for frame in (chains, read):
        assert "MapInArrow" in plan(frame) and "CoGroup" not in plan(frame)
    totals = {r.grp: r.total for r in chains.groupBy("grp").agg(F.max("total").alias("total")).collect()}
    best = {r.grp: r.score for r in matches.groupBy("grp").agg(F.max("score").alias("score")).collect()}
    assert set(totals) == set(best) and all(totals[g] >= best[g] for g in best)  # no chain is worse than its best match

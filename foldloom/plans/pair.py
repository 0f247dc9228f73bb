"""Alignment of two alignments: prepare both sides, match fragments, chain them, build columns.

Tables used here and in :mod:`foldloom.plans.progressive`:

* members: job_id, aln_id, slot, chain -- the chains of an alignment; slot 0 is the representative
* columns: job_id, aln_id, slot, chain, block, col, res_idx, x, y, z -- aligned residues, moved
* merges: job_id, grp, aln1, rep1, aln2, rep2 -- alignments to be aligned and their representatives
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.operators.columns import conflict_pairs
from foldloom.operators.fragments import sliding_fragments, with_shape
from foldloom.operators.realign import extend_blocks, realign_blocks
from foldloom.plans.search import find_regions
from foldloom.session import cut_lineage


def swapped(slot: Column, rep: Column) -> Column:
    """Slot numbers after the representative and slot 0 trade places."""
    return F.when(slot == rep, F.lit(0)).when(slot == 0, rep).otherwise(slot)


def source_tracks(residues: DataFrame) -> DataFrame:
    """Every chain as three coordinate arrays in residue order (residues are numbered from 0)."""
    ordered = F.array_sort(F.collect_list(F.struct("res_idx", "x", "y", "z")))
    return residues.groupBy("job_id", "chain").agg(ordered.alias("r")).select(
        "job_id", "chain", F.col("r.x").alias("xs"), F.col("r.y").alias("ys"), F.col("r.z").alias("zs"))


def sides_of(merges: DataFrame) -> DataFrame:
    """One row per side of every merge."""
    return merges.select(
        "job_id", "grp",
        F.explode(F.array(
            F.struct(F.lit(1).alias("side"), F.col("aln1").alias("aln_id"), F.col("rep1").alias("rep")),
            F.struct(F.lit(2).alias("side"), F.col("aln2").alias("aln_id"), F.col("rep2").alias("rep")),
        )).alias("s"),
    ).select("job_id", "grp", "s.*")


def prepare_sides(merges: DataFrame, columns: DataFrame, residues: DataFrame, tracks: DataFrame) -> DataFrame:
    """Columns of both sides of every merge: representative first, realigned, extended, renumbered.

    Single chains pass through untouched.  Result: job_id, grp, side, slot, chain, block, col,
    res_idx, x, y, z.
    """
    sided = sides_of(merges).join(columns, ["job_id", "aln_id"]).withColumn("slot", swapped(F.col("slot"), F.col("rep")))
    many = sided.groupBy("grp", "side").agg(F.max("slot").alias("_top"))
    sided = sided.join(many, ["grp", "side"])
    single = sided.where(F.col("_top") == 0)
    source = residues.select("job_id", "chain", "res_idx", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    multiple = sided.where(F.col("_top") > 0).join(source, ["job_id", "chain", "res_idx"])
    jobs = merges.select("job_id", "grp")
    realigned = cut_lineage(realign_blocks(multiple.select(
        "grp", "side", "block", "slot", "chain", "col", "res_idx", *"xyz", "sx", "sy", "sz")).join(jobs, "grp"))
    names = ["job_id", "grp", "side", "slot", "chain", "block", "t", "res_idx", *"xyz"]
    extended = realigned.select(names).unionByName(
        extend_blocks(realigned, tracks).join(jobs, "grp").select(names))
    order = Window.partitionBy("grp", "side", "slot").orderBy("block", "t")
    renumbered = extended.withColumn("col", F.row_number().over(order) - 1)
    out = ["job_id", "grp", "side", "slot", "chain", "block", "col", "res_idx", *"xyz"]
    return single.select(out).unionByName(renumbered.select(out))


def average_tracks(sided: DataFrame) -> DataFrame:
    """Mean position and spread of every column of a side."""
    return sided.groupBy("grp", "side", "col", "block").agg(
        *(F.avg(c).alias(c) for c in "xyz"), (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"))


def align_sides(sided: DataFrame, table: Sequence[float]) -> DataFrame:
    """Accepted regions of every merge (see ``search.find_regions``)."""
    tracks = cut_lineage(average_tracks(sided))
    frags = cut_lineage(with_shape(sliding_fragments(tracks)))
    pairs = sided.groupBy("grp").agg(F.countDistinct("side").alias("n")).where("n = 2").select(
        "grp", F.col("grp").alias("pool"), F.lit(1).alias("side1"), F.lit(2).alias("side2"))
    conflicts = cut_lineage(conflict_pairs(sided, ["grp", "side"]))
    return find_regions(frags, tracks, pairs, table, conflicts=None if conflicts.isEmpty() else conflicts)


def build_columns(regions: DataFrame, sided: DataFrame) -> DataFrame:
    """Columns of the merged alignments: side 1 as it is, side 2 moved region by region.

    Slots of side 2 follow those of side 1; ``block`` and ``col`` are renumbered.
    """
    order = Window.partitionBy("grp").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = regions.withColumn("offset", F.coalesce(F.sum("len").over(order), F.lit(0)))
    cells = placed.select(
        "grp", F.col("ord").alias("block"), "m", "offset",
        F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"), "p1", "p2")
    ends = cells.select(
        "grp", "block", "m", (F.col("offset") + F.col("k")).cast("int").alias("new_col"),
        F.explode(F.array(
            F.struct(F.lit(1).alias("side"), (F.col("p1") + F.col("k")).alias("col")),
            F.struct(F.lit(2).alias("side"), (F.col("p2") + F.col("k")).alias("col")),
        )).alias("e"),
    ).select("grp", "block", "m", "new_col", "e.*")
    width = sided.where(F.col("side") == 1).groupBy("grp").agg((F.max("slot") + 1).alias("_n1"))
    joined = ends.join(sided.drop("block"), ["grp", "side", "col"]).join(width, "grp")
    moved = g.apply_affine(g.unpack(F.col("m")), g.vec("x", "y", "z"))
    second = F.col("side") == 2
    return joined.select(
        "job_id", "grp", F.when(second, F.col("slot") + F.col("_n1")).otherwise(F.col("slot")).alias("slot"),
        "chain", "block", F.col("new_col").alias("col"), "res_idx",
        *(F.when(second, v).otherwise(F.col(c)).alias(c) for c, v in zip("xyz", moved)),
    )

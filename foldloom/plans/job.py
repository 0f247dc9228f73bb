"""From residues to the final alignment of every job: merge, superpose, extend, fill in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions.scoring import normal_cdf, significance_z
from foldloom.functions.superpose import superposition_aggregate, with_map
from foldloom.operators.columns import column_rmsd, input_order, reorder
from foldloom.operators.extension import DEFAULT_CUTOFF, alignment_gaps, final_extension, insert_blocks
from foldloom.operators.partial import partial_alignment
from foldloom.operators.realign import realign_blocks
from foldloom.operators.rigid import move_chains, rigid_maps
from foldloom.plans.pair import source_tracks
from foldloom.plans.progressive import multiple_alignment
from foldloom.session import cut_lineage

KEYS = ["job_id", "aln_id"]


def chain_lengths(residues: DataFrame) -> DataFrame:
    return residues.groupBy("job_id", "chain").agg(F.count(F.lit(1)).cast("int").alias("length"))


def located(columns: DataFrame, placed: DataFrame) -> DataFrame:
    """Columns with the coordinates that their residues have in ``placed``."""
    return columns.drop("x", "y", "z").join(
        placed.select("job_id", "chain", "res_idx", *"xyz"), ["job_id", "chain", "res_idx"])


def aligned_tracks(placed: DataFrame, members: DataFrame) -> DataFrame:
    return source_tracks(placed).join(members.select(*KEYS, "chain"), ["job_id", "chain"])


def superpose_rigidly(columns: DataFrame, alignments: DataFrame, placed: DataFrame) -> DataFrame:
    """Residues of the given alignments after one rigid superposition of their chains."""
    return move_chains(placed, rigid_maps(columns, alignments, placed))


def extend_to_fixed_point(
    columns: DataFrame, alignments: DataFrame, members: DataFrame, placed: DataFrame, cutoff: float
) -> tuple[DataFrame, DataFrame]:
    """Alternate gap filling and superposition until the core of an alignment stops growing.

    Every round handles only the alignments that grew in the one before.
    """
    names = [*KEYS, "chain", "res_idx", "block", "col"]
    lengths = cut_lineage(chain_lengths(placed))
    active, active_placed = cut_lineage(columns.select(names)), cut_lineage(placed)
    done: list[tuple[DataFrame, DataFrame]] = []
    while cutoff > 0:
        inserts = cut_lineage(final_extension(
            alignment_gaps(active, lengths), aligned_tracks(active_placed, members), cutoff))
        grown = cut_lineage(inserts.select(KEYS).distinct())
        jobs = grown.select("job_id").distinct()
        done.append((active.join(grown, KEYS, "left_anti"), active_placed.join(jobs, "job_id", "left_anti")))
        active = active.join(grown, KEYS, "left_semi")
        active_placed = active_placed.join(jobs, "job_id", "left_semi")
        if grown.isEmpty():
            break
        active = cut_lineage(insert_blocks(active, inserts).select(names))
        active_placed = cut_lineage(superpose_rigidly(active, alignments, active_placed))
    for settled, settled_placed in done:
        active = active.unionByName(settled)
        active_placed = active_placed.unionByName(settled_placed)
    return cut_lineage(active), cut_lineage(active_placed)


def chain_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """The one rigid map of every chain that carries its loaded residues to their final places."""
    a = after.where("x IS NOT NULL").select("job_id", "chain", "res_idx", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = before.where("x IS NOT NULL").select("job_id", "chain", "res_idx", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    return with_map(superposition_aggregate(a.join(b, ["job_id", "chain", "res_idx"]), ["job_id", "chain"])).select(
        "job_id", "chain", "m")


def finish_alignments(
    merged: dict[str, DataFrame], residues: DataFrame, cutoff: float = DEFAULT_CUTOFF, partial: bool = True
) -> dict[str, DataFrame]:
    """Superpose, extend and report the result of :func:`multiple_alignment`.

    Returns ``alignments`` (adds rmsd, pvalue for pairs, n_core, reference chain), ``columns`` in input
    order with superposed coordinates (partial columns included), ``core`` (without them) and
    ``residues`` (all residues, superposed), ``moves`` (one rigid map per chain).  The p-value comes before the extension, the RMSD after
    it and before partial columns.
    """
    if cutoff < 0:
        raise ValueError("the cutoff must not be negative")
    alignments = merged["alignments"].where("n_cols > 0 AND n_chains > 1")
    members, columns = merged["members"], merged["columns"].join(alignments.select(KEYS), KEYS, "left_semi")
    residues = residues.join(alignments.select("job_id").distinct(), "job_id", "left_semi")
    placed = cut_lineage(superpose_rigidly(columns, alignments, residues))
    first = column_rmsd(located(columns, placed))
    pvalues = first.join(alignments.select(*KEYS, "n_chains"), KEYS).where("n_chains = 2").select(
        *KEYS, normal_cdf(significance_z(F.col("rmsd"), F.col("n_cols"))).alias("pvalue"))
    core, placed = extend_to_fixed_point(columns, alignments, members, placed, cutoff)
    final = column_rmsd(located(core, placed)).withColumnRenamed("n_cols", "n_core")
    order = input_order(members)
    full = core
    if partial and cutoff > 0:
        sets = partial_alignment(
            alignment_gaps(core, chain_lengths(placed)), aligned_tracks(placed, members), alignments, cutoff)
        full = insert_blocks(core, sets.withColumn("t", F.lit(0)))
    reference = members.where("slot = 0").select(*KEYS, F.col("chain").alias("reference"))
    report = (
        alignments.select(*KEYS, "tree", "score", "n_chains").join(final, KEYS)
        .join(pvalues, KEYS, "left").join(reference, KEYS)
    )
    return {
        "alignments": report,
        "members": order.join(alignments.select(KEYS), KEYS, "left_semi"),
        "core": reorder(located(core, placed), order),
        "columns": reorder(located(full, placed), order),
        "residues": placed,
        "moves": chain_moves(residues, placed),
    }


def bent_blocks(merged: dict[str, DataFrame], residues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and per-block maps of every chain of the flexible ("bent") superposition."""
    source = residues.select("job_id", "chain", "res_idx", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    columns = merged["columns"].join(
        merged["alignments"].where("n_chains > 1").select(KEYS), KEYS, "left_semi"
    ).join(source, ["job_id", "chain", "res_idx"])
    # a constant would be left out of the grouping, which then would not find its rows dealt and deal them again, to few tasks
    keyed = columns.withColumn("grp", F.concat_ws(":", *KEYS)).withColumn("side", (F.col("slot") - F.col("slot") + 1).cast("int"))
    realigned = realign_blocks(keyed.select(
        "grp", "side", "block", "slot", "chain", "col", "res_idx", *"xyz", "sx", "sy", "sz"))
    maps = cut_lineage(
        realigned.groupBy("grp", "chain", "block").agg(F.first("m").alias("m"), F.min("res_idx").alias("first_idx"))
        .withColumn("job_id", F.split("grp", ":")[0].cast("long")))
    return maps.select("job_id", "chain", "block", "first_idx"), maps.select("job_id", "chain", "block", "m")


def align_jobs(
    residues: DataFrame,
    cutoff: float = DEFAULT_CUTOFF,
    partial: bool = True,
    table: Sequence[float] | None = None,
) -> dict[str, DataFrame]:
    """The whole pipeline for a residue table (job_id, chain, res_idx, letter, x, y, z)."""
    residues = cut_lineage(residues)
    return finish_alignments(multiple_alignment(residues, table), residues, cutoff, partial)

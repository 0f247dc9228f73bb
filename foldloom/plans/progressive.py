"""Progressive best-first multiple alignment of all jobs at once.

Every round picks the best merge of every job, replaces its two alignments by the merged one and
aligns that one with the remaining alignments.  Only the loop runs on the driver: the rounds equal
the largest number of chains in a job less one.  Members, columns, regions and prepared sides are
append-only: a round writes what it made, the small table of living alignments tells which rows
count, and a round none of whose alignments lives is deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.blocks import label_blocks
from foldloom.operators.chaining import UNREACHED
from foldloom.operators.fragments import chain_side, score_curve, sliding_fragments, with_shape
from foldloom.plans.pair import align_sides, build_columns, prepare_sides, sides_of, source_tracks, swapped
from foldloom.plans.search import find_regions
from foldloom.session import RoundTable, cut_lineage

GROUP_KEY = "concat_ws(':', job_id, aln1, aln2)"
COLUMN_NAMES = ["job_id", "aln_id", "slot", "chain", "block", "col", "res_idx", "x", "y", "z"]


def pair_regions(residues: DataFrame, table: Sequence[float] | None = None) -> tuple[DataFrame, Sequence[float]]:
    """First pass: the regions of every chain pair of a job that shares at least one match.

    Chains meet in their job.  Also returns the score table: the one given, or the one that the chains'
    own fragments yield.
    """
    labelled = cut_lineage(label_blocks(residues))
    frags = cut_lineage(with_shape(sliding_fragments(chain_side(labelled))))
    table = table or score_curve(frags)
    chains = labelled.select("job_id", "chain").distinct()
    pairs = chains.withColumnRenamed("chain", "aln1").join(chains.withColumnRenamed("chain", "aln2"), "job_id").where("aln1 > aln2")
    pairs = cut_lineage(pairs.withColumn("grp", F.expr(GROUP_KEY)))
    tracks = labelled.select(F.col("job_id").alias("grp"), F.col("chain").alias("side"), F.col("res_idx").alias("col"), *"xyz")
    named = pairs.select("grp", F.col("job_id").alias("pool"), F.col("aln1").alias("side1"), F.col("aln2").alias("side2"))
    return find_regions(frags, tracks, named, table, merge=F.concat_ws(":", "grp", "side1", "side2")).join(pairs, "grp"), table


def pair_scores(regions: DataFrame) -> DataFrame:
    """Score and size of every merge: the accumulated score of its last region."""
    return regions.groupBy("job_id", "grp", "aln1", "aln2").agg(
        F.max_by("total", "ord").alias("score"), F.sum("len").cast("int").alias("n_cols"),
        F.count(F.lit(1)).cast("int").alias("n_blocks"))


def multiple_alignment(residues: DataFrame, table: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """Tables ``alignments`` (job_id, aln_id, tree, score, n_chains, n_cols), ``members``, ``columns``.

    Jobs with fewer than two chains give no alignment.  A job whose chains share nothing still ends in
    one alignment with zero columns and the unreached score.
    """
    residues = cut_lineage(residues)
    tracks = cut_lineage(source_tracks(residues))
    chains = tracks.select("job_id", F.col("chain"))
    counted = chains.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("job_id"))).where("_n > 1")
    labelled = label_blocks(residues)
    alive = cut_lineage(counted.select(
        "job_id", F.col("chain").alias("aln_id"), F.col("chain").cast("string").alias("tree"),
        F.lit(None).cast("double").alias("score"), F.lit(1).alias("n_chains")))
    spark = residues.sparkSession
    members, columns, found, prepared = (RoundTable(spark) for _ in range(4))
    members.append(counted.select("job_id", F.col("chain").alias("aln_id"), F.lit(0).alias("slot"), "chain"), 0)
    columns.append(labelled.select(
        "job_id", F.col("chain").alias("aln_id"), F.lit(0).alias("slot"), "chain", "block",
        F.col("res_idx").alias("col"), "res_idx", *"xyz").select(COLUMN_NAMES), 0)

    regions, table = pair_regions(residues, table)
    found.append(regions.withColumn("rep1", F.lit(0)).withColumn("rep2", F.lit(0)), 0)
    scores = pair_scores(found.read())
    one_way = scores.select("job_id", F.col("aln1").alias("c1"), F.col("aln2").alias("c2"), "score")
    similarity = cut_lineage(one_way.unionByName(one_way.select("job_id", F.col("c2").alias("c1"), F.col("c1").alias("c2"), "score")))

    step = 0
    while not alive.groupBy("job_id").count().where("count > 1").isEmpty():
        step += 1
        best = cut_lineage(_best_merges(alive, _between(found.read(), alive)))
        new_id = F.lit(-step).cast("long")
        chosen = found.read().join(best.select("grp"), "grp", "left_semi")
        sides = sides_of(best)
        sided = sides.join(columns.read(), ["job_id", "aln_id"]).withColumn(
            "slot", swapped(F.col("slot"), F.col("rep"))).drop("aln_id", "rep")
        # Prepared sides of merges of earlier rounds; single chains need no preparation.
        if prepared.rounds:
            ready = prepared.read().join(best.select("grp"), "grp", "left_semi")
            sided = sided.join(ready.select("grp").distinct(), "grp", "left_anti").unionByName(ready)
        merged = build_columns(chosen, sided).withColumn("aln_id", new_id)

        size1 = best.join(alive.select("job_id", F.col("aln_id").alias("aln1"), F.col("n_chains").alias("_n1")), ["job_id", "aln1"])
        new_members = sides.join(members.read(), ["job_id", "aln_id"]).join(size1.select("grp", "_n1"), "grp").select(
            "job_id", new_id.alias("aln_id"),
            (swapped(F.col("slot"), F.col("rep")) + F.when(F.col("side") == 2, F.col("_n1")).otherwise(0)).alias("slot"),
            "chain")
        tree = sides.join(alive.drop("score"), ["job_id", "aln_id"]).groupBy("job_id", "grp").agg(
            F.array_sort(F.collect_list(F.struct("side", "tree"))).alias("t"), F.sum("n_chains").cast("int").alias("n_chains"))
        new_alive = tree.join(best.select("grp", "score"), "grp").select(
            "job_id", new_id.alias("aln_id"),
            F.concat(F.lit("["), F.concat_ws(",", F.col("t.tree")), F.lit("]")).alias("tree"), "score", "n_chains")
        columns.append(merged, step)
        members.append(new_members, step)
        alive = cut_lineage(alive.join(sides.select("job_id", "aln_id"), ["job_id", "aln_id"], "left_anti").unionByName(new_alive))
        # an alignment bears the number of its round, and so do the merges that it is side 2 of; at most one value a round comes back
        living = {max(-r.aln_id, 0) for r in alive.select(F.least("aln_id", F.lit(0)).alias("aln_id")).distinct().collect()}
        for kept in (members, columns, found, prepared):
            kept.keep(living)

        is_new = F.col("aln_id") == new_id
        partners = alive.where(~is_new).select("job_id", F.col("aln_id").alias("aln1")).join(
            alive.where(is_new).select("job_id", F.col("aln_id").alias("aln2")), "job_id")
        present = members.read().join(alive, ["job_id", "aln_id"], "left_semi")
        merges = partners.join(_representatives(present.where(~is_new), present.where(is_new), similarity), ["job_id", "aln1", "aln2"], "left").select(
            "job_id", F.expr(GROUP_KEY).alias("grp"), "aln1", F.coalesce("rep1", F.lit(0)).alias("rep1"),
            "aln2", F.coalesce("rep2", F.lit(0)).alias("rep2"))
        merges = cut_lineage(merges)
        if not merges.isEmpty():
            prepared.append(prepare_sides(merges, columns.read(), residues, tracks), step)
            fresh = prepared.read().join(merges.select("grp"), "grp", "left_semi")
            found.append(align_sides(fresh, table).join(merges, "grp"), step)
    members, columns = (kept.read().join(alive, ["job_id", "aln_id"], "left_semi") for kept in (members, columns))
    sizes = columns.groupBy("job_id", "aln_id").agg((F.max("col") + 1).alias("n_cols"))
    alignments = alive.join(sizes, ["job_id", "aln_id"], "left").withColumn("n_cols", F.coalesce("n_cols", F.lit(0)))
    return {"alignments": alignments, "members": members, "columns": columns}


def _between(regions: DataFrame, alive: DataFrame) -> DataFrame:
    """Regions of merges both of whose alignments live."""
    for side in ("aln1", "aln2"):
        regions = regions.join(alive.select("job_id", F.col("aln_id").alias(side)), ["job_id", side], "left_semi")
    return regions


def _best_merges(alive: DataFrame, regions: DataFrame) -> DataFrame:
    """Best-scoring merge of every unfinished job (job_id, grp, aln1, rep1, aln2, rep2, score).

    Jobs without any scored merge combine their two lowest alignments without columns.
    """
    open_jobs = alive.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("aln_id").alias("_a"), F.array_sort(F.collect_list("aln_id")).alias("_ids")
    ).where("_n > 1")
    scored = regions.groupBy("job_id", "grp", "aln1", "rep1", "aln2", "rep2").agg(F.max_by("total", "ord").alias("score"))
    best = scored.groupBy("job_id").agg(F.max_by(
        F.struct("grp", "aln1", "rep1", "aln2", "rep2", "score"),
        F.struct(F.col("score"), -F.abs("aln1"), -F.abs("aln2"))).alias("b"))
    first, second = F.get("_ids", F.lit(1)), F.get("_ids", F.lit(0))
    blank = F.struct(
        F.concat_ws(":", "job_id", first, second).alias("grp"), first.alias("aln1"), F.lit(0).alias("rep1"),
        second.alias("aln2"), F.lit(0).alias("rep2"), F.lit(UNREACHED).alias("score"))
    return open_jobs.join(best, "job_id", "left").select("job_id", F.coalesce("b", blank).alias("b")).select("job_id", "b.*")


def _representatives(old: DataFrame, new: DataFrame, similarity: DataFrame) -> DataFrame:
    """Slots of the best-scoring chain pair between each old alignment and the new one of its job."""
    a = old.select("job_id", F.col("aln_id").alias("aln1"), F.col("slot").alias("rep1"), F.col("chain").alias("c1"))
    b = new.select("job_id", F.col("aln_id").alias("aln2"), F.col("slot").alias("rep2"), F.col("chain").alias("c2"))
    scored = similarity.where(F.col("score") > 0).join(a, ["job_id", "c1"]).join(b, ["job_id", "c2"])
    return scored.groupBy("job_id", "aln1", "aln2").agg(F.max_by(
        F.struct("rep1", "rep2"), F.struct(F.col("score"), -F.col("rep1"), -F.col("rep2"))).alias("r")
    ).select("job_id", "aln1", "aln2", "r.rep1", "r.rep2")

"""Runs of consecutive columns (blocks), the gaps between them, and block lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def present(residues: DataFrame) -> DataFrame:
    """Residues that have coordinates."""
    return residues.where(F.col("x").isNotNull())


def label_blocks(residues: DataFrame) -> DataFrame:
    """Number the runs of consecutive present residues of every chain (gaps and islands)."""
    by_chain = Window.partitionBy("job_id", "chain").orderBy("res_idx")
    numbered = present(residues).withColumn("_island", F.col("res_idx") - F.row_number().over(by_chain))
    return numbered.withColumn("block", (F.dense_rank().over(
        Window.partitionBy("job_id", "chain").orderBy("_island")) - 1).cast("int")).drop("_island")


def block_table(labelled: DataFrame) -> DataFrame:
    """First and last residue of every block."""
    return labelled.groupBy("job_id", "chain", "block").agg(
        F.min("res_idx").alias("first_idx"), F.max("res_idx").alias("last_idx"),
    )


def block_gaps(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Unaligned residue ranges: before, between and after the blocks of every chain.

    ``lengths`` has one row per (job_id, chain) with the chain length.  Empty gaps are kept (their
    ``gap_last`` is below ``gap_first``) so that gap numbers agree between chains.
    """
    order = Window.partitionBy("job_id", "chain").orderBy("block")
    before = blocks.select(
        "job_id", "chain", F.col("block").alias("gap"),
        (F.coalesce(F.lag("last_idx").over(order), F.lit(-1)) + 1).alias("gap_first"),
        (F.col("first_idx") - 1).alias("gap_last"),
    )
    tail = blocks.groupBy("job_id", "chain").agg(
        (F.max("block") + 1).alias("gap"), (F.max("last_idx") + 1).alias("gap_first")
    ).join(lengths, ["job_id", "chain"]).select(
        "job_id", "chain", "gap", "gap_first", (F.col("length") - 1).alias("gap_last"))
    return before.unionByName(tail)


def residue_to_block(residues: DataFrame, blocks: DataFrame) -> DataFrame:
    """For every residue (present or not) the block whose transform moves it.

    That is the last block starting at or before the residue; residues ahead of the first block
    follow block 0.  One ordered pass per chain instead of a range join.
    """
    starts = blocks.select("job_id", "chain", F.col("first_idx").alias("res_idx"), F.col("block").alias("_b"))
    order = Window.partitionBy("job_id", "chain").orderBy("res_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        residues.join(starts, ["job_id", "chain", "res_idx"], "left")
        .withColumn("move_block", F.coalesce(F.last("_b", ignorenulls=True).over(order), F.lit(0)))
        .drop("_b")
    )

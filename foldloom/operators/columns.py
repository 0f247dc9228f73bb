"""Aggregates over alignment columns (job_id, aln_id, slot, chain, block, col, res_idx, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMN = ["job_id", "aln_id", "col"]
ALIGNMENT = ["job_id", "aln_id"]


def core_columns(columns: DataFrame, members: DataFrame) -> DataFrame:
    """Columns in which every chain of the alignment is present."""
    width = members.groupBy(*ALIGNMENT).agg(F.count(F.lit(1)).alias("n_chains"))
    filled = columns.groupBy(*COLUMN).agg(F.count("res_idx").alias("n_present"))
    return filled.join(width, ALIGNMENT).where("n_present = n_chains").select(*COLUMN, "n_chains")


def core_counts(columns: DataFrame, members: DataFrame) -> DataFrame:
    return core_columns(columns, members).groupBy(*ALIGNMENT).agg(F.count(F.lit(1)).alias("core"))


def column_rmsd(columns: DataFrame) -> DataFrame:
    """Square root of the mean over columns of the mean squared distance over present pairs.

    Over n points the squared pair distances sum to n times the squared deviations from the mean, so
    the mean over pairs is 2 n / (n - 1) times the summed variance: no pair is ever built.
    """
    n = F.count("x")
    spread = F.var_pop("x") + F.var_pop("y") + F.var_pop("z")
    per_column = columns.groupBy(*COLUMN).agg(
        F.when(n > 1, F.try_divide(2.0 * n * spread, n - 1)).alias("d2"))
    return per_column.groupBy(*ALIGNMENT).agg(
        F.sqrt(F.avg("d2")).alias("rmsd"), F.count("d2").alias("n_cols"))


def weighted_means(columns: DataFrame) -> DataFrame:
    """Weighted mean position of every column (``weight`` on the rows)."""
    w = F.when(F.col("x").isNotNull(), F.col("weight"))
    return columns.groupBy(*COLUMN).agg(
        *(F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in "xyz"))


def uniform_weights(members: DataFrame, exclude_slot: int | None = None) -> DataFrame:
    """Weight 1/n for every chain, or 1/(n-1) with 0 for the excluded slot."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*ALIGNMENT))
    if exclude_slot is None:
        return members.withColumn("weight", 1.0 / n)
    return members.withColumn(
        "weight", F.when(F.col("slot") == exclude_slot, 0.0).otherwise(F.try_divide(F.lit(1.0), n - 1)))


def leave_one_out_means(columns: DataFrame) -> DataFrame:
    """For every cell the mean position of the other chains of its column.

    Written as (column sum - own value) / (n - 1): one window over the column, no self-join.
    """
    over = Window.partitionBy(*COLUMN)
    n = F.count("x").over(over)
    return columns.select(*COLUMN, "slot", *(
        F.try_divide(F.sum(c).over(over) - F.col(c), (n - 1).cast("double")).alias(f"other_{c}") for c in "xyz"))


def conflict_pairs(columns: DataFrame, keys: list[str] = ALIGNMENT) -> DataFrame:
    """Column pairs (earlier, later) of each of ``keys`` where some chain would not advance.

    Within one chain residue numbers rise with the column except where extended blocks overlap, so an
    earlier column conflicts only if the running maximum of the residue number reaches the later one;
    only such columns enter the join, which keeps it proportional to the overlaps.
    """
    chain = Window.partitionBy(*keys, "slot").orderBy("col")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    after = chain.rowsBetween(1, Window.unboundedFollowing)
    marked = columns.select(
        *keys, "col", "slot", "res_idx",
        F.max("res_idx").over(before).alias("_high"), F.min("res_idx").over(after).alias("_low"))
    later = marked.where("_high >= res_idx").select(
        *keys, "slot", F.col("col").alias("later"), F.col("res_idx").alias("_later_idx"))
    earlier = marked.where("_low <= res_idx").select(
        *keys, "slot", F.col("col").alias("earlier"), F.col("res_idx").alias("_earlier_idx"))
    return earlier.join(later, [*keys, "slot"]).where(
        "earlier < later AND _earlier_idx >= _later_idx").select(*keys, "earlier", "later").distinct()


def reorder(columns: DataFrame, order: DataFrame) -> DataFrame:
    """Renumber slots by an order table (job_id, aln_id, chain, slot)."""
    return columns.drop("slot").join(order.select(*ALIGNMENT, "chain", "slot"), [*ALIGNMENT, "chain"])


def input_order(members: DataFrame) -> DataFrame:
    """Slots in the order in which the chains were given, whatever the merge order was."""
    order = Window.partitionBy(*ALIGNMENT).orderBy("chain")
    return members.select(*ALIGNMENT, "chain", (F.row_number().over(order) - 1).alias("slot"))


def bounding_box(columns: DataFrame) -> DataFrame:
    return columns.groupBy(*ALIGNMENT).agg(
        *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))

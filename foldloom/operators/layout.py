"""Linear layout of alignments: gapped sequences, column compaction, running residue numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.grouped import Group, map_groups, ordered

KEYS = ["job_id", "aln_id"]
PLACES = "job_id long, aln_id long, pos int, to int"


def sequence_columns(columns: DataFrame, members: DataFrame, residues: DataFrame) -> DataFrame:
    """Every residue of every chain with its column in the linear alignment.

    Unaligned residues come chain by chain ahead of the block they precede, each in a column of its
    own.  ``members``: job_id, aln_id, slot, chain.  Result: keys, slot, chain, res_idx, letter, pos.
    """
    everything = members.join(residues.select("job_id", "chain", "res_idx", "letter"), ["job_id", "chain"])
    placed = columns.select(*KEYS, "chain", "res_idx", "block", "col")
    joined = everything.join(placed, [*KEYS, "chain", "res_idx"], "left")
    ahead = Window.partitionBy(*KEYS, "chain").orderBy("res_idx").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*KEYS).orderBy("_block", "_phase", "_major", "_minor")
    aligned = F.col("col").isNotNull()
    return joined.select(
        *KEYS, "slot", "chain", "res_idx", "letter",
        F.coalesce(F.first("block", ignorenulls=True).over(ahead), F.lit(2**31 - 1)).alias("_block"),
        aligned.cast("int").alias("_phase"),
        F.when(aligned, F.col("col")).otherwise(F.col("slot")).alias("_major"),
        F.when(aligned, F.lit(0)).otherwise(F.col("res_idx")).alias("_minor"),
    ).withColumn("pos", F.dense_rank().over(whole) - 1).select(*KEYS, "slot", "chain", "res_idx", "letter", "pos")


def gapped_rows(placed: DataFrame) -> DataFrame:
    """One gapped string per chain; dashes are computed from the distance to the previous letter."""
    chain = Window.partitionBy(*KEYS, "slot").orderBy("pos")
    dashes = F.col("pos") - F.coalesce(F.lag("pos").over(chain), F.lit(-1)) - 1
    pieces = placed.withColumn("_d", dashes.cast("int")).withColumn(
        "piece", F.concat(F.expr("repeat('-', _d)"), F.col("letter")))
    width = placed.groupBy(*KEYS).agg((F.max("pos") + 1).cast("int").alias("_width"))
    strings = pieces.groupBy(*KEYS, "slot", "chain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda e: e.piece), "").alias("_s"))
    return strings.join(width, KEYS).select(*KEYS, "slot", "chain", F.rpad("_s", F.col("_width"), F.lit("-")).alias("row"))


def _pack(key: tuple, stretch: Group) -> list[tuple]:
    """New places of the columns of one stretch: each goes left past higher columns that share no chain with it."""
    stretch = ordered(stretch, "pos")
    order: list[tuple[int, frozenset, int]] = []
    for pos, slots in zip(stretch["pos"].tolist(), stretch["held"], strict=True):
        held = slots.tolist()
        first, own = min(held), frozenset(held)
        at = len(order)
        while at and first < order[at - 1][0] and own.isdisjoint(order[at - 1][1]):
            at -= 1
        order.insert(at, (first, own, pos))
    start = int(stretch["pos"][0])
    return [(*key[:2], pos, start + k) for k, (*_, pos) in enumerate(order)]


def compact_columns(placed: DataFrame) -> DataFrame:
    """Move gap columns left past columns they do not share a chain with, lower chains first.

    ``placed`` as of sequence_columns; only ``pos`` changes.  A column that holds every chain of the
    alignment can neither move nor be passed, so the columns between two such are a stretch of their
    own: a group is one stretch with more than one column, never an alignment, and holds no letters.
    """
    chains = placed.groupBy(*KEYS).agg(F.count_distinct("slot").alias("chains"))
    held = placed.groupBy(*KEYS, "pos").agg(F.collect_list("slot").alias("held")).join(chains, KEYS)
    full = F.size("held") == F.col("chains")
    before = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("stretch", F.count_if(full).over(before)).where(~full)
    moved = map_groups(held.drop("chains"), [*KEYS, "stretch"], _pack, PLACES, least=2).where("pos <> to")
    moved = moved.select(*[F.col(k).alias(f"m_{k}") for k in KEYS], F.col("pos").alias("m_pos"), "to")
    same = [F.col(k) == F.col(f"m_{k}") for k in [*KEYS, "pos"]]
    others = [c for c in placed.columns if c != "pos"]
    return placed.join(moved, same, "left").select(*others, F.coalesce("to", "pos").alias("pos"))


def sequence_alignment(columns: DataFrame, members: DataFrame, residues: DataFrame) -> DataFrame:
    """Gapped rows in output order."""
    return gapped_rows(compact_columns(sequence_columns(columns, members, residues))).select(
        F.col("job_id"), F.col("aln_id"), F.col("slot").cast("int"), "chain", "row")


def wrapped(rows: DataFrame, size: int, text: str = "row") -> DataFrame:
    """Cut strings into lines of ``size`` characters: adds ``line_no`` and ``part``."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1))
    return rows.withColumn("line_no", F.explode(starts)).withColumn(
        "part", F.expr(f"substring({text}, line_no * {size} + 1, {size})"))


def last_residue_number(rows: DataFrame, size: int) -> DataFrame:
    """``wrapped`` plus the number of letters printed up to the end of each line."""
    lines = wrapped(rows, size)
    return lines.withColumn("n_letters", F.length(F.regexp_replace(F.expr(f"left(row, (line_no + 1) * {size})"), "-", "")))

"""Radius join: pairs of points within a distance, by grid cells instead of a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import geometry as g

HOT_CELL = 20_000


def radius_join(
    left: DataFrame, right: DataFrame, radius: float, group: list[str], hot_cell: int | None = HOT_CELL, small: str | None = None
) -> DataFrame:
    """Rows of ``left`` and ``right`` of equal ``group`` whose (x, y, z) are at most ``radius`` apart.

    Every point falls in a cube of side ``radius``; the right side is copied into the 27 cubes around
    it and joined by equality.  Cubes holding more than ``hot_cell`` left points are split over salts
    (counts are aggregated first), so a crowded spot does not end in one task; None leaves that out where
    a group is bounded.  ``small`` names a column of both sides that is true in groups of few points: those lie in
    one cube and none is copied.  Result columns are the group, ``a_*``, ``b_*`` and ``distance``.
    """
    alone = F.lit(False) if small is None else F.col(small)
    cells = [F.when(~alone, F.floor(F.col(c) / radius)).otherwise(0).cast("long").alias(f"_{c}") for c in "xyz"]
    keys = [*group, "_x", "_y", "_z"]
    one = left.select("*", *cells)
    steps = F.when(alone, F.array(F.lit(0))).otherwise(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    two = right.select("*", *cells)
    for c in "xyz":
        two = two.withColumn("_step", F.explode(steps)).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_step"))
    two = two.drop("_step")
    if small is not None:
        one, two = one.drop(small), two.drop(small)
    if hot_cell is not None:
        hot = (
            one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_cell)
            .select(*keys, F.ceil(F.col("_n") / hot_cell).cast("int").alias("_salts"))
        )
        salts = F.coalesce(F.col("_salts"), F.lit(1))
        one = one.join(hot, keys, "left").withColumn(
            "_salt", F.pmod(F.xxhash64("x", "y", "z", *left.columns[:1]), salts).cast("int")).drop("_salts")
        two = two.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        keys = [*keys, "_salt"]
    a = one.select(*keys, *(F.col(c).alias(f"a_{c}") for c in left.columns if c not in (*group, small)))
    b = two.select(*keys, *(F.col(c).alias(f"b_{c}") for c in right.columns if c not in (*group, small)))
    gap = g.distance(g.vec("a_x", "a_y", "a_z"), g.vec("b_x", "b_y", "b_z"))
    return a.join(b, keys).withColumn("distance", gap).where(F.col("distance") <= radius).drop(
        "_x", "_y", "_z", "_salt")

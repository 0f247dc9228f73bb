"""Staged search for matching regions: strong fragments first, weaker ones only in the gaps they leave.

Three passes with falling score limits.  The first lets all fragments of a pool and length meet; in large
pools it finds them by an equi-join on cells over all three principal extents, with narrow rows, and only
pairs that survive fetch their coordinates.  Its matches are chained.  The later passes look only into the gaps that the first one leaves: fragments
are joined on (merge, gap, length), and what they match is chained between the regions that bound the
gap, first under the second pass's limits, then, in the gaps still open, under the third's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.scoring import MIN_FRAGMENT, SEARCH_PASSES, fragment_score
from foldloom.functions.superpose import with_map
from foldloom.operators import fragments
from foldloom.operators.chaining import CANDIDATE, LOWER, UPPER, chain_matches, hinge_edges, match_id
from foldloom.operators.fragments import direct_pairs, limit_of, near_shapes, sealed, shape_pairs, small_and_large, split_crowded, superpose
from foldloom.session import cut_lineage, spread

#: Behind every column of a chain.
FAR = 1 << 30
MATCH = ["grp", "gap", "id", "p1", "p2", "len", "score", "m"]
REGION = ["grp", "ord", "p1", "p2", "len", "score", "m", "total"]


def strong_matches(frags: DataFrame, merge: Column | None, min_score: float, table: Sequence[float]) -> DataFrame:
    """Matches of at least ``min_score`` over whole sides, with maps."""
    left, right = (frags, frags) if merge is not None else (frags.where("side = 2"), frags.where("side = 1"))
    small, large = small_and_large(left, right, fragments.CROWD)
    pairs = direct_pairs(*small, min_score, table, F.col("a_side") > F.col("b_side"))
    if large is not None:
        narrow = cut_lineage(shape_pairs(*large, min_score, table))
        keys = ["grp", "side", "pos", "len"]

        def fetched(pairs: DataFrame, end: str, side: DataFrame) -> DataFrame:
            wide = side.select(*(F.col(c).alias(c if c in ("grp", "len") else f"{end}_{c}") for c in side.columns))
            return pairs.join(wide, [c if c in ("grp", "len") else f"{end}_{c}" for c in keys])

        pairs = pairs.unionByName(fetched(fetched(narrow, "a", large[0]), "b", large[1]).select(pairs.columns))
    if merge is None:  # the pair's larger side came first; side 1 leads here
        turned = {c: f"{'ba'['ab'.index(c[0])]}{c[1:]}" if c[:2] in ("a_", "b_") else c for c in pairs.columns}
        pairs = pairs.select(*(F.col(c).alias(n) for c, n in turned.items()))
    scored = superpose(pairs).withColumn("score", fragment_score("rmsd", F.col("len"), table))
    found = with_map(sealed(scored).where(F.col("score") >= min_score))
    return found.select((F.col("grp") if merge is None else merge).alias("grp"), F.lit(0).alias("gap"), match_id().alias("id"), "p1", "p2", "len", "score", "m")


def open_gaps(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gaps before, between and after the regions of every merge, a whole merge where it has none.

    Result: the columns of ``pairs``, gap, and for each side the first column open and the one behind
    the last (``low1`` to ``high2``).
    """
    order = Window.partitionBy("grp").orderBy("ord")
    ahead = regions.select(
        "grp", F.col("ord").alias("gap"), *(F.coalesce(F.lag(F.expr(f"p{s} + len")).over(order), F.lit(0)).alias(f"low{s}") for s in (1, 2)),
        *(F.col(f"p{s}").alias(f"high{s}") for s in (1, 2)))
    last = regions.groupBy("grp").agg(F.max_by(F.struct("ord", *(F.expr(f"p{s} + len").alias(f"low{s}") for s in (1, 2))), "ord").alias("r"))
    tail = pairs.select("grp").join(last, "grp", "left").select(
        "grp", F.coalesce(F.col("r.ord") + 1, F.lit(0)).alias("gap"), *(F.coalesce(f"r.low{s}", F.lit(0)).alias(f"low{s}") for s in (1, 2)),
        *(F.lit(FAR).alias(f"high{s}") for s in (1, 2)))
    return ahead.unionByName(tail).join(pairs, "grp")


def gap_matches(frags: DataFrame, gaps: DataFrame, min_score: float, table: Sequence[float]) -> DataFrame:
    """Matches of at least ``min_score`` that lie inside an open gap, with maps."""
    lengths = frags.groupBy("grp", "side").agg((F.max(F.col("pos") + F.col("len"))).alias("end"))

    def side(s: int) -> DataFrame:
        """Fragments of one side in its gaps: a gap lists its columns, each fetches the fragments that start there."""
        ends = lengths.select(F.col("grp").alias("pool"), F.col("side").alias(f"side{s}"), "end")
        mine = gaps.join(ends, ["pool", f"side{s}"]).withColumn("high", F.least(F.col(f"high{s}"), F.col("end")))
        mine = mine.where(F.col(f"low{s}") + MIN_FRAGMENT <= F.col("high")).select(
            "grp", "gap", "pool", F.col(f"side{s}").alias("side"), "high", F.explode(F.sequence(F.col(f"low{s}"), F.col("high") - MIN_FRAGMENT)).alias("pos"))
        own = frags.withColumnRenamed("grp", "pool")
        return mine.join(own, ["pool", "side", "pos"]).where("pos + len <= high").drop("pool", "high")

    keys = ["grp", "gap", "len"]
    one, two, extra = split_crowded(side(1), side(2), keys)
    keys = [*keys, *extra]
    a = one.select(*(F.col(c).alias(c if c in keys else f"a_{c}") for c in one.columns))
    b = two.select(*(F.col(c).alias(c if c in keys else f"b_{c}") for c in two.columns))
    radius = limit_of(min_score, table)
    pairs = spread(a, keys).join(spread(b, keys), keys).where(near_shapes(radius * radius))
    scored = superpose(pairs, extra=["gap"]).withColumn("score", fragment_score("rmsd", F.col("len"), table))
    found = with_map(sealed(scored).where(F.col("score") >= min_score))
    return found.select("grp", "gap", match_id().alias("id"), "p1", "p2", "len", "score", "m")


def bounds(regions: DataFrame) -> DataFrame:
    """Every region as the upper bound of the gap before it and the lower bound of the gap behind it."""
    both = F.array(
        F.struct(F.col("ord").alias("gap"), F.lit(UPPER).alias("kind")), F.struct((F.col("ord") + 1).alias("gap"), F.lit(LOWER).alias("kind")))
    return regions.select("*", F.inline(both)).select(*[c for c in MATCH if c != "id"], match_id().alias("id"), "kind")


def find_regions(
    frags: DataFrame, tracks: DataFrame, pairs: DataFrame, table: Sequence[float], merge: Column | None = None,
    conflicts: DataFrame | None = None, passes: Sequence[tuple[float, float, float]] = SEARCH_PASSES,
) -> DataFrame:
    """Accepted regions (grp, ord, p1, p2, len, score, m, total) of every merge.

    ``frags``: fragments with shapes; their ``grp`` is the pool in which sides meet.  ``tracks``: grp
    (pool), side, col, x, y, z.  ``pairs``: grp, pool, side1, side2 of every merge.  A pool is a merge of sides
    1 and 2, or, if ``merge`` names the merge of (grp, side1, side2), holds many sides that all meet.
    """
    second = pairs.join(tracks.select(F.col("grp").alias("pool"), F.col("side").alias("side2"), "col", *"xyz"), ["pool", "side2"]).select("grp", "col", *"xyz")

    def chained(nodes: DataFrame, limits: Sequence[tuple[float, float, float]]) -> DataFrame:
        angle, displacement = (max(p[k] for p in limits) for k in (1, 2))
        edges = hinge_edges(nodes, second, angle, displacement, ("grp", "gap"), conflicts)
        found = chain_matches(nodes.select("grp", "id", "score", "kind"), edges, limits)
        # a region may bound two gaps: one row of each match
        known = nodes.where(F.col("kind") != LOWER).select("grp", "id", "p1", "p2", "len", "score", "m")
        return cut_lineage(found.join(known, ["grp", "id"]).select(*REGION))

    strong, weaker = passes[0], passes[1:]
    matches = cut_lineage(strong_matches(frags, merge, strong[0], table))
    regions = chained(matches.withColumns({"kind": F.lit(CANDIDATE), "from2": F.lit(0)}), [strong])
    if weaker:
        gaps = cut_lineage(open_gaps(regions, pairs))
        matches = cut_lineage(gap_matches(frags, gaps, min(p[0] for p in weaker), table))
        # bounds of gaps without candidates matter too: they carry the sum onwards
        nodes = matches.withColumn("kind", F.lit(CANDIDATE)).unionByName(bounds(regions))
        regions = chained(nodes.join(gaps.select("grp", "gap", (F.col("low2") - 1).alias("from2")), ["grp", "gap"]), weaker)
    return regions

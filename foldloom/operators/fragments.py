"""Sliding fragments and the fragment-by-fragment superposition join.

Fragment pairs are found by an equi-join on (group, length), in large groups on (group, length, shape cell).
The shape of a fragment is the vector of singular values of its centred coordinates divided by the
square root of its length.  Two fragments whose optimal superposition has RMSD r have shapes at most
r apart (von Neumann's trace inequality), so bucketing the largest value by the acceptance radius and
looking one bucket to either side loses nothing.  Covariance, closed-form RMSD and score are plain
arithmetic over fixed, zero-padded columns: one generated-code stage after the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.functions.scoring import MAX_FRAGMENT, MIN_FRAGMENT, TABLE_SIZE, curve_from_counts, fragment_score, rmsd_limit
from foldloom.session import cut_lineage, spread

AXES = "xyz"
HOT_CELL = 20_000
#: Fragments this many positions apart in a chain stand for unrelated ones.
CURVE_LAG = 10
SHAPE_SLACK = 1e-6
COVARIANCE = [f"c{j}{k}" for j in range(3) for k in range(3)]


def chain_side(labelled: DataFrame) -> DataFrame:
    """Single chains as point tracks: one point per residue and no spread inside a column."""
    return labelled.select(
        F.col("job_id").alias("grp"), F.col("chain").alias("side"),
        F.col("res_idx").alias("col"), "block", "x", "y", "z", F.lit(0.0).alias("spread"),
    )


def sliding_fragments(
    points: DataFrame, lengths: Sequence[int] = tuple(range(MIN_FRAGMENT, MAX_FRAGMENT + 1))
) -> DataFrame:
    """All windows of the given lengths that lie inside one block.

    ``points``: grp, side, col, block, x, y, z, spread.  Adds centroid (mx, my, mz), the squared size
    ``extent`` around it and the centred coordinates x0..x8, y0..y8, z0..z8 padded with zeros.
    """
    # Long sums are written as SQL text: one parse instead of hundreds of calls per expression.
    width = max(lengths)
    order = Window.partitionBy("grp", "side", "block").orderBy("col")
    ahead = [
        F.lead(name, k).over(order).alias(f"_{name}{k}")
        for name in (*AXES, "spread") for k in range(width)
    ]
    wide = points.select("grp", "side", "block", F.col("col").alias("pos"), *ahead)
    sized = wide.withColumn("len", F.explode(F.lit(list(lengths)))).where(
        F.expr("CASE len " + " ".join(f"WHEN {n} THEN _x{n - 1} IS NOT NULL" for n in lengths) + " END")
    )

    def inside(k: int, value: str) -> str:
        return value if k < min(lengths) else f"CASE WHEN len > {k} THEN {value} ELSE 0D END"

    def every(name: str) -> list[str]:
        return [inside(k, f"_{name}{k}") for k in range(width)]

    centred = sized.select(
        "*",
        *(F.expr(f"({' + '.join(every(a))}) / len").alias(f"m{a}") for a in AXES),
        own_method_sum(*(F.expr(t) for t in every("spread"))).alias("spread"),
    ).select(
        "grp", "side", "block", "pos", "len", "spread", *(f"m{a}" for a in AXES),
        *(
            F.expr(f"coalesce({inside(k, f'_{a}{k} - m{a}')}, 0D)").alias(f"{a}{k}")
            for a in AXES for k in range(width)
        ),
    )
    squares = " + ".join(f"{a}{k} * {a}{k}" for a in AXES for k in range(width))
    return centred.withColumn("extent", F.expr(f"{squares} + spread"))


def sealed(df: DataFrame) -> DataFrame:
    """Keep later filters above the projection of ``df``.

    Catalyst inlines projected expressions into the filters it pushes down.  For layered formulas,
    where each layer uses the previous one several times, that grows exponentially; a filter is never
    pushed through a projection with a non-deterministic column, and the partition id is a free one.
    """
    return df.withColumn("_seal", F.spark_partition_id()).where(F.col("_seal") >= 0).drop("_seal")


def own_method_sum(*terms: Column) -> Column:
    """Sum of ``terms``, written so that its projection is compiled on its own.

    A projection of a few hundred operations fused into one generated method is too long for the
    JIT compiler and runs interpreted, several times slower.  A lambda function keeps the projection
    out of the fused stage; Spark then compiles it as many short methods.
    """
    return F.aggregate(F.array(*terms), F.lit(0.0), lambda acc, v: acc + v)


def _width(fragments: DataFrame) -> int:
    return sum(1 for c in fragments.columns if c.startswith("x") and c[1:].isdigit())


def with_shape(fragments: DataFrame) -> DataFrame:
    """Add the shape u1 >= u2 >= u3: root mean square extents along the principal axes."""
    width = _width(fragments)

    def moment(a: str, b: str) -> Column:
        return F.expr(" + ".join(f"{a}{k} * {b}{k}" for k in range(width)))

    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    kept = fragments.columns
    layered = fragments.select("*", *(moment(n[0], n[1]).alias(f"_{n}") for n in names))
    parts = [F.col(f"_{n}") for n in names]
    base = g.symmetric_eigenvalues(*parts)
    layered = layered.select("*", base["mean"].alias("_mean"), base["spread"].alias("_spread"))
    layered = layered.withColumn("_angle", g.eigen_angle(F.col("_mean"), F.col("_spread"), *parts))
    layered = layered.select(
        "*",
        g.eigen_top(F.col("_mean"), F.col("_spread"), F.col("_angle")).alias("_l1"),
        g.eigen_second(F.col("_mean"), F.col("_spread"), F.col("_angle")).alias("_l2"),
    )
    third = 3.0 * F.col("_mean") - F.col("_l1") - F.col("_l2")
    return sealed(layered.select(
        *kept,
        *(
            F.sqrt(F.greatest(v, F.lit(0.0)) / F.col("len")).alias(n)
            for n, v in (("u1", F.col("_l1")), ("u2", F.col("_l2")), ("u3", third))
        ),
    ))


def _salted(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split the rows of crowded cells of ``left`` over salts and copy the matching ``right`` rows.

    The number of salts follows from pre-aggregated counts, so ordinary cells are left alone.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_CELL)
    hot = counts.select(*keys, F.ceil(F.col("_n") / HOT_CELL).cast("int").alias("_salts"))
    one = F.coalesce(F.col("_salts"), F.lit(1))
    split = left.join(hot, keys, "left").withColumn(
        "salt", F.pmod(F.xxhash64("side", "pos", "len"), one).cast("int")).drop("_salts")
    copied = right.join(hot, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return split, copied


def limit_of(min_score: float, table: Sequence[float]) -> Column:
    """Largest RMSD, by ``len``, that reaches ``min_score`` (with slack for rounding)."""
    limits = {n: rmsd_limit(n, max(min_score, 1e-9), table) for n in range(MIN_FRAGMENT, MAX_FRAGMENT + 1)}
    return F.expr("CASE len " + " ".join(f"WHEN {n} THEN {v + SHAPE_SLACK!r}D" for n, v in limits.items()) + " END")


def near_shapes(squared: Column) -> Column:
    """Whether the shapes a_u1.. and b_u1.. are at most the root of ``squared`` apart."""
    def gap(i: int) -> Column:
        return (F.col(f"a_u{i}") - F.col(f"b_u{i}")) * (F.col(f"a_u{i}") - F.col(f"b_u{i}"))

    return gap(1) + gap(2) + gap(3) <= squared


#: Rows of one side of a join key that stay together.
CROWD = 4_000


def split_crowded(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split keys that are crowded on either side over a grid of salts; returns the salt columns too.

    Rows of a crowded key are dealt over the salts of their own side and copied over those of the other,
    so that each pair meets once.  The crowded keys are counted first; without any nothing is added.
    """
    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    hot = counted(left, "_n1").join(counted(right, "_n2"), keys).where(F.greatest("_n1", "_n2") > CROWD)
    hot = cut_lineage(hot.select(*keys, *(F.ceil(F.col(f"_n{s}") / CROWD).cast("int").alias(f"_salts{s}") for s in (1, 2))))
    if hot.isEmpty():
        return left, right, []
    out = []
    for side, own, other in ((left, 1, 2), (right, 2, 1)):
        salts = {s: F.coalesce(F.col(f"_salts{s}"), F.lit(1)) for s in (1, 2)}
        rows = side.join(hot, keys, "left")
        rows = rows.withColumn(f"salt{own}", F.pmod(F.xxhash64("side", "pos", "len"), salts[own]).cast("int"))
        out.append(rows.withColumn(f"salt{other}", F.explode(F.sequence(F.lit(0), salts[other] - 1))).drop("_salts1", "_salts2"))
    return out[0], out[1], ["salt1", "salt2"]


def small_and_large(left: DataFrame, right: DataFrame, limit: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Both sides restricted to the (grp, len) of at most ``limit`` rows on either side, and to the others (None without any)."""
    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("grp", "len").agg(F.count(F.lit(1)).alias(name))

    large = counted(left, "_n1").join(counted(right, "_n2"), ["grp", "len"]).where(F.greatest("_n1", "_n2") > limit).select("grp", "len")
    if large.isEmpty():
        return (left, right), None
    large = cut_lineage(large)
    small, rest = (tuple(side.join(large, ["grp", "len"], how) for side in (left, right)) for how in ("left_anti", "left_semi"))
    return small, rest


def direct_pairs(left: DataFrame, right: DataFrame, min_score: float, table: Sequence[float], pair: Column) -> DataFrame:
    """Fragment pairs of equal group and length, ``pair`` true, whose shapes allow ``min_score``, whole rows a_* and b_*.

    All rows of a (grp, len) meet and none is copied: for groups that :func:`small_and_large` calls small.
    """
    keys = ["grp", "len"]

    def dealt(frags: DataFrame) -> DataFrame:
        # File sources make every column nullable; these never are, and saying so halves the code.
        return spread(frags.withColumns({n: F.coalesce(n, F.lit(0.0)) for n, kind in frags.dtypes if kind == "double"}), keys)

    one = dealt(left)
    two = one if right is left else dealt(right)
    a, b = (side.select(*(F.col(c).alias(c if c in keys else f"{x}_{c}") for c in side.columns)) for side, x in ((one, "a"), (two, "b")))
    radius = limit_of(min_score, table)
    return a.join(b, keys).where(pair).where(near_shapes(radius * radius))


def shape_pairs(left: DataFrame, right: DataFrame, min_score: float, table: Sequence[float]) -> DataFrame:
    """Pairs (grp, len, a_side, a_pos, b_side, b_pos), a_side > b_side, of fragments whose shapes allow ``min_score``.

    An equi-join on cells over all three extents, with rows that hold nothing but the shape.
    """
    shapes = [f"u{i}" for i in (1, 2, 3)]

    def celled(frags: DataFrame) -> DataFrame:
        narrow = frags.select("grp", "len", "side", "pos", *shapes, limit_of(min_score, table).alias("radius"))
        return narrow.withColumns({f"cell{i}": F.floor(F.col(f"u{i}") / F.col("radius")).cast("int") for i in (1, 2, 3)})

    narrow, copies = celled(left), celled(right)
    for i in (1, 2, 3):
        copies = copies.withColumn(f"cell{i}", F.explode(F.array(*(F.col(f"cell{i}") + d for d in (-1, 0, 1)))))
    one, two, extra = split_crowded(narrow, copies, ["grp", "len", "cell1", "cell2", "cell3"])
    keys = ["grp", "len", "cell1", "cell2", "cell3", *extra]
    a = one.select(*keys, "radius", *(F.col(c).alias(f"a_{c}") for c in ("side", "pos", *shapes)))
    b = two.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("side", "pos", *shapes)))
    close = a.join(b, keys).where((F.col("a_side") > F.col("b_side")) & near_shapes(F.col("radius") * F.col("radius")))
    return close.select("grp", "len", "a_side", "a_pos", "b_side", "b_pos")


def shape_join(
    left: DataFrame,
    right: DataFrame,
    min_score: float,
    table: Sequence[float],
    pair: Column | None = None,
    salted: bool = True,
) -> DataFrame:
    """Fragment pairs of equal group and length whose shapes allow ``min_score``.

    ``left``/``right`` come from :func:`with_shape`; the result prefixes their columns ``a_``/``b_``.
    ``pair`` restricts the sides (columns a_side, b_side).  Passing ``min_score`` <= 0 keeps every
    pair within the scored RMSD range.  Small groups meet as they are, large ones by shape cells.
    """
    pair = F.lit(True) if pair is None else pair
    small, large = small_and_large(left, right, min(CROWD, HOT_CELL))
    found = direct_pairs(*small, min_score, table, pair)
    return found if large is None else found.unionByName(_cell_join(*large, min_score, table, pair, salted).select(found.columns))


def _cell_join(left: DataFrame, right: DataFrame, min_score: float, table: Sequence[float], pair: Column, salted: bool) -> DataFrame:
    radius = limit_of(min_score, table)

    def celled(frags: DataFrame) -> DataFrame:
        numbers = {n: F.coalesce(n, F.lit(0.0)) for n, kind in frags.dtypes if kind == "double"}
        return frags.withColumns(numbers).withColumn("radius", radius).withColumn(
            "cell", F.floor(F.col("u1") / F.col("radius")).cast("int"))

    one = celled(left)
    two = celled(right).withColumn(
        "cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    keys = ["grp", "len", "cell"]
    if salted:
        one, two = _salted(one, two, keys)
        keys = [*keys, "salt"]
    a = one.select(*(F.col(c).alias(c if c in keys else f"a_{c}") for c in one.columns))
    b = two.drop("radius").select(
        *(F.col(c).alias(c if c in keys else f"b_{c}") for c in two.columns if c != "radius"))
    joined = spread(a, keys).join(spread(b, keys), keys).where(pair)
    return joined.where(near_shapes(F.col("a_radius") * F.col("a_radius"))).drop("cell", "salt")


def superpose(pairs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Covariance, fast RMSD (all singular values added) and exact RMSD (proper rotation).

    The covariance ``cjk`` sums a_j * b_k over the centred points.
    """
    width = sum(1 for c in pairs.columns if c.startswith("a_x") and c[3:].isdigit())

    def cov(j: str, k: str) -> Column:
        return F.expr(" + ".join(f"a_{j}{i} * b_{k}{i}" for i in range(width)))

    kept = [
        F.col("grp"), F.col("a_side").alias("side1"), F.col("b_side").alias("side2"),
        F.col("a_pos").alias("p1"), F.col("b_pos").alias("p2"), F.col("len"),
        *(F.col(f"a_m{a}").alias(f"m1{a}") for a in AXES),
        *(F.col(f"b_m{a}").alias(f"m2{a}") for a in AXES),
        *(F.col(c) for c in extra),
    ]
    base = pairs.select(
        *kept,
        own_method_sum(F.col("a_extent"), F.col("b_extent")).alias("_e"),
        *(cov(j, k).alias(f"c{p}{q}") for p, j in enumerate(AXES) for q, k in enumerate(AXES)),
    )
    return rmsd_from_covariance(base)


def singular_values(base: DataFrame) -> DataFrame:
    """Add the singular values ``_s1`` >= ``_s2`` >= |``_s3``| of c00..c22 (the last with the sign of the determinant ``_det``)."""
    c = [F.col(n) for n in COVARIANCE]
    kept = base.columns

    def gram(j: int, k: int) -> Column:
        return c[j] * c[k] + c[3 + j] * c[3 + k] + c[6 + j] * c[6 + k]

    layered = base.select(
        "*", g.determinant_3x3(c).alias("_det"),
        *(gram(j, k).alias(f"_k{j}{k}") for j, k in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))),
    )
    parts = [F.col(f"_k{n}") for n in ("00", "11", "22", "01", "02", "12")]
    eig = g.symmetric_eigenvalues(*parts)
    layered = layered.select("*", eig["mean"].alias("_mean"), eig["spread"].alias("_spread"))
    layered = layered.withColumn("_angle", g.eigen_angle(F.col("_mean"), F.col("_spread"), *parts))
    layered = layered.select(
        "*",
        F.sqrt(F.greatest(g.eigen_top(F.col("_mean"), F.col("_spread"), F.col("_angle")), F.lit(0.0))).alias("_s1"),
        F.sqrt(F.greatest(g.eigen_second(F.col("_mean"), F.col("_spread"), F.col("_angle")), F.lit(0.0))).alias("_s2"),
    )
    product = F.col("_s1") * F.col("_s2")
    third = F.when(product > 1e-9, F.least(F.greatest(
        F.col("_det") / F.greatest(product, F.lit(1e-300)), -F.col("_s2")), F.col("_s2"))).otherwise(F.lit(0.0))
    return layered.select(*kept, "_det", "_s1", "_s2", third.alias("_s3"))


def rmsd_from_covariance(base: DataFrame) -> DataFrame:
    """Add ``rmsd_fast`` and ``rmsd`` to rows holding ``len``, ``_e`` and c00..c22."""
    kept = [n for n in base.columns if n != "_e"]

    def rmsd(third: Column) -> Column:
        error = F.col("_e") - 2.0 * (F.col("_s1") + F.col("_s2") + third)
        return F.sqrt(F.greatest(error, F.lit(0.0)) / F.col("len"))

    return sealed(singular_values(base).select(
        *kept, rmsd(F.abs(F.col("_s3"))).alias("rmsd_fast"), rmsd(F.col("_s3")).alias("rmsd")))


def match_fragments(
    left: DataFrame,
    right: DataFrame,
    min_score: float,
    table: Sequence[float],
    pair: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Fragment matches scoring at least ``min_score``: the join, the superposition and the filter.

    ``left`` and ``right`` come from :func:`with_shape`, ``table`` from :func:`score_curve` or the user.
    """
    pairs = shape_join(left, right, min_score, table, pair)
    scored = superpose(pairs, extra).withColumn("score", fragment_score("rmsd", F.col("len"), table))
    return sealed(scored).where(F.col("score") >= min_score)


def score_curve(frags: DataFrame) -> list[float]:
    """Score table from the fragments themselves: those CURVE_LAG positions apart in a chain are the background.

    One row per fragment and length is superposed; 0.001-Angstrom counts come to the driver.
    """
    parts = [c for c in frags.columns if c not in ("grp", "len")]
    later = Window.partitionBy("grp", "side", "len").orderBy("pos").rangeBetween(CURVE_LAG, CURVE_LAG)
    paired = frags.select("grp", "len", *(F.col(c).alias(f"a_{c}") for c in parts), F.first(F.struct(*parts)).over(later).alias("_later"))
    pairs = paired.where("_later IS NOT NULL").select("*", *(F.col(f"_later.{c}").alias(f"b_{c}") for c in parts)).drop("_later")
    sized = sealed(superpose(pairs))
    bins = sized.groupBy(F.least(F.ceil(F.col("rmsd") * 1000).cast("int"), F.lit(TABLE_SIZE)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).collect()
    count = sum(r["n"] for r in bins)
    return curve_from_counts({r["bin"]: r["n"] for r in bins}, sum(r["total"] for r in bins) / count if count else float(MAX_FRAGMENT))


def chain_matches(
    labelled: DataFrame, min_score: float, table: Sequence[float] | None = None
) -> DataFrame:
    """Matches between the chains of a job (larger chain id first)."""
    frags = cut_lineage(with_shape(sliding_fragments(chain_side(labelled))))
    return match_fragments(frags, frags, min_score, table or score_curve(frags), F.col("a_side") > F.col("b_side"))


def best_match_per_pair(matches: DataFrame) -> DataFrame:
    """Highest score of every pair of sides; ties go to the lowest starts, then the shortest."""
    order = F.struct(F.col("score"), -F.col("p1"), -F.col("p2"), -F.col("len"))
    return matches.groupBy("grp", "side1", "side2").agg(
        F.max_by(F.struct("p1", "p2", "len", "rmsd", "score"), order).alias("best"),
        F.count(F.lit(1)).alias("n_matches"),
    ).select("grp", "side1", "side2", "best.*", "n_matches")

"""Every operator as a query over the driver's tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.functions import scoring
from foldloom.functions.superpose import superposition_aggregate, with_map
from foldloom.operators import blocks, columns, extension, fragments, layout, radius, rigid, secondary
from foldloom.operators.chaining import hinge_edges
from foldloom.plans import job, progressive
from foldloom.session import cut_lineage
from foldloom.sinks import text
from foldloom.sources import derived, derived_views, jobs, pdb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_RESULTS: dict[tuple[str, str, str], object] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """Written intermediate results are shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _RESULTS:
        _RESULTS[key] = make()
    return _RESULTS[key]


def _r(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "labelled", lambda: cut_lineage(blocks.label_blocks(derived.residues(spark, sf_dir))))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "fragments", lambda: cut_lineage(
        fragments.with_shape(fragments.sliding_fragments(fragments.chain_side(_labelled(spark, sf_dir))))))


def _curve(spark: SparkSession, sf_dir: str) -> list[float]:
    return _once(spark, sf_dir, "curve", lambda: fragments.score_curve(_fragments(spark, sf_dir)))


def _matches(spark: SparkSession, sf_dir: str, min_score: float = 0.6, extra: Sequence[str] = ()) -> DataFrame:
    """Matches of all chain pairs; a query takes them as they come, since written they are far larger than the fragments."""
    frags = _fragments(spark, sf_dir)
    return fragments.match_fragments(frags, frags, min_score, _curve(spark, sf_dir), F.col("a_side") > F.col("b_side"), extra)


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _once(spark, sf_dir, "merged", lambda: {
        k: cut_lineage(v) for k, v in progressive.multiple_alignment(derived.residues(spark, sf_dir), _curve(spark, sf_dir)).items()})


def _finished(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _once(spark, sf_dir, "finished", lambda: {
        k: cut_lineage(v) for k, v in job.finish_alignments(_merged(spark, sf_dir), derived.residues(spark, sf_dir)).items()})


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        done = _finished(spark, sf_dir)
        rows = layout.sequence_alignment(done["columns"], done["members"], derived.residues(spark, sf_dir))
        return cut_lineage(rows.withColumn("id_string", F.concat(F.lit("vec:"), F.col("chain").cast("string"))))
    return _once(spark, sf_dir, "rows", make)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.residues(spark, sf_dir).select(
        "job_id", "chain", "res_idx", "letter", (F.col("res_idx") + 1).alias("res_num"), F.lit(" ").alias("ins_code"))


# Derived chains, blocks and fragments -------------------------------------------------------------


@query
def chain_points(spark, sf_dir):
    return _r(derived.chain_points(spark, sf_dir), "x", "y", "z")


@query
def blocks_islands(spark, sf_dir):
    return blocks.block_table(blocks.label_blocks(derived.residues(spark, sf_dir)))


@query
def block_gaps(spark, sf_dir):
    residues = derived.residues(spark, sf_dir)
    return blocks.block_gaps(blocks.block_table(blocks.label_blocks(residues)), job.chain_lengths(residues))


@query
def residue_to_block(spark, sf_dir):
    residues = derived.residues(spark, sf_dir)
    table = blocks.block_table(blocks.label_blocks(residues))
    return blocks.residue_to_block(residues, table).select("job_id", "chain", "res_idx", "move_block")


@query
def sliding_fragments(spark, sf_dir):
    frags = fragments.sliding_fragments(fragments.chain_side(blocks.label_blocks(derived.residues(spark, sf_dir))))
    return _r(frags.select("grp", "side", "pos", "len", "mx", "my", "mz", "extent"), "mx", "my", "mz", "extent")


@query
def fragment_rmsd(spark, sf_dir):
    return _r(_matches(spark, sf_dir).select("grp", "side1", "side2", "p1", "p2", "len", "rmsd_fast", "rmsd"), "rmsd_fast", "rmsd")


@query
def fragment_scores(spark, sf_dir):
    found = _matches(spark, sf_dir, scoring.SEARCH_PASSES[0][0])
    return _r(found.select("grp", "side1", "side2", "p1", "p2", "len", "score"), "score")


@query
def best_match_per_pair(spark, sf_dir):
    """Flagship: blocks, fragments, shape join, closed-form RMSD, score, best match of every pair."""
    found = fragments.chain_matches(blocks.label_blocks(derived.residues(spark, sf_dir)), 0.6)
    return _r(fragments.best_match_per_pair(found), "rmsd", "score")


@query
def chain_pairs(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy("grp", "side1", "side2").agg(F.count(F.lit(1)).alias("n_matches"))


@query
def chain_superposition(spark, sf_dir):
    points = blocks.present(derived.residues(spark, sf_dir))
    a = points.select("job_id", "chain", "res_idx", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = points.select("job_id", (F.col("chain") - 1).alias("chain"), "res_idx", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    done = superposition_aggregate(a.join(b, ["job_id", "chain", "res_idx"]), ["job_id", "chain"])
    z = scoring.significance_z(F.col("rmsd"), F.col("len"))
    return _r(done.select("job_id", "chain", "len", "rmsd_fast", "rmsd", z.alias("z"), scoring.normal_cdf(z).alias("pvalue")),
              "rmsd_fast", "rmsd", "z").drop("pvalue")


@query
def pairwise_pvalue(spark, sf_dir):
    points = blocks.present(derived.residues(spark, sf_dir))
    a = points.select("job_id", "chain", "res_idx", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = points.select("job_id", (F.col("chain") - 1).alias("chain"), "res_idx", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    done = superposition_aggregate(a.join(b, ["job_id", "chain", "res_idx"]), ["job_id", "chain"])
    return _r(done.select("job_id", "chain", scoring.normal_cdf(scoring.significance_z(F.col("rmsd"), F.col("len"))).alias("pvalue")), "pvalue", digits=5)


@query
def rotation_maps(spark, sf_dir):
    mapped = with_map(_matches(spark, sf_dir, 1.6))
    rotation = g.rotation_part(g.unpack(F.col("m")))
    shift = [F.element_at("m", k).alias(f"t{x}") for k, x in ((4, "x"), (8, "y"), (12, "z"))]
    found = mapped.select(
        "grp", "side1", "side2", "p1", "p2", "len", g.determinant_3x3(rotation).alias("determinant"),
        *[e.alias(f"r{k}") for k, e in enumerate(rotation)], *shift)
    rounded = {n: F.round(n, 4) for n in found.columns[6:]}
    return found.withColumns({n: F.when(e == 0, 0.0).otherwise(e) for n, e in rounded.items()})  # no negative zeros


@query
def map_residuals(spark, sf_dir):
    """RMSD left after side 2 of every strong match is moved by its map, from the moved points."""
    points = [f"{s}_{c}{k}" for s in "ab" for c in "xyz" for k in range(scoring.MAX_FRAGMENT)]
    mapped = with_map(_matches(spark, sf_dir, 1.6, points))
    parts = []
    for k in range(scoring.MAX_FRAGMENT):
        one, two = (tuple(F.col(f"m{n}{c}") + F.col(f"{x}_{c}{k}") for c in "xyz") for n, x in ((1, "a"), (2, "b")))
        apart = g.distance_squared(one, g.apply_affine(g.unpack(F.col("m")), two))
        parts.append(F.when(F.col("len") > k, apart).otherwise(0.0))
    return _r(mapped.select(
        "grp", "side1", "side2", "p1", "p2", "len", F.sqrt(fragments.own_method_sum(*parts) / F.col("len")).alias("residual")), "residual")


# Geometry and scores ------------------------------------------------------------------------------


def _quaternion(start: int):
    parts = [F.col("embedding")[start + k].cast("double") for k in range(4)]
    size = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2] + parts[3] * parts[3])
    return tuple(p / size for p in parts)


@query
def hinge_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p, q = _quaternion(0), _quaternion(4)
    shift = g.distance(*(tuple(F.col("embedding")[s + k].cast("double") for k in range(3)) for s in (8, 11)))
    base = vectors.select("vec_id", g.half_angle_cosine(p, q).alias("half_cosine"), shift.alias("displacement"))
    return _r(base.select(
        "vec_id", "half_cosine", scoring.angle_bonus(F.col("half_cosine")).alias("angle_bonus"),
        scoring.displacement_bonus(F.col("displacement")).alias("displacement_bonus")), "half_cosine", "angle_bonus", "displacement_bonus")


@query
def affine_moves(spark, sf_dir):
    """Rotate and shift every chain by its own quaternion, compose with the inverse, and come back."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    r = g.rotation_from_quaternion(_quaternion(0))
    shift = [F.col("embedding")[4 + k].cast("double") for k in range(3)]
    m = F.array(*(v for k in range(3) for v in (*r[3 * k:3 * k + 3], shift[k])))
    maps = fragments.sealed(vectors.select(F.col("vec_id").alias("chain"), m.alias("m")))
    joined = derived.chain_points(spark, sf_dir).join(maps, "chain")
    unpacked = g.unpack(F.col("m"))
    moved = joined.select("chain", "res_idx", "m", *(v.alias(c) for c, v in zip("xyz", g.apply_affine(unpacked, g.vec("x", "y", "z")))))
    back = g.apply_affine(g.invert_affine(unpacked), g.vec("x", "y", "z"))
    q = g.quaternion_from_rotation(g.rotation_part(unpacked))
    return _r(moved.select("chain", "res_idx", "x", "y", "z", *(v.alias(f"back_{c}") for c, v in zip("xyz", back)),
                           F.abs(q[3]).alias("w"), g.determinant_3x3(g.rotation_part(unpacked)).alias("determinant")),
              "x", "y", "z", "back_x", "back_y", "back_z", "w", "determinant")


# Columns ------------------------------------------------------------------------------------------


@query
def column_rmsd(spark, sf_dir):
    return _r(columns.column_rmsd(derived_views.index_columns(spark, sf_dir)), "rmsd")


@query
def leave_one_out_mean(spark, sf_dir):
    cells = derived_views.index_columns(spark, sf_dir).where("x IS NOT NULL")
    return _r(columns.leave_one_out_means(cells), "other_x", "other_y", "other_z")


@query
def weighted_means(spark, sf_dir):
    cells = derived_views.index_columns(spark, sf_dir)
    members = cells.select("job_id", "aln_id", "slot", "chain").distinct()
    weights = columns.uniform_weights(members, exclude_slot=0).select("job_id", "aln_id", "chain", "weight")
    return _r(columns.weighted_means(cells.join(weights, ["job_id", "aln_id", "chain"])), "x", "y", "z")


@query
def core_columns(spark, sf_dir):
    cells = derived_views.index_columns(spark, sf_dir)
    return columns.core_columns(cells, cells.select("job_id", "aln_id", "chain").distinct())


@query
def core_counts(spark, sf_dir):
    cells = derived_views.index_columns(spark, sf_dir)
    return columns.core_counts(cells, cells.select("job_id", "aln_id", "chain").distinct())


@query
def conflict_pairs(spark, sf_dir):
    return columns.conflict_pairs(derived_views.overlapping_columns(spark, sf_dir))


@query
def bounding_boxes(spark, sf_dir):
    box = columns.bounding_box(derived_views.index_columns(spark, sf_dir))
    return _r(box, *(c for c in box.columns if c.startswith(("min", "max"))))


# Spatial joins ------------------------------------------------------------------------------------


@query
def radius_join(spark, sf_dir):
    points = blocks.present(derived.residues(spark, sf_dir)).select("job_id", "chain", "res_idx", "x", "y", "z")
    near = radius.radius_join(points, points, 5.0, ["job_id"]).where("a_chain > b_chain")
    return _r(near.select("job_id", "a_chain", "a_res_idx", "b_chain", "b_res_idx", "distance"), "distance")


@query
def nearest_segment(spark, sf_dir):
    residues = derived.residues(spark, sf_dir)
    gaps = residues.select("job_id", F.lit(0).cast("long").alias("aln_id"), "chain").distinct().select(
        "*", F.inline(F.array(
            F.struct(F.lit(0).alias("gap"), F.lit(0).alias("gap_first"), F.lit(9).alias("gap_last")),
            F.struct(F.lit(1).alias("gap"), F.lit(10).alias("gap_first"), F.lit(20).alias("gap_last")))))
    found = extension.nearest_segments(gaps, residues.drop("letter"), 2, 6.0)
    return _r(found, "distance")


@query
def hinge_edges_between_matches(spark, sf_dir):
    """Acceptable hinges between strong matches of a chain pair (the relational form of the rules)."""
    mapped = cut_lineage(with_map(_matches(spark, sf_dir, 1.6)).select(
        F.concat_ws(":", "grp", "side1", "side2").alias("grp"), "side2", "p1", "p2", "len", "m",
        F.concat_ws("-", "p1", "p2", "len").alias("id")))
    track = mapped.select("grp", "side2").distinct().join(
        _labelled(spark, sf_dir).select(F.col("chain").alias("side2"), F.col("res_idx").alias("col"), "x", "y", "z"), "side2").drop("side2")
    return _r(hinge_edges(mapped.drop("side2"), track, 45.0, 5.0).drop("end2"), "half_cosine", "displacement", "bonus")


# Alignments ---------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "pairs", lambda: cut_lineage(
        progressive.pair_regions(derived.residues(spark, sf_dir), _curve(spark, sf_dir))[0]))


@query
def pair_regions(spark, sf_dir):
    """Regions of every chain pair after the three passes of the staged search."""
    return _r(_pairs(spark, sf_dir).select("grp", "ord", "p1", "p2", "len", "score", "total"), "score", "total", digits=3)


@query
def pair_alignment(spark, sf_dir):
    return _r(progressive.pair_scores(_pairs(spark, sf_dir)), "score", digits=3)


@query
def multiple_alignment(spark, sf_dir):
    return _merged(spark, sf_dir)["alignments"]


@query
def alignment_columns(spark, sf_dir):
    return _merged(spark, sf_dir)["columns"]


@query
def rigid_superposition(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return rigid.rigid_maps(merged["columns"], merged["alignments"].where("n_cols > 0 AND n_chains > 1"), derived.residues(spark, sf_dir))


@query
def bent_coordinates(spark, sf_dir):
    residues = derived.residues(spark, sf_dir)
    table, maps = job.bent_blocks(_merged(spark, sf_dir), residues)
    return rigid.move_by_block(blocks.present(residues).select("job_id", "chain", "res_idx", "x", "y", "z"), table, maps)


@query
def final_alignment(spark, sf_dir):
    return _finished(spark, sf_dir)["alignments"]


@query
def final_extension(spark, sf_dir):
    return _finished(spark, sf_dir)["core"]


@query
def partial_alignment(spark, sf_dir):
    return _finished(spark, sf_dir)["columns"]


@query
def column_compaction(spark, sf_dir):
    """Gapped rows before and after gap columns moved left."""
    placed = derived_views.scattered_columns(spark, sf_dir)
    before = layout.gapped_rows(placed).withColumnRenamed("row", "scattered")
    return layout.gapped_rows(layout.compact_columns(placed)).join(before, ["job_id", "aln_id", "slot", "chain"])


@query
def sequence_alignment(spark, sf_dir):
    return _rows(spark, sf_dir)


# Sinks --------------------------------------------------------------------------------------------


@query
def fasta_lines(spark, sf_dir):
    return text.fasta(derived_views.document_sequences(spark, sf_dir)).drop("aln_id", "major")


@query
def pir_lines(spark, sf_dir):
    return text.pir(derived_views.document_sequences(spark, sf_dir)).drop("aln_id", "major")


@query
def msf_checksums(spark, sf_dir):
    rows = derived_views.document_sequences(spark, sf_dir)
    return rows.select("job_id", text.checksum(F.col("row")).alias("checksum"))


@query
def alignment_fasta(spark, sf_dir):
    return text.fasta(_rows(spark, sf_dir))


@query
def alignment_msf(spark, sf_dir):
    return text.msf(_rows(spark, sf_dir), "alignment", "01-Jan-00 00:00:00")


@query
def alignment_report(spark, sf_dir):
    return text.report(_rows(spark, sf_dir), _finished(spark, sf_dir)["alignments"], _numbered(spark, sf_dir))


@query
def alignment_script(spark, sf_dir):
    done = _finished(spark, sf_dir)
    return text.script(text.full_blocks(done["columns"], done["members"]), _numbered(spark, sf_dir))


@query
def alignment_view(spark, sf_dir):
    done = _finished(spark, sf_dir)
    return text.view(text.full_blocks(done["columns"], done["members"]), _numbered(spark, sf_dir))


@query
def alignment_coordinates(spark, sf_dir):
    done = _finished(spark, sf_dir)
    residues = done["members"].join(_numbered(spark, sf_dir), ["job_id", "chain"]).join(
        F.broadcast(derived_views._names(spark)), "letter")
    atoms = residues.join(done["residues"].select("job_id", "chain", "res_idx", "x", "y", "z"), ["job_id", "chain", "res_idx"]).where(
        "x IS NOT NULL").select(
        "*", F.lit(0).alias("atom_ord"), F.lit(" CA ").alias("name"), F.lit(" ").alias("alt_loc"), F.lit(0).alias("code"),
        F.lit(None).cast("float").alias("occupancy"), F.lit(None).cast("float").alias("temp_factor"), F.lit("C").alias("element"),
        F.lit(0).alias("charge"))
    return text.coordinates(atoms, residues)


# Sources ------------------------------------------------------------------------------------------


@query
def coordinate_lines(spark, sf_dir):
    return derived_views.structure_lines(spark, sf_dir)


@query
def structure_atoms(spark, sf_dir):
    return pdb.atoms(derived_views.structure_lines(spark, sf_dir)).select(
        "path", "model_no", "chain_id", "serial", "name", "res_name", "res_num", "x", "y", "z", "element", "run", "atom_ord")


@query
def sequence_reconciliation(spark, sf_dir):
    found = pdb.residues(derived_views.sequence_lines(spark, sf_dir))
    return found.select("path", "chain_id", "res_idx", "res_name", "res_num", "letter", "x", "y", "z")


@query
def job_split(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("-o out"), key))
        .when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("# note "), key))
        .when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  s"), key, F.lit(":A "))))
    return jobs.split_jobs(orders.select(
        F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line_no"), line.alias("line")))


@query
def selector_parse(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("s"), k.cast("string"))
    made = (
        F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(name, F.lit(":"))).when(k % 6 == 2, F.concat(name, F.lit(":AbC")))
        .when(k % 6 == 3, F.concat(name, F.lit("::"), (k % 4).cast("string")))
        .when(k % 6 == 4, F.concat(name, F.lit(":A("), (k % 50).cast("string"), F.lit("-"), (k % 50 + 9).cast("string"), F.lit("B)C:2,D")))
        .otherwise(F.concat(name, F.lit(":A:1,B(-3-"), (k % 9).cast("string"), F.lit("):0"))))
    return jobs.parse_selectors(orders.select(k.alias("job_id"), made.alias("selector"))).drop("selector")


# Secondary structure ------------------------------------------------------------------------------


def _bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "bonds", lambda: cut_lineage(
        secondary.hydrogen_bonds(derived_views.backbone(spark, sf_dir))))


@query
def hydrogen_bonds(spark, sf_dir):
    return _r(secondary.hydrogen_bonds(derived_views.backbone(spark, sf_dir)), "energy", digits=2)


@query
def helix_runs(spark, sf_dir):
    return secondary.helices(_bonds(spark, sf_dir))


@query
def strand_ladders(spark, sf_dir):
    return secondary.strand_pairs(_bonds(spark, sf_dir))


@query
def beta_sheets(spark, sf_dir):
    points = derived.chain_points(spark, sf_dir).select("job_id", "chain", "res_idx", "x", "y", "z")
    return secondary.sheets(secondary.strand_pairs(_bonds(spark, sf_dir)), points)


@query
def helix_records(spark, sf_dir):
    numbered = _numbered(spark, sf_dir).join(F.broadcast(derived_views._names(spark)), "letter")
    return secondary.record_lines(secondary.helices(_bonds(spark, sf_dir)), numbered, F.lit("A"))


def _sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ladder as a sheet of two strands, in SHEET records."""
    ladders = secondary.strand_pairs(_bonds(spark, sf_dir))
    order = Window.partitionBy("job_id", "chain").orderBy("start1", "start2", "direction", "length")
    alone = ladders.withColumns({"sheet": F.row_number().over(order) - 1, "ord": F.lit(0)})
    numbered = _numbered(spark, sf_dir).join(F.broadcast(derived_views._names(spark)), "letter")
    return secondary.sheet_lines(alone, numbered, F.lit("A"))


@query
def sheet_records(spark, sf_dir):
    return _sheet_records(spark, sf_dir)


@query
def sheet_registration(spark, sf_dir):
    """SHEET records read back: the registered residue pair is carried to the strands' ends."""
    path = F.concat_ws("/", F.col("job_id").cast("string"), F.col("chain").cast("string"))
    lines = _sheet_records(spark, sf_dir).select(path.alias("path"), F.col("ord").alias("line_no"), "line")
    numbers = _numbered(spark, sf_dir).select(
        path.alias("path"), F.lit(0).alias("model_ord"), F.lit(0).alias("model_no"), F.lit("A").alias("chain_id"), "res_num", "ins_code", "res_idx")
    return pdb.sheet_pairs(lines, numbers)

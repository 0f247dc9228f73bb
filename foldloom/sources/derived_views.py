"""More inputs derived from the chain table: columns of a job, backbones, structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.functions.residues import in_capitals
from foldloom.sources.derived import JOB_SIZE, chain_points, residues


def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a job aligned by residue number: column = residue, block = run of five residues."""
    return residues(spark, sf_dir).select(
        "job_id", F.lit(0).cast("long").alias("aln_id"), F.pmod("chain", F.lit(JOB_SIZE)).cast("int").alias("slot"), "chain",
        F.floor(F.col("res_idx") / 5).cast("int").alias("block"), F.col("res_idx").alias("col"),
        F.when(F.col("x").isNotNull(), F.col("res_idx")).alias("res_idx"), "x", "y", "z")


def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N, CA, C and O positions placed between consecutive points of a chain.

    C lies 0.4 of the way to the next point, N 0.4 of the way back, O one unit off C across the walk.
    """
    points = chain_points(spark, sf_dir)
    order = Window.partitionBy("job_id", "chain").orderBy("res_idx")
    steps = points.select("*", *(F.lead(c).over(order).alias(f"_n{c}") for c in "xyz"), *(F.lag(c).over(order).alias(f"_p{c}") for c in "xyz"))
    here, ahead, back = g.vec("x", "y", "z"), g.vec("_nx", "_ny", "_nz"), g.vec("_px", "_py", "_pz")
    side = g.normalise(g.cross(g.subtract(ahead, here), g.subtract(here, back)))
    c_atom = g.add(here, g.scale(g.subtract(ahead, here), 0.4))
    return steps.select(
        "job_id", "chain", "res_idx", "letter",
        *(v.alias(f"ca{c}") for c, v in zip("xyz", here)),
        *(v.alias(f"n{c}") for c, v in zip("xyz", g.subtract(here, g.scale(g.subtract(here, back), 0.4)))),
        *(v.alias(f"c{c}") for c, v in zip("xyz", c_atom)),
        *(v.alias(f"o{c}") for c, v in zip("xyz", g.add(c_atom, side))))


def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width coordinate records of every present residue: one file per job, chains A, B, ..."""
    return residues(spark, sf_dir).where("x IS NOT NULL").select(
        F.concat(F.lit("job"), F.col("job_id").cast("string")).alias("path"),
        (F.pmod("chain", F.lit(JOB_SIZE)) * 100 + F.col("res_idx")).cast("int").alias("line_no"),
        F.format_string(
            "ATOM  %5d  CA  %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C  ", F.col("res_idx") + 1,
            F.lit("ALA"), F.substring(F.lit("ABCDEFGH"), (F.pmod("chain", F.lit(JOB_SIZE)) + 1).cast("int"), F.lit(1)),
            F.col("res_idx") + 1, "x", "y", "z").alias("line"))


def overlapping_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of blocks of seven that overlap their neighbour by two residues."""
    chains = residues(spark, sf_dir).select("job_id", "chain").distinct()
    return chains.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(26)))).select(
        "job_id", F.lit(0).cast("long").alias("aln_id"), F.pmod("chain", F.lit(JOB_SIZE)).cast("int").alias("slot"), "chain",
        F.floor(F.col("col") / 7).cast("int").alias("block"), "col",
        (F.col("col") - 2 * F.floor(F.col("col") / 7) + F.when((F.col("chain") % 2 == 1) & (F.col("col") >= 7), 1).otherwise(0)).cast("int").alias("res_idx"))


def scattered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present residues in linear columns: two in five stay together, the others stand by the number of their chain in the job."""
    slot = F.pmod("chain", F.lit(JOB_SIZE)).cast("int")
    turn = F.when(F.pmod(F.col("chain") * 7 + F.floor(F.col("res_idx") / 2) * 3, F.lit(5)) < 3, (F.col("chain") * 3 + F.col("res_idx")) % JOB_SIZE).otherwise(0)
    together = F.col("res_idx") % 6 == 0
    spread = F.when(together, 0).otherwise(turn)
    rows = residues(spark, sf_dir).where("x IS NOT NULL").select(
        "job_id", F.lit(0).cast("long").alias("aln_id"), slot.alias("slot"), "chain", "res_idx", "letter",
        (F.col("res_idx") * JOB_SIZE + spread).alias("wide"))
    return rows.withColumn("pos", F.dense_rank().over(Window.partitionBy("job_id").orderBy("wide")) - 1).drop("wide")


def sequence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQRES records naming every residue of a chain, present or not, ahead of its coordinates."""
    named = residues(spark, sf_dir).join(F.broadcast(_names(spark)), "letter")
    label = F.substring(F.lit("ABCDEFGH"), (F.pmod("chain", F.lit(JOB_SIZE)) + 1).cast("int"), F.lit(1))
    path = F.concat(F.lit("job"), F.col("job_id").cast("string"))
    grouped = named.withColumn("k", F.floor(F.col("res_idx") / 13).cast("int")).groupBy("job_id", "chain", "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_idx", "res_name"))), lambda e: e["res_name"]), " ").alias("t"))
    seqres = grouped.select(
        path.alias("path"), (F.pmod("chain", F.lit(JOB_SIZE)) * 10 + F.col("k")).cast("int").alias("line_no"),
        F.format_string("SEQRES %3d %1s %4d  %s", F.col("k") + 1, label, F.lit(21), "t").alias("line"))
    atoms = named.where("x IS NOT NULL").select(
        path.alias("path"), (F.pmod("chain", F.lit(JOB_SIZE)) * 100 + F.col("res_idx") + 1000).cast("int").alias("line_no"),
        F.format_string(
            "ATOM  %5d  CA  %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C  ", F.col("res_idx") + 1, "res_name", label,
            F.col("res_idx") + 1, "x", "y", "z").alias("line"))
    return seqres.unionByName(atoms)


def _names(spark: SparkSession) -> DataFrame:
    from foldloom.functions.residues import RESIDUES

    return spark.createDataFrame([(letter, name) for name, letter in RESIDUES[:20]], "letter string, res_name string")


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as letter sequences (everything but letters removed, a-z in capitals)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return docs.select(
        F.col("doc_id").alias("job_id"), F.lit(0).cast("long").alias("aln_id"), F.lit(0).alias("slot"), F.col("doc_id").alias("chain"),
        F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("id_string"),
        in_capitals(F.regexp_replace("text", r"\P{L}", "")).alias("row"))

"""Residue chains derived from a table of embedding vectors.

Each 64-float vector becomes one chain of 21 residues: three floats give the direction of a step of
3.8 Angstrom (the spacing of neighbouring alpha carbons) and the positions are the running sums.
Some residues lose their coordinates by rule, as residues without an alpha carbon would.  Chains
are grouped into jobs of ``JOB_SIZE`` neighbouring ids; a job is one multiple alignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAIN_LENGTH = 21
STEP = 3.8
JOB_SIZE = 4
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def chain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residue of every derived chain, with all coordinates."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("chain"), "embedding"
    )
    steps = vectors.select(
        "chain",
        F.explode(F.sequence(F.lit(0), F.lit(CHAIN_LENGTH - 1))).alias("res_idx"),
        "embedding",
    ).select(
        "chain", "res_idx",
        *(F.get("embedding", F.col("res_idx") * 3 + k).cast("double").alias(f"d{k}") for k in range(3)),
    )
    size = F.sqrt(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2"))
    walk = Window.partitionBy("chain").orderBy("res_idx").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("size", size).select(
        F.floor(F.col("chain") / JOB_SIZE).cast("long").alias("job_id"),
        "chain", "res_idx",
        F.substring(F.lit(ALPHABET), ((F.col("chain") + F.col("res_idx")) % 20 + 1).cast("int"), F.lit(1))
        .alias("letter"),
        ((F.col("chain") * 7 + F.col("res_idx")) % 11 != 0).alias("present"),
        *(
            F.sum(F.coalesce(F.try_divide(F.lit(STEP) * F.col(f"d{k}"), F.col("size")), F.lit(0.0)))
            .over(walk).alias(axis)
            for k, axis in enumerate("xyz")
        ),
    )


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived chains as a residue table: NULL coordinates mark missing residues."""
    points = chain_points(spark, sf_dir)
    return points.select(
        "job_id", "chain", "res_idx", "letter",
        *(F.when(F.col("present"), F.col(axis)).alias(axis) for axis in "xyz"),
    )

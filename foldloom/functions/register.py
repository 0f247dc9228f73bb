"""Make the engine's scalar functions available to Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foldloom.functions.scoring import normal_cdf
from foldloom.functions.superpose import superposition_map
from foldloom.sources.files import decompressed


def register(spark: SparkSession) -> None:
    """``normal_cdf(z)``, ``superposition_map(cov, centre1, centre2)`` and ``decompressed(binary)``."""
    for name, function in (
        ("normal_cdf", normal_cdf), ("superposition_map", superposition_map), ("decompressed", decompressed)):
        spark.udf.register(name, function)

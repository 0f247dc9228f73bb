"""Session helpers: a tuned local session for tests and lineage cuts that survive executor loss."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = 8, app: str = "foldloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the session comes from the submitter."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by ``keys`` over all shuffle partitions for work whose cost is not its size.

    Adaptive execution merges small partitions; groups that are few bytes but much arithmetic must
    stay apart, and an explicit partition count is left alone.  The grouping below reuses it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, for rows that hold whole groups."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="foldloom-pkg-")
        archive = shutil.make_archive(f"{folder}/foldloom", "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary one is made, in local mode only: on a cluster every executor
    would write to its own disk and later reads would miss those files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="foldloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_SCRATCH: list[str] = []


def fresh_path(spark: SparkSession) -> str:
    folder = _SCRATCH[-1] if _SCRATCH else f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    return f"{folder}/{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all that ``cut_lineage`` writes inside; the caller deletes it when no frame needs it any more."""
    _SCRATCH.append(fresh_path(spark))
    try:
        yield _SCRATCH[-1]
    finally:
        _SCRATCH.pop()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of queries that have been written: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def delete_table(written: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote and no frame needs any more."""
    for folder in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
        delete_folder(written.sparkSession, folder)


#: Spark's own switch to delete the shuffles of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; the shuffles that this took are deleted when it is done, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


class RoundTable:
    """A table that grows by one written part a round; what is there is never rewritten.

    Rows of earlier rounds that no longer count are left to the reader's joins, until a round as a whole
    is dead: then its part is deleted and no longer read.
    """

    def __init__(self, spark: SparkSession, schema: str | None = None):
        self.spark, self.path = spark, fresh_path(spark)
        self.schema = None if schema is None else StructType.fromDDL(schema)
        self.rounds: list[int] = []

    def append(self, rows: DataFrame, step: int) -> None:
        if self.schema is None:
            self.schema = rows.schema
        write_table(rows.select(*self.schema.names), f"{self.path}/round={step}")
        self.rounds.append(step)

    def read(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/round={r}" for r in self.rounds))

    def keep(self, rounds: set[int]) -> None:
        """Delete the parts of all other rounds; frames read before must no longer be used."""
        for r in [r for r in self.rounds if r not in rounds]:
            delete_folder(self.spark, f"{self.path}/round={r}")
            self.rounds.remove(r)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The copy survives the loss of executors, ends the lineage, and gives the planner real sizes
    (a checkpoint would carry on estimates that multiply with every join of a loop).
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)

"""Helpers shared by the text operators: table reading, size-checked joins, word splitting."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.session import ship_package

#: Most rows, and most bytes, of a table that is sent to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make the session fit for Python stages over whole texts: the package shipped, Arrow batches bounded in bytes.

    Rows of very long texts would otherwise fill batches of 64 MB in every worker.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def broadcast_if_small(written: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """Hint a broadcast after counting a written table; larger ones are left to a shuffle join.

    ``row_bytes`` gives the bytes of a row where they are not small and fixed.
    """
    size = F.sum(row_bytes) if row_bytes is not None else F.lit(0).cast("long")
    rows, size = written.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(written) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else written


def narrow_side(written: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """A broadcast if small, else hashed where the other side's rows, which may hold whole texts, would have to be sorted."""
    side = broadcast_if_small(written, row_bytes)
    return side if side is not written else written.hint("shuffle_hash")


def _spaced(text: Column) -> Column:
    """ASCII white space as single space characters; replacing is much cheaper than translating."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    letters = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # lower() would turn other capitals too; on plain ASCII it does the same and is faster
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(letters)
    return F.filter(F.split(_spaced(lowered), " "), lambda w: w != "")


def word_shingles(text: Column, size: int) -> Column:
    """Distinct 64-bit hashes of ``size``-word shingles; of the whole sequence where it is shorter.

    An empty array for texts without words.
    """
    hashed = F.transform(ascii_words(text), lambda w: F.xxhash64(w))
    return F.array_distinct(window_hashes(hashed, size))


def window_hashes(hashed: Column, size: int) -> Column:
    """One hash for each window of ``size`` elements of an array of hashes, in order."""

    def windows(h: Column) -> Column:
        # position by position: the element itself and the next ones, read by index
        def at(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)])

        full = F.slice(F.transform(h, at), F.lit(1), F.size(h) - (size - 1))
        return F.when(F.size(h) >= size, full).when(F.size(h) > 0, F.array(F.xxhash64(F.lit(-1).cast("long"), h))).otherwise(
            F.array().cast("array<bigint>"))

    # bound once: an expression that occurs in several places would be evaluated in each
    return F.flatten(F.transform(F.array(hashed), windows))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


#: Characters stripped from both ends of a word before it is compared.
EDGE = ".,;:!?\"'()[]{}*#%&$|-"


def normal_words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends; an empty array for null."""
    return F.filter(F.transform(F.split(_spaced(F.lower(F.coalesce(text, F.lit("")))), " "), lambda w: F.btrim(w, F.lit(EDGE))), lambda w: w != "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, th, text): the whole row beside its id and a hash of its text.

    (id, th) names a document: rows repeated in full share it and are treated alike.
    """
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
        F.col(text_col).alias("text"))


def on_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (id, th), nulls alike; the right side's key columns are dropped."""
    right = right.withColumnRenamed("id", "r_id").withColumnRenamed("th", "r_th")
    joined = left.join(right, same(F.col("id"), F.col("r_id")) & (F.col("th") == F.col("r_th")), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("r_id", "r_th")


def parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``most`` bytes of text, or one row.

    An Arrow batch may hold tens of megabytes; as Python objects only a part of it exists at a time.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, size = 0, 0
    for k, n in enumerate(sizes):
        if k > start and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Give freed memory back to the system: an idle worker process stays on beside the tasks of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]

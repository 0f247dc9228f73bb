"""Near-duplicate documents: b-bit MinHash signatures in a multi-index Hamming join.

A document's set of word shingles is hashed inside Spark; numpy reduces it to a signature of
``values`` 16-bit minima, and to an order-free fingerprint under which equal sets are one node.
Signatures are cut into chunks of ``chunk`` values.  Two signatures that differ in at most
``chunks * (errors + 1) - 1`` values have, by the pigeonhole principle, a chunk with at most
``errors`` differences; each chunk therefore gives one key for every choice of ``errors``
positions left out, and such pairs always share a key (60 values, chunks of 6, 1 error: 60 keys,
all pairs up to a distance of 19; a pair with similarity 0.8 is expected at distance 12 and is
missed once in 40,000).  Links are then confirmed on the full sets.

A dense group of copies holds many pairs just below the threshold.  They are ruled out before
they become rows by odd sketches: a set's sketch is the parity of its members in each of 2048
bins, so two sketches never differ in more bits than the sets differ in members.  The bound is
exact and loses no link.

Defined results: a null or empty text has an empty set and links with nothing.  Rows of one id are
judged by their own texts; equal ones alike.  A row without an id gets the component of its copies and goes, or
null and is kept.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import broadcast_if_small, prepare, word_shingles
from foldloom.llm.links import linked_groups, shared_keys
from foldloom.session import cut_lineage

VALUES, CHUNK, ERRORS = 60, 6, 1
#: Words of 64 bits of an odd sketch.
SKETCH = 32
ODD = [f"o{k}" for k in range(SKETCH)]
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def signatures(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    """(id, th, shingles) to (id, th, n, f1, f2, signature, sketch words); minima over flat arrays, slice by slice."""
    factors = _multipliers(values)
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            sets = part.column("shingles")
            flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(sets.offsets.to_numpy()).astype(np.int64)
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            low = np.zeros((len(sizes), values), np.uint16)
            if len(full):
                f1[full] = np.add.reduceat(_mix(flat), starts)
                f2[full] = np.add.reduceat(_mix(flat * factors[0] + MIX), starts)
                for k, a in enumerate(factors):
                    low[full, k] = _mix(np.minimum.reduceat(flat * a, starts)) >> np.uint64(48)
            bins = np.repeat(np.arange(len(sizes)), sizes) * (64 * SKETCH) + (_mix(flat + MIX) % np.uint64(64 * SKETCH)).astype(np.int64)
            odd = np.bincount(bins, minlength=len(sizes) * 64 * SKETCH).astype(np.uint8) & 1
            words = np.packbits(odd).view(np.int64).reshape(len(sizes), SKETCH)
            rows = [bytes(r) for r in low.view(np.uint8).reshape(len(sizes), -1)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("th"), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(rows, pa.binary()),
                 *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(SKETCH))],
                names=["id", "th", "n", "f1", "f2", "signature", *ODD])


def chunk_keys(batches: Iterator[pa.RecordBatch], values: int, chunk: int, errors: int) -> Iterator[pa.RecordBatch]:
    """(node, signature) to rows (key, node): one key per chunk and choice of left-out positions."""
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.slice(start, 20_000)
            nodes = part.column("node").to_numpy(zero_copy_only=False)
            low = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(len(nodes), values).astype(np.uint64)
            for first in range(0, values, chunk):
                for out in combinations(range(chunk), errors):
                    key = np.full(len(nodes), first * 1009 + sum(1 << p for p in out), np.uint64)
                    for p in set(range(chunk)) - set(out):
                        key = _mix(key ^ low[:, first + p]) * MIX
                    yield pa.RecordBatch.from_arrays([pa.array(_mix(key).view(np.int64)), pa.array(nodes)], names=["key", "node"])


def _possible(percent: int):
    """Whether two sets can be linked, by size and by the least difference that their sketches prove."""

    def holds(x: str, y: str) -> Column:
        differ = F.lit(0)
        for k in ODD:
            differ = differ + F.bit_count(F.col(x + k).bitwiseXOR(F.col(y + k)))
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))

    return holds


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept."""
    return near_texts(docs, id_col, text_col, shingle_words, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def near_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
) -> DataFrame:
    """Per row of ``docs``: id and th, which name a document as in keyed(), n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    hashed = docs.select("id", "th", word_shingles(F.col("text"), shingle_words).alias("shingles"))
    rows = cut_lineage(hashed.mapInArrow(
        lambda it: signatures(it, VALUES), "id long, th long, n long, f1 long, f2 long, signature binary, " + ", ".join(f"{k} long" for k in ODD)))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "th"))
    nodes = cut_lineage(
        rows.where("n > 0").groupBy("n", "f1", "f2").agg(
            F.min(named).alias("least"), F.first("signature").alias("signature"), *[F.first(k).alias(k) for k in ODD])
        .select("n", "f1", "f2", F.col("least.id").alias("id"), F.col("least.th").alias("th"), F.col("least.id").alias("node"), "signature", *ODD))
    # an id may have several texts: their nodes get numbers of their own
    shared = cut_lineage(nodes.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("several")))
    apart = not shared.isEmpty()
    if apart:
        nodes = cut_lineage(nodes.join(broadcast_if_small(shared), F.col("id") == F.col("several"), "left").withColumn(
            "node", F.when(F.col("several").isNotNull(), F.xxhash64("n", "f1", "f2")).otherwise(F.col("node"))).drop("several"))
    known = nodes.where("node is not null")
    features = known.select("node", "n", *ODD)
    possible = _possible(percent)
    members = known.select("node", "signature").mapInArrow(
        lambda it: chunk_keys(it, VALUES, CHUNK, ERRORS), "key long, node long")

    def confirm(pairs: DataFrame) -> DataFrame:
        x = features.toDF("a", *[f"x_{c}" for c in features.columns[1:]])
        y = features.toDF("b", *[f"y_{c}" for c in features.columns[1:]])
        close = pairs.join(x, "a").join(y, "b").where(possible("x_", "y_"))
        close = cut_lineage(close.select("a", "b").distinct())
        wanted = cut_lineage(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        wanted = cut_lineage(known.select("node", "id", "th").join(broadcast_if_small(wanted), "node"))
        sets = cut_lineage(
            docs.join(broadcast_if_small(wanted), ["id", "th"]).select("node", word_shingles(F.col("text"), shingle_words).alias("s")))
        left = sets.select(F.col("node").alias("a"), F.col("s").alias("a_s"))
        right = sets.select(F.col("node").alias("b"), F.col("s").alias("b_s"))
        shared = close.join(left, "a").join(right, "b").select(
            "a", "b", (F.size("a_s") + F.size("b_s")).alias("total"), F.size(F.array_intersect("a_s", "b_s")).alias("shared"))
        return cut_lineage(shared.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b").distinct())

    groups = linked_groups(shared_keys(members), confirm, features, possible)
    labels = nodes.select("n", "f1", "f2", "node", "id").join(groups, "node", "left").select(
        "n", "f1", "f2", "id", F.coalesce("component", "node").alias("component"))
    if apart:  # groups are named by the smallest id, not by the smallest number
        labels = cut_lineage(labels)
        names = labels.groupBy("component").agg(F.min("id").alias("name"))
        labels = labels.join(names, "component").select("n", "f1", "f2", F.col("name").alias("component"))
    labels = labels.select("n", "f1", "f2", "component")
    out = rows.select("id", "th", "n", "f1", "f2").join(labels, ["n", "f1", "f2"], "left").select(
        "id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

"""Connected groups from blocking keys, without the pairs of a group ever being listed.

A near-duplicate operator brings rows (key, node): nodes that share a key may be linked.  All
direct links of a key with n nodes would be n * n / 2 candidates; groups of copies make that
useless.  Only the groups matter, so a pair whose nodes are already known to be connected needs
no test.  First every node is tested against one centre of each of its keys (linear in the
rows; the centre differs from key to key, so that a dense group is tested from many sides), then
the nodes left outside the largest group of a key of three nodes or more are tested against the others of that key.
Every pair that shares a key is in the end tested or known to be connected: nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from foldloom.session import cut_lineage, release_shuffles

#: More alternations than any graph needs that fits a cluster (they grow with the log of its size).
MAX_ROUNDS = 60
#: Nodes of a key for each task that its open pairs are dealt to; most such tasks.
SALTED, SALTS = 200, 32


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Alternating large and small stars: neighbours are re-hung on the smallest neighbour until
    nothing moves.  A hub's rows are pre-aggregated for the minimum; the join that hands it back
    has one row per node on one side, so adaptive execution can split the other.
    """
    def written(rows: DataFrame) -> tuple[DataFrame, dict]:
        # counted while it is written, without a job of its own
        seen = Observation()
        return cut_lineage(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark"))), seen.get

    edges, mark = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if mark["n"] == 0:
            break
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges, mark = written(small.where("u <> v").distinct())
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows (key, node) of keys with two nodes or more, one key for each set of nodes; both uses read one exchange."""
    # said here as the join says it on its side only, which would make two exchanges of one
    dealt = keys.where("key is not null").repartition("key")
    sets = dealt.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"))
    kept = sets.where("n > 1").groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    return cut_lineage(dealt.join(kept.hint("shuffle_hash"), "key").select("key", "node"))


def linked_groups(
    members: DataFrame, confirm: Callable[[DataFrame], DataFrame], features: DataFrame, possible: Callable[[str, str], Column],
) -> DataFrame:
    """(node, component) of all nodes with a confirmed link; ``members`` are rows (key, node), longs.

    ``confirm`` takes distinct pairs (a, b), a < b, and returns those that are links.  ``features``
    has small columns for each node; ``possible(x, y)``, over those columns under the prefixes x
    and y, must hold for every link.  It keeps hopeless pairs from ever becoming rows.
    """
    mask = F.xxhash64("key")
    hidden = F.col("node").bitwiseXOR(mask)  # its minimum is another node for another key
    sets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(hidden).alias("lo")).where("n > 1")
    multi = cut_lineage(members.join(sets.select("key", F.col("n").alias("size"), F.col("lo").bitwiseXOR(mask).alias("centre")), "key"))
    star = cut_lineage(
        multi.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    first = cut_lineage(components(confirm(star)))

    release_shuffles(members.sparkSession)
    # the only pair of a key of two nodes has been tested
    labelled = cut_lineage(
        multi.where("size > 2").select("key", "node").distinct().join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")))
    parts = labelled.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(
        F.max_by("part", "n").alias("main"), F.count(F.lit(1)).alias("parts"),
        F.least(F.floor(F.sum("n") / SALTED), F.lit(SALTS - 1)).cast("int").alias("last")).where("parts > 1")
    mixed = cut_lineage(labelled.join(mixed.select("key", "main", "last"), "key").join(features, "node"))
    release_shuffles(members.sparkSession)
    names = [c for c in mixed.columns if c not in ("key", "main", "last")]
    # the nodes of a large key that are tested are dealt over tasks of their own, each with all that they are tested against
    left = mixed.where("part <> main").select(
        "key", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int").alias("salt"), *[F.col(c).alias(f"x_{c}") for c in names])
    right = mixed.select("key", F.explode(F.sequence(F.lit(0), "last")).alias("salt"), "main", *[F.col(c).alias(f"y_{c}") for c in names])
    open_pair = F.expr("x_part <> y_part and (y_part = main or x_node < y_node)")
    pairs = left.join(right, ["key", "salt"]).where(open_pair & possible("x_", "y_"))
    pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    pairs = cut_lineage(pairs.join(star, ["a", "b"], "left_anti"))
    release_shuffles(members.sparkSession)
    second = confirm(pairs)
    known = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.union(second.select("a", "b")))

"""Shards of near equal bytes by a minimax contiguous partition.

Equal texts form an atomic group and stay together.  Groups are ordered by the SHA-256 of their
text, so a shard is a range of digests and a document finds its shard from its own digest and the
few cuts between shards: nothing is joined back, and a group that holds a third of all rows costs
no more than another (its rows are counted before they are shuffled).

The capacity is the smallest one for which a greedy sweep over the ordered group sizes fills no
more than the given number of shards; a binary search finds it.  The driver never sees the groups.
It sees segments, runs of groups that share a digest prefix, at first ``16 ** START_DIGITS`` of
them.  A sweep that may cut segments anywhere bounds the capacity from below, one that cuts only
between segments bounds it from above, and only segments in which a cut may fall are asked for
their parts, until both bounds meet.  So the capacity is exact and the driver holds a few thousand
numbers whatever the table's size.

Cuts are then placed inside that capacity: every shard takes an even part of what is left (whole
groups up to that mark, one at least), or more where the rest would not fit the shards after it.  No shard exceeds the capacity; last shards stay empty only where the groups run out.

Defined results: null and empty texts have one byte and share a group; rows without an id are
dealt like others and come first among equal texts; repeated rows each get a slot of their own;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.session import cut_lineage

#: Hexadecimal digits of the first segments, and digits added when a segment is opened.
START_DIGITS, STEP_DIGITS = 3, 2
#: Segments opened by one job (twice the number of shards, where that is more).
OPEN_AT_ONCE = 64

#: (prefix, size, groups, largest group)
Segment = tuple[str, int, int, int]


class Segments:
    """Ordered segments and their running sizes; positions are sizes summed from the start."""

    def __init__(self, rows: Iterable[Segment]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(size for _, size, _, _ in self.rows))
        self.starts = [0, *self.ends]
        self.total = self.starts[-1]
        self.largest = max((most for *_, most in self.rows), default=0)

    def floor(self, at: int) -> int:
        """Last boundary at or before a position."""
        return self.starts[bisect_right(self.starts, at) - 1]

    def ceiling(self, at: int) -> int:
        return self.starts[bisect_left(self.starts, at)]

    def anywhere(self, at: int) -> int:
        """The position itself inside a segment of several groups, otherwise the last boundary."""
        return min(at, self.total) if self.across(at, at) else self.floor(at)

    def across(self, low: int, high: int) -> list[Segment]:
        """Segments of several groups that begin before ``high`` and end after ``low``."""
        found = self.rows[bisect_right(self.ends, low):bisect_left(self.starts, high)]
        return [s for s in found if s[2] > 1]


def sweep(total: int, capacity: int, shards: int, end: Callable[[int], int]) -> list[int]:
    """Greedy cuts: each shard reaches as far as its capacity allows."""
    cuts = [0]
    for _ in range(shards):
        cuts.append(min(end(cuts[-1] + capacity), total))
    return cuts


def least_capacity(segments: Segments, shards: int, end: Callable[[int], int]) -> int:
    """Binary search for the smallest capacity whose sweep takes everything."""
    low, high = max(segments.largest, -(-segments.total // shards)), segments.total
    while low < high:
        middle = (low + high) // 2
        if sweep(segments.total, middle, shards, end)[-1] == segments.total:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(segments: Segments, capacity: int, shards: int) -> tuple[list[int], set[Segment]]:
    """Cuts of even shards within a capacity, and the segments that would have to be opened to be sure of them."""
    unsure: set[Segment] = set()

    def floor(at: int) -> int:
        unsure.update(segments.across(at, at))
        return segments.floor(at)

    def ceiling(at: int) -> int:
        unsure.update(segments.across(at, at))
        return segments.ceiling(at)

    # needed[j]: the least position from which the shards after cut j hold the rest
    needed = [segments.total]
    for _ in range(shards - 1):
        needed.append(ceiling(max(needed[-1] - capacity, 0)))
    needed.reverse()
    cuts = [0]
    while len(cuts) < shards and cuts[-1] < segments.total:
        even = cuts[-1] + -(-(segments.total - cuts[-1]) // (shards - len(cuts) + 1))
        cuts.append(max(floor(even), ceiling(cuts[-1] + 1), needed[len(cuts) - 1]))
    return cuts[1:], unsure


def minimax_cuts(first: Iterable[Segment], shards: int, open_up: Callable[[list[str]], Iterable[Segment]]) -> tuple[int, list[str]]:
    """The least capacity, and the first digest prefix of every shard but the first (fewer where groups run out).

    ``open_up`` gives the parts of the segments with the given prefixes.
    """
    segments = Segments(first)

    def opened(chosen: Iterable[Segment]) -> Segments:
        names = sorted({s[0] for s in chosen})[:max(OPEN_AT_ONCE, 2 * shards)]
        return Segments([*(s for s in segments.rows if s[0] not in names), *open_up(names)])

    while True:
        low = least_capacity(segments, shards, segments.anywhere)
        capacity = least_capacity(segments, shards, segments.floor)
        if low == capacity:
            break
        # every cut of the least capacity lies between these two
        near, far = sweep(segments.total, low, shards, segments.floor), sweep(segments.total, capacity, shards, segments.anywhere)
        segments = opened(s for a, b in zip(near[1:-1], far[1:-1], strict=True) for s in segments.across(a, b))
    while True:
        cuts, unsure = even_cuts(segments, capacity, shards)
        if not unsure:
            break
        segments = opened(unsure)
    at = {start: row[0] for start, row in zip(segments.starts, segments.rows, strict=False)}
    return capacity, [at[c] for c in cuts if c < segments.total]


def _segments(groups: DataFrame, prefixes: list[str] | None) -> list[Segment]:
    """Sizes of digest prefixes, of all groups or of those under the given (longer) prefixes."""
    if prefixes is None:
        parts = groups.withColumn("prefix", F.substring("digest", 1, START_DIGITS))
    else:
        lengths = sorted({len(p) for p in prefixes})
        inside = {n: [p for p in prefixes if len(p) == n] for n in lengths}
        # ranges reach the scan; the table is sorted by digest inside its files
        spans = F.lit(False)
        part = F.lit(None).cast("string")
        for n in lengths:
            hit = F.substring("digest", 1, n).isin(inside[n])
            spans = spans | hit
            part = F.when(hit, F.substring("digest", 1, n + STEP_DIGITS)).otherwise(part)
        parts = groups.where(spans & F.col("digest").between(min(prefixes), max(prefixes) + "g")).withColumn("prefix", part)
    found = parts.groupBy("prefix").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    return [tuple(r) for r in found.collect()]


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", (F.octet_length("t") + F.lit(1)).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.sha2("t", 256).alias("digest"))
    # the mark tells repeated rows apart; it is written, so that a lost executor cannot change it
    rows = cut_lineage(rows.withColumn("mark", F.monotonically_increasing_id()))
    groups = cut_lineage(rows.groupBy("digest").agg(F.sum("size").alias("size")).sortWithinPartitions("digest"))
    _, cuts = minimax_cuts(_segments(groups, None), shards, lambda prefixes: _segments(groups, prefixes))
    shard = sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in cuts), F.lit(0))

    # slots: ranges of (digest, id) are sorted apart; a row's index inside its range follows from its position
    order = [F.col("digest"), F.col("id"), F.col("mark")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.select("id", "size", "text_crc32", shard.cast("int").alias("shard"), F.monotonically_increasing_id().alias("at")))
    counts = placed.groupBy(F.shiftright("at", 33).alias("part"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # at most one row per shard and range partition
    slots = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), ["part", "shard"])
    return slots.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

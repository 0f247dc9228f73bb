"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the tokens that a fixed mask selects from a stretch of text; tokens the
mask ignores may differ.  The two masks are chosen so that every window of 15 tokens in which at
most 3 are substituted holds at least one seed of one mask undisturbed (a test goes through all
cases).  Benchmark and document seeds meet in an equi-join; the alignments that hits point to are
verified: a leak is a window of ``WINDOW`` aligned tokens of which ``percent`` are equal.

Items shorter than the window are compared over their whole length and get two more, short masks
(the second for items of five tokens whose middle one is substituted).  Items of one or two tokens are no
passages: a document leaks one if it holds these tokens and no others.  Items without tokens match nothing.

The masks promise windows of which 80 % are equal; a smaller ``percent`` is refused.

Defined results: null or empty texts match nothing; a null item id is reported as null; rows
repeated in full are one document; extra columns are carried along, never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import broadcast_if_small, keyed, normal_words, on_document, same
from foldloom.session import cut_lineage

WINDOW = 15
#: Fixed masks: positions of the tokens that count.
MASKS = ((0, 3, 6, 7, 8), (0, 1, 2, 6, 8))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
#: For items of one and of two tokens.
TINY_MASKS = ((0,), (0, 1))
#: The least share of equal tokens that the masks find for certain.
LEAST_PERCENT = 80


def _hashed(text: Column) -> Column:
    return F.transform(normal_words(text), lambda w: F.xxhash64(w))


def _seeds(hashed: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """For every mask one hash per start position, all starts of a mask before those of the next.

    Each mask's run is as long as the array: starts beyond its end hash what is there, under a
    count of the tokens that tells them apart from whole seeds.
    """

    def run(h: Column, mask: tuple[int, ...]) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(
            F.lit(",".join(map(str, mask))), i + mask[-1] < F.size(h), x, *[F.get(h, i + k) for k in mask[1:]]))

    return F.flatten(F.transform(F.array(hashed), lambda h: F.concat(*[run(h, m) for m in masks])))


def _item_seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    out = items.select("item", F.size("tokens").alias("n"), F.posexplode(_seeds(F.col("tokens"), masks)).alias("k", "seed"))
    mask = (F.col("k") / F.col("n")).cast("int")
    spans = F.element_at(F.array(*[F.lit(m[-1]) for m in masks]), mask + 1)
    out = out.withColumn("at", F.col("k") % F.col("n"))
    return out.where(F.col("at") + spans < F.col("n")).select("seed", "item", "at").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", percent: int = 80,
) -> DataFrame:
    """(id, th, item_id, matched, window): per leaking document and item, the best window."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the masks find windows of at least {LEAST_PERCENT} percent")
    items = cut_lineage(
        benchmark.select(F.col(item_col).alias("item"), _hashed(F.col(item_text)).alias("tokens")).where(F.size("tokens") > 0).distinct())
    size, tiny = F.size("tokens"), len(SHORT_MASKS[0])
    kinds = [(size >= WINDOW, MASKS), (size.between(tiny, WINDOW - 1), (*MASKS, *SHORT_MASKS)),
             *[(size == n, TINY_MASKS[n - 1:n]) for n in range(1, tiny)]]
    has = items.agg(*[F.coalesce(F.bool_or(fits), F.lit(False)) for fits, _ in kinds]).first()
    # every seed is tagged by its mask, so one list of masks serves all kinds of items
    present = [kind for kind, there in zip(kinds, has, strict=True) if there] or kinds[:1]
    masks = tuple(dict.fromkeys(m for _, some in present for m in some))
    def tagged(fits: Column, some: tuple[tuple[int, ...], ...]) -> DataFrame:
        whole = F.lit(len(some[0]) if some[0] in TINY_MASKS else None).cast("int")  # the size of the document too
        return _item_seeds(items.where(fits), some).withColumn("whole", whole)

    seeds = reduce(DataFrame.union, [tagged(fits, some) for fits, some in present])
    seeds = cut_lineage(seeds)

    base = keyed(docs, id_col, text_col).select("id", "th", "text")
    hashed = base.select("id", "th", _hashed(F.col("text")).alias("tokens"))
    spread = hashed.select("id", "th", F.size("tokens").alias("n"), F.posexplode(_seeds(F.col("tokens"), masks)).alias("k", "seed"))
    hits = spread.join(broadcast_if_small(seeds), "seed").where("whole is null or whole = n").select(
        "id", "th", "item", (F.col("k") % F.col("n") - F.col("at")).alias("shift"))
    hits = cut_lineage(hits.distinct())

    found = cut_lineage(hits.select("id", "th").distinct())
    texts = cut_lineage(on_document(base, broadcast_if_small(found), "left_semi").dropDuplicates(["id", "th"])
                        .select("id", "th", _hashed(F.col("text")).alias("words")))
    lists = items.select(F.col("item").alias("r_item"), "tokens")
    aligned = on_document(hits, texts, "inner").join(
        broadcast_if_small(lists, F.size("tokens") * 8), same(F.col("item"), F.col("r_item")))
    # equal tokens along the alignment; positions outside the document count as different
    equal = F.transform("tokens", lambda t, i: F.when(
        (i + F.col("shift") >= 0) & (F.get("words", F.greatest(i + F.col("shift"), F.lit(0))) == t), 1).otherwise(0))
    width = F.least(F.size("tokens"), F.lit(WINDOW))
    aligned = aligned.select("id", "th", "item", width.alias("window"), equal.alias("equal"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("equal") - F.col("window") + 1),
        lambda j: F.aggregate(F.slice("equal", j, F.col("window")), F.lit(0), lambda a, x: a + x))
    best = aligned.select("id", "th", "item", "window", F.array_max(windows).alias("matched"))
    best = best.where(100 * F.col("matched") >= percent * F.col("window"))
    return best.groupBy("id", "th", F.col("item").alias("item_id")).agg(
        F.max("matched").alias("matched"), F.max("window").alias("window"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, columns unchanged."""
    bad = cut_lineage(leaks(docs, benchmark, id_col, text_col).select("id", "th").distinct())
    return on_document(keyed(docs, id_col, text_col), broadcast_if_small(bad), "left_anti").select("row.*")

"""Alignment of the tokens of two tokenizers over the same bytes.

Side A is a byte-level vocabulary of the tokenizers library and reads a space before the text; side
B is a sentencepiece model, which adds that space itself.  Both encode the full text; the bytes of
their tokens must spell it, otherwise the text has no tokens here.  Anchors are byte offsets where
both sides end a token and both next tokens begin with a space.  Between anchors lies a window,
mostly a word; what a window aligns to depends on its ids alone, so it is worked out once for a
pair of id tuples and remembered (``MEMO`` windows a worker, then the memory starts afresh).

A window gives groups, cut where both sides end a token, and links, the pairs of tokens that end
together.  The links of a document are written as packed pairs beside its counts.  How often each
pair is linked in the corpus is counted by Spark from sums that workers made batch by batch; a pair
is best if no other A id is linked more often to its B id.  The ``FREQUENT`` most frequent pairs go
to all workers as sorted arrays; rarer ones, if there are any, are joined by shuffle.  Every link
gets its exact count either way.

Defined results: null and empty texts, and texts that a vocabulary does not spell (normalised or
unknown characters), have zeros and an empty digest; every row gives one row, repeated ones too; a
null id stays null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import os
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import parts, prepare
from foldloom.session import cut_lineage

#: Windows that a worker remembers, and pairs that are sent to all workers.
MEMO, FREQUENT = 100_000, 1_000_000
#: Bytes of text handed to the libraries at once.
BATCH_BYTES = 200_000
#: A pair of ids is packed as ``a << B_BITS | b``.
B_BITS = 24
SPACE_MARK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = (*COUNTS, "n_best", "count_sum", "groups_sha256")


class Side:
    """Bytes of every token of a vocabulary, their number, and ids as text before each mark, by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = [len(t) for t in tokens]
        self.names = {mark: np.array([f"{k}{mark}" for k in range(len(tokens))], object) for mark in ",|;"}
        self.sizes = np.array(self.lengths, np.int32)
        self.spaced = np.array([t.startswith(b" ") for t in tokens], bool)
        self.hollow = 0 in self.lengths


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: visible Latin-1 letters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load_a(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_padding()
    library.no_truncation()
    letters, vocabulary = byte_letters(), library.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        known = all(c in letters for c in token)
        tokens[k] = bytes(letters[c] for c in token) if known else token.encode()
    return library, Side(tokens)


@lru_cache(maxsize=4)
def load_b(path: str):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [library.id_to_piece(k) for k in range(library.get_piece_size())]
    return library, Side([
        bytes([int(p[1:-1], 16)]) if library.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(pieces)])


Window = tuple[str, int, bytes]


def align_windows(windows: list[tuple[list[int], list[int]]], side_a: Side, side_b: Side) -> list[Window]:
    """Groups as text, their number, and packed links of windows whose two sides spell the same bytes.

    The windows are laid end to end and aligned at once: sides that spell the same bytes end together
    at every window's end.
    """
    if side_a.hollow or side_b.hollow:
        return [align_hollow(a, b, side_a, side_b) for a, b in windows]
    a, b = (np.array([k for w in windows for k in w[side]], np.int64) for side in (0, 1))
    ends_a, ends_b = np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b])
    marks = np.zeros(ends_a[-1] + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] |= 2
    last_a, last_b = marks[ends_a] == 3, marks[ends_b] == 3
    groups_a, groups_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups ended before each token
    # tokens in order of the text that shows them: those of a group's A side, then those of its B side
    shown = np.empty(len(a) + len(b), object)
    first_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
    shown[np.arange(len(a)) + first_b[groups_a]] = np.where(last_a, side_a.names["|"][a], side_a.names[","][a])
    shown[np.arange(len(b)) + np.flatnonzero(last_a)[groups_b] + 1] = np.where(last_b, side_b.names[";"][b], side_b.names[","][b])
    shown = shown.tolist()
    links = (a[last_a] << B_BITS | b[last_b]).tobytes()
    at_a = np.cumsum([0, *(len(w[0]) for w in windows)])
    at = (at_a + np.cumsum([0, *(len(w[1]) for w in windows)])).tolist()
    groups = [0, *np.cumsum(last_a)[at_a[1:] - 1].tolist()]
    return [
        ("".join(shown[x:y])[:-1], h - g, links[8 * g:8 * h]) for x, y, g, h in zip(at, at[1:], groups, groups[1:], strict=False)]


def align_hollow(a: list[int], b: list[int], side_a: Side, side_b: Side) -> Window:
    """The same of one window for vocabularies with tokens without bytes, which end where the token before them ends."""
    ends_a, ends_b = (np.cumsum([side.lengths[k] for k in ids]).tolist() for ids, side in ((a, side_a), (b, side_b)))
    groups, links, low_a, low_b = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        high_a, high_b = bisect_right(ends_a, end), bisect_right(ends_b, end)
        links += [x << B_BITS | y for x in a[bisect_left(ends_a, end):high_a] for y in b[bisect_left(ends_b, end):high_b]]
        groups.append(",".join(map(str, a[low_a:high_a])) + "|" + ",".join(map(str, b[low_b:high_b])))
        low_a, low_b = high_a, high_b
    return ";".join(groups), len(groups), array("q", links).tobytes()


class Aligner:
    """The two vocabularies of a worker and its remembered windows."""

    def __init__(self, path_a: str, path_b: str):
        self.library_a, self.a = load_a(path_a)
        self.library_b, self.b = load_b(path_b)
        # with every byte in the vocabulary and nothing normalised, bytes are merged but never changed: such a side spells every text
        letters = {k for k, t in enumerate(self.a.tokens) if len(t) == 1}
        self.lossless_a = self.library_a.normalizer is None and len({self.a.tokens[k] for k in letters}) == 256
        self.memo: dict[bytes, Window] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        a = self.library_a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.library_b.encode(texts, num_threads=1)
        return ((e.ids, f) for e, f in zip(a, b, strict=True))

    def spells(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = (" " + text).encode()
        return b"".join(map(self.b.tokens.__getitem__, b)) == whole and (
            self.lossless_a or b"".join(map(self.a.tokens.__getitem__, a)) == whole)

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First token of every window on either side, and the number of tokens as the last entry."""
        ends_a, ends_b = np.cumsum(self.a.sizes[a], dtype=np.int32), np.cumsum(self.b.sizes[b], dtype=np.int32)
        next_a, next_b = np.flatnonzero(self.a.spaced[a[1:]]), np.flatnonzero(self.b.spaced[b[1:]])
        before_a, before_b = ends_a[next_a], ends_b[next_b]
        marks = np.zeros(ends_a[-1] + 1, np.uint8)
        marks[before_a] = 1
        marks[before_b] |= 2
        return np.concatenate([[0], next_a[marks[before_a] == 3] + 1, [len(a)]]), np.concatenate([[0], next_b[marks[before_b] == 3] + 1, [len(b)]])

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, digest, links as packed 64-bit numbers) of each text.

        Texts that are spelled are laid end to end: each begins with a space on either side and has the
        same bytes on both, so its start is an anchor too.
        """
        none = (0, 0, 0, "", b"")
        out: list[tuple[int, int, int, str, bytes]] = []
        all_a: list[int] = []
        all_b: list[int] = []
        spelled = []
        for text, (a, b) in zip(texts, self.encode(texts), strict=True):
            if text and self.spells(text, a, b):
                spelled.append((len(out), len(a), len(b)))
                all_a += a
                all_b += b
            out.append(none)
        if not spelled:
            return out
        ids_a, ids_b = (np.frombuffer(array("I", ids), np.uint32) for ids in (all_a, all_b))
        cuts_a, cuts_b = self.windows(ids_a, ids_b)
        raw_a, raw_b = ids_a.tobytes(), (ids_b | np.uint32(1 << 31)).tobytes()  # the marks keep the two halves of a key apart
        at_a, at_b = ((4 * cuts).tolist() for cuts in (cuts_a, cuts_b))
        cuts_a, cuts_b = cuts_a.tolist(), cuts_b.tolist()
        keys = [raw_a[i:i_end] + raw_b[j:j_end] for i, i_end, j, j_end in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False)]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        found = list(map(memo.get, keys))
        new = list({keys[k]: k for k, known in enumerate(found) if known is None}.items())
        if new:
            windows = [(all_a[cuts_a[k]:cuts_a[k + 1]], all_b[cuts_b[k]:cuts_b[k + 1]]) for _, k in new]
            memo.update(zip([key for key, _ in new], align_windows(windows, self.a, self.b), strict=True))
            found = list(map(memo.get, keys))
        k = end = 0
        for place, n_a, n_b in spelled:
            end += n_a
            mine = found[k:(k := bisect_left(cuts_a, end))]
            shown, links = ";".join([f[0] for f in mine]), b"".join([f[2] for f in mine])
            out[place] = (n_a, n_b, sum([f[1] for f in mine]), hashlib.sha256(shown.encode()).hexdigest(), links)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def align_texts(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each part of a batch with the sums of its links."""
    tool = aligner(path_a, path_b)
    gc.disable()  # a pass makes no cycles, and collections would walk all remembered windows each time
    for batch in batches:
        for part in parts(batch, "text", BATCH_BYTES):
            rows = tool.align([t or "" for t in part.column("text").to_pylist()])
            flat = np.frombuffer(b"".join(links for *_, links in rows), np.int64)
            pairs, sums = np.unique(flat, return_counts=True)
            sizes = [len(links) // 8 for *_, links in rows]
            offsets = np.cumsum([0, *sizes, len(pairs)])
            none = pa.nulls(1)
            numbers = [[*(r[k] for r in rows), None] for k in range(3)] + [[*sizes, None]]
            yield pa.RecordBatch.from_pydict({
                "id": pa.concat_arrays([part.column("id"), none.cast(part.column("id").type)]),
                "row": pa.concat_arrays([part.column("row"), none.cast(pa.int64())]),
                **{name: pa.array(values, pa.int64()) for name, values in zip(COUNTS, numbers, strict=True)},
                "groups_sha256": pa.array([*(r[3] for r in rows), None], pa.string()),
                "links": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([flat, pairs]))),
                "sums": pa.ListArray.from_arrays(pa.array([*[0] * (len(rows) + 1), len(sums)], pa.int32()), pa.array(sums.astype(np.int64)))})
    gc.enable()


def look_up(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum of each row over the frequent pairs, and its links that are not among them."""
    pairs, counts, best = frequent.value
    for batch in batches:
        column = batch.column("links")
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
        known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
        ends = np.cumsum(lengths)

        def per_row(values: np.ndarray, ends=ends, lengths=lengths) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[ends] - total[ends - lengths]

        sums = per_row(np.where(known, counts[at], 0)) if len(pairs) else np.zeros(len(lengths), np.int64)
        bests = per_row(np.where(known, best[at], 0)) if len(pairs) else np.zeros(len(lengths), np.int64)
        left = np.concatenate([[0], np.cumsum(per_row((~known).astype(np.int64)))])
        kept = [batch.column(c) for c in ("id", "row", *COUNTS, "groups_sha256")]
        rare = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(flat[~known], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(bests.astype(np.int64)), pa.array(sums.astype(np.int64)), rare],
            names=["id", "row", *COUNTS, "groups_sha256", "n_best", "count_sum", "rare"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked pairs; best is 1 where no pair of the same B id is more frequent."""
    sums = aligned.where("row is null").select(F.explode(F.arrays_zip("links", "sums")).alias("x"))
    counts = sums.groupBy(F.col("x.links").alias("pair")).agg(F.sum("x.sums").alias("n"))
    counts = cut_lineage(counts.withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return cut_lineage(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the RESULT columns."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    numbers = ", ".join(f"{n} long" for n in COUNTS)
    aligned = cut_lineage(base.mapInArrow(
        lambda it: align_texts(it, path_a, path_b),
        f"id {kind}, row long, {numbers}, groups_sha256 string, links array<long>, sums array<long>"))
    counts = pair_counts(aligned)
    rows = aligned.where("row is not null").select("id", "row", *COUNTS, "groups_sha256", "links")
    if counts.count() <= FREQUENT:
        top, all_known = counts, True
    else:
        top, all_known = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT), False
    sent = top.toArrow()
    pairs = sent.column("pair").to_numpy()
    order = np.argsort(pairs)
    frequent = spark.sparkContext.broadcast((pairs[order], sent.column("n").to_numpy()[order], sent.column("best").to_numpy()[order].astype(np.int64)))
    found = rows.mapInArrow(
        lambda it: look_up(it, frequent),
        f"id {kind}, row long, {numbers}, groups_sha256 string, n_best long, count_sum long, rare array<long>")
    if not all_known:
        found = cut_lineage(found)
        rare = found.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
        extra = rare.join(counts, "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best")).alias("more_best"))
        found = found.join(extra, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select(F.col("id").alias(id_col), *RESULT)

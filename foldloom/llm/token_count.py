"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts up to ``HUGE`` characters are encoded whole, in Arrow batches.  Longer ones are cut into
chunks that overlap; the chunks are encoded in parallel and spliced at word boundaries that both
sides of an overlap agree on.  Such a boundary is proven: the splitting pattern looks at no text
before a match, so the split from a boundary on depends on the following text only; a boundary of
the left chunk is a true one unless it lies within ``margin`` characters of that chunk's end
(where a word or a special token may be cut off), and where the right chunk has a boundary at the
same place, away from its own start, it splits the rest as the whole text does.  Texts without an
agreed boundary in some overlap are tried again with overlaps four times as wide, at last as one
chunk.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row gives one row, repeated
ones too; a null id stays null; extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foldloom.llm.common import parts, prepare, texts_of
from foldloom.session import cut_lineage

HUGE, STRIDE, OVERLAP = 65_536, 32_768, 512
#: Bytes of text handed to the library at once.
BATCH_BYTES = 200_000
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def count_whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    library = tokenizer(path)
    for batch in batches:
        counts = []
        for part in parts(batch, "text", BATCH_BYTES):
            counts += [len(e) for e in library.encode_batch_fast(texts_of(part), add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def boundaries(library, piece: str) -> tuple[list[int], list[int], int]:
    """Offsets of the words of a piece, the tokens before each, and all its tokens."""
    encoded = library.encode(piece, add_special_tokens=False)
    at, before, last = [], [], -1
    for k, (word, (start, _)) in enumerate(zip(encoded.word_ids, encoded.offsets, strict=True)):
        if word is None or word != last:
            at.append(start)
            before.append(k)
        last = word
    return at, before, len(encoded)


def count_chunks(batches: Iterator[pa.RecordBatch], path: str, overlap: int, margin: int) -> Iterator[pa.RecordBatch]:
    """Per chunk: tokens, and the boundaries with the tokens before them in its two overlaps."""
    library = tokenizer(path)
    for batch in batches:
        out = {name: [] for name in ("tokens", "left_at", "left_n", "right_at", "right_n")}
        for piece, start in zip(batch.column("piece").to_pylist(), batch.column("start").to_pylist(), strict=True):
            at, before, tokens = boundaries(library, piece)
            zones = ((margin, overlap - margin), (len(piece) - overlap + margin, len(piece) - margin))
            for side, (low, high) in zip(("left", "right"), zones, strict=True):
                found = [(start + p, n) for p, n in zip(at, before, strict=True) if low <= p <= high]
                out[f"{side}_at"].append([p for p, _ in found])
                out[f"{side}_n"].append([n for _, n in found])
            out["tokens"].append(tokens)
        columns = [pa.array(out["tokens"], pa.int64()), *(pa.array(out[k], pa.list_(pa.int64())) for k in list(out)[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("i"), *columns], names=["sha", "i", *out])


def splice(texts: DataFrame, path: str, stride: int, overlap: int, margin: int) -> DataFrame:
    """(sha, n_tokens) of distinct huge texts (sha, text); null where an overlap has no agreed boundary."""
    pieces = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / stride).cast("int"))
    chunks = texts.select("sha", "text", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("i"))
    chunks = chunks.select("sha", "i", (F.col("i") * stride).alias("start"), F.substr("text", F.col("i") * stride + 1, F.lit(stride + overlap)).alias("piece"))
    counted = chunks.repartition("sha", "i").mapInArrow(
        lambda it: count_chunks(it, path, overlap, margin),
        "sha string, i int, tokens long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")
    order = W.partitionBy("sha").orderBy("i")
    joined = counted.select("*", F.lag("right_at").over(order).alias("prev_at"), F.lag("right_n").over(order).alias("prev_n"))
    meet = F.array_min(F.array_intersect("prev_at", "left_at"))
    joined = joined.withColumn("p", meet)
    own = F.element_at("left_n", F.array_position("left_at", F.col("p")).cast("int"))
    theirs = F.element_at("prev_n", F.array_position("prev_at", F.col("p")).cast("int"))
    # a chunk adds its tokens less those before the splice; the one before it loses those after
    lead = joined.select("sha", "i", "tokens", own.alias("own"), theirs.alias("theirs"), F.lead("tokens", -1).over(order).alias("prev_tokens"))
    part = F.when(F.col("i") == 0, F.col("tokens")).otherwise(F.col("tokens") - F.col("own") - (F.col("prev_tokens") - F.col("theirs")))
    sums = lead.groupBy("sha").agg(F.sum(part).alias("n_tokens"), F.bool_and((F.col("i") == 0) | F.col("own").isNotNull()).alias("agreed"))
    return sums.select("sha", F.when(F.col("agreed"), F.col("n_tokens")).alias("n_tokens"))


def token_counts(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
    huge: int = HUGE, stride: int = STRIDE, overlap: int = OVERLAP,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit."""
    prepare(docs.sparkSession)
    margin = 1 + max((len(t.content) for t in tokenizer(path).get_added_tokens_decoder().values()), default=0)
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = base.schema["id"].dataType.simpleString()
    small = base.where(F.length("text") <= huge).mapInArrow(
        lambda it: count_whole(it, path), f"id {id_type}, n_bytes long, n_tokens long")

    large = base.where(F.length("text") > huge).withColumn("sha", F.sha2("text", 256))
    left = cut_lineage(large.select("sha", "text").dropDuplicates(["sha"]))
    done = None
    while left.limit(1).count():
        margin_now = min(margin, overlap // 4)
        counts = cut_lineage(splice(left, path, stride, overlap, margin_now))
        found = counts.where("n_tokens is not null")
        done = found if done is None else done.union(found)
        left = cut_lineage(left.join(counts.where("n_tokens is null"), "sha", "left_semi"))
        overlap *= 4
        stride = max(stride, 2 * overlap)
    out = small
    if done is not None:
        out = out.union(large.select("id", "n_bytes", "sha").join(done, "sha").select("id", "n_bytes", "n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""BPE encoding and decoding through a table of distinct words.

The tokenizer splits texts into words and merges inside words only, so a word's ids do not depend
on its place.  Texts are split in Spark tasks, words are counted (pre-aggregated per task) and
every distinct word is encoded once.  Ids return to their positions in two ways: the ``HOT_WORDS``
most frequent words, which cover nearly all positions and would make the join skewed, go to all
tasks as a table of bounded size; the remaining words of a chunk of documents are joined by
shuffle.  The documents themselves move once, as compressed numbers of their words.  Decoding
joins ids with the id-to-piece table, whose size the vocabulary fixes.

Defined results: null and empty texts have no ids and decode to an empty text; every row gives
one row, repeated ones too; null ids stay null; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import parts, prepare, texts_of
from foldloom.llm.token_count import tokenizer
from foldloom.session import cut_lineage

#: Bound of the table that all tasks hold: words, and bytes of one of them.
HOT_WORDS, HOT_BYTES = 300_000, 48
#: Bytes of text in one chunk; distinct runs held before a flush; runs whose words a worker remembers.
CHUNK_BYTES, FLUSH_WORDS, KNOWN_RUNS = 2_000_000, 300_000, 150_000
#: The tokenizer's own splitting pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WHITE, SEPARATORS = regex.compile(r"\p{White_Space}+"), regex.compile("[\x1c-\x1f]")
_RULES: dict[str, "Splitter"] = {}


class Splitter:
    """Texts to words as the tokenizer of a file splits them, special tokens among them.

    No word crosses white space, so it is enough to split each distinct run of other characters.
    """

    def __init__(self, path: str):
        special = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[str, ...]] = {}

    def runs(self, text: str) -> list[str]:
        # str.split also parts at four separators that are no white space to the tokenizer
        return WHITE.split(text) if SEPARATORS.search(text) else text.split()

    def _plain(self, run: str) -> list[str]:
        # letter by letter: a final sigma is lowered like any other
        return self.words(unicodedata.normalize("NFC", run).replace("\u03a3", "\u03c3").lower())

    def split(self, run: str) -> tuple[str, ...]:
        found = self.known.get(run)
        if found is None:
            if self.special is None or "<" not in run:
                found = tuple(self._plain(run))
            else:
                found = tuple(w for k, part in enumerate(self.special.split(run)) for w in ([part] if k % 2 else self._plain(part)))
            if len(self.known) < KNOWN_RUNS:
                self.known[run] = found
        return found


def splitter(path: str) -> Splitter:
    """One per worker process."""
    if path not in _RULES:
        _RULES[path] = Splitter(path)
    return _RULES[path]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows, CHUNK_BYTES or one text at most."""
    for batch in batches:
        for part in parts(batch, "text", CHUNK_BYTES):
            yield part.column("id").to_pylist(), texts_of(part)


def count_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    rules, seen = splitter(path), Counter()

    def flush() -> pa.RecordBatch:
        words: dict[str, int] = {}
        for run, n in seen.items():
            for w in rules.split(run):
                words[w] = words.get(w, 0) + n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    for _, texts in _chunks(batches):
        for text in texts:
            seen.update(rules.runs(text))
        if len(seen) > FLUSH_WORDS:
            yield flush()
    yield flush()


def encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    library = tokenizer(path)
    for batch in batches:
        ids: list[list[int]] = []
        for part in parts(batch, "word", 50_000):
            ids += [e.ids for e in library.encode_batch_fast(part.column("word").to_pylist(), add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])


def _numbered(ids: list, texts: list[str], rules: Splitter, known: dict[str, int]) -> tuple[int, list[list[str]], dict[str, tuple[int, ...]], list[str]]:
    """(chunk, runs of each text, word numbers of each distinct run, rarer words); the rarer ones are numbered behind the known."""
    mark = hashlib.blake2b(repr(ids).encode(), digest_size=8)
    runs = []
    for text in texts:
        mark.update(text.encode("utf-8", "surrogatepass"))
        runs.append(rules.runs(text))
    rare: dict[str, int] = {}
    numbers = {}
    for run in dict.fromkeys(r for t in runs for r in t):
        found = []
        for w in rules.split(run):
            n = known.get(w)
            found.append(len(known) + rare.setdefault(w, len(rare)) if n is None else n)
        numbers[run] = tuple(found)
    return int.from_bytes(mark.digest(), "little", signed=True), runs, numbers, list(rare)


def rare_words(batches: Iterator[pa.RecordBatch], path: str, hot) -> Iterator[pa.RecordBatch]:
    """Rows (owner, k, word): each of the rarer words of a chunk of documents once, with its number."""
    rules, known = splitter(path), hot.value[0]
    for ids, texts in _chunks(batches):
        chunk, _, _, rare = _numbered(ids, texts, rules, known)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(rare), pa.int64()), pa.array(range(len(rare)), pa.int32()), pa.array(rare, pa.string())],
            names=["owner", "k", "word"])


def pack(batches: Iterator[pa.RecordBatch], path: str, hot) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, ids, sizes, payload): the word numbers of the documents of a chunk, byte by byte and compressed."""
    rules, known, codec = splitter(path), hot.value[0], pa.Codec("zstd", 3)
    for ids, texts in _chunks(batches):
        chunk, runs, numbers, _ = _numbered(ids, texts, rules, known)
        flat = [list(chain.from_iterable(map(numbers.__getitem__, r))) for r in runs]
        planes = np.fromiter(chain.from_iterable(flat), np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, flat))], pa.list_(pa.int32())),
             pa.array([codec.compress(planes, asbytes=True)], pa.binary())],
            names=["chunk", "ids", "sizes", "payload"])


def digest(chunks: pd.DataFrame, rare: pd.DataFrame, hot) -> pd.DataFrame:
    """The result rows of the documents of one chunk."""
    _, ids_of, pieces_of, vocabulary = hot.value
    own = rare.sort_values("k")["ids"].tolist()
    ids_of = ids_of + own
    pieces_of = pieces_of + [" ".join([vocabulary[i] for i in map(int, x.split())]) for x in own]
    counts = np.fromiter((x.count(" ") + 1 for x in ids_of), np.int64, len(ids_of))
    out = []
    codec = pa.Codec("zstd")
    for row in chunks.itertuples():
        total = int(sum(row.sizes))
        planes = codec.decompress(row.payload, decompressed_size=4 * total, asbytes=True) if total else b""
        numbers = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        ends = np.cumsum(row.sizes)
        for key, size, end in zip(row.ids, row.sizes, ends, strict=True):
            part = numbers[end - size:end]
            at = part.tolist()
            out.append((
                key, int(counts[part].sum()), hashlib.sha256(" ".join([ids_of[i] for i in at]).encode()).hexdigest(),
                hashlib.sha256(" ".join([pieces_of[i] for i in at]).encode()).hexdigest()))
    frame = pd.DataFrame(out, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return frame.astype({"id": "Int64"})


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of every distinct word."""
    words = texts.mapInArrow(lambda it: count_words(it, path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(lambda it: encode_words(it, path), "word string, n long, ids array<int>")


def decoded(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """Words (word, ids) to (word, ids, pieces): ids joined with the id-to-piece table, in order, as texts."""
    one = words.select("word", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    lists = one.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "piece"))).alias("x"))
    return lists.select("word", F.array_join(F.col("x.id").cast("array<string>"), " ").alias("ids"), F.array_join("x.piece", " ").alias("pieces"))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = cut_lineage(word_table(base, path))
    vocabulary = {i: p for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
    pieces = spark.createDataFrame(sorted(vocabulary.items()), "id int, piece string")
    top = words.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(HOT_WORDS)
    rows = decoded(top.select("word", "ids"), pieces).toArrow()
    found = {name: rows.column(name).to_pylist() for name in rows.column_names}
    hot = spark.sparkContext.broadcast(
        ({w: k for k, w in enumerate(found["word"])}, found["ids"], found["pieces"], vocabulary))

    rare = base.mapInArrow(lambda it: rare_words(it, path, hot), "owner long, k int, word string").distinct()
    table = words.select("word", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
    rare = rare.join(table, "word").select("owner", "k", "ids")
    packed = base.mapInArrow(lambda it: pack(it, path, hot), "chunk long, ids array<long>, sizes array<int>, payload binary")
    out = packed.groupBy("chunk").cogroup(rare.groupBy("owner")).applyInPandas(
        lambda c, r: digest(c, r, hot), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

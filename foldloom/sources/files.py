"""Reading structure files: path search, compression by magic bytes, lines in order."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name variants tried for every path, and the compressed forms of each.
NAME_VARIANTS = ("{}", "{}.pdb", "{}.ent", "pdb{}.ent")
COMPRESSED = ("", ".Z", ".gz")
GZIP_MAGIC, LZW_MAGIC = b"\x1f\x8b", b"\x1f\x9d"


def candidate_paths(name: str, search: Sequence[str] = (), mirror: str | None = None) -> Iterator[str]:
    """Places where a structure may be: as given, in the search folders, in a divided mirror.

    The mirror keeps files in folders named after the two middle characters of a four-letter entry.
    """
    folder, base = os.path.split(name)

    def variants(root: str) -> Iterator[str]:
        for form in NAME_VARIANTS:
            for suffix in COMPRESSED:
                yield os.path.join(root, form.format(base) + suffix)

    yield from variants(folder)
    if not os.path.isabs(name):
        for root in search:
            yield from variants(os.path.join(root, folder))
    entry = base[3:] if len(base) == 7 and base.lower().startswith("pdb") else base
    if mirror and not folder and len(entry) == 4:
        root = os.path.join(mirror, entry[1:3].lower())
        base = entry.lower()
        yield from variants(root)


def resolve_path(name: str, search: Sequence[str] = (), mirror: str | None = None) -> str | None:
    """First existing candidate.  Only names pass through the driver, never contents."""
    return next((p for p in candidate_paths(name, search, mirror) if os.path.isfile(p)), None)


def expand_lzw(data: bytes) -> bytes:
    """Decode a ``.Z`` file: variable-width codes of 9 to 16 bits, packed in groups of eight."""
    top, block_mode = data[2] & 0x1F, bool(data[2] & 0x80)
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b""] * block_mode
    width, out, previous = 9, [], b""
    at, end = 24, len(data) * 8
    group = at

    def realign() -> int:
        # The writer pads every change of width to a multiple of eight codes.
        size = width * 8
        return group + -(-(at - group) // size) * size

    while at + width <= end:
        first = at >> 3
        code = int.from_bytes(data[first:first + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if block_mode and code == 256:
            at = realign()
            table, width, previous = table[:257], 9, b""
            group = at
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(entry)
        if previous and len(table) < 1 << top:
            table.append(previous + entry[:1])
        previous = entry
        if len(table) == 1 << width and width < top:
            at = realign()
            width += 1
            group = at
    return b"".join(out)


def decompress(data: bytes) -> bytes:
    """Undo nested compression, whatever the file is called."""
    while True:
        if data[:2] == GZIP_MAGIC:
            data = gzip.decompress(data)
        elif data[:2] == LZW_MAGIC:
            data = expand_lzw(data)
        else:
            return data


@F.pandas_udf(T.BinaryType())
def decompressed(content: pd.Series) -> pd.Series:
    return content.map(decompress)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of structure files (path, line_no, line); CR and LF both end a line, empty lines go."""
    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    magic = F.hex(F.substring("content", 1, 2))
    plain = files.select("path", F.when(magic.isin("1F8B", "1F9D"), decompressed("content")).otherwise(
        F.col("content")).alias("content"))
    return split_lines(plain.select("path", F.decode("content", "ISO-8859-1").alias("text")))


def split_lines(texts: DataFrame) -> DataFrame:
    """(path, text) to (path, line_no, line)."""
    return texts.select("path", F.posexplode(F.split("text", "[\r\n]+")).alias("line_no", "line")).where("length(line) > 0")

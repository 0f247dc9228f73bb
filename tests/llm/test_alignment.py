"""Cross-tokenizer alignment against a plain program over offsets."""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from foldloom.llm import token_alignment
from foldloom.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, id string, row int, links string, pair int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ("i", 1, "l", 2)
ODD = [
    None, "", " ", "  two", "don't ünï <|endoftext|> x</s>y<s> <unk>", "a" * 3000, "word \n\n\t  gap " * 400, "日本語 🙂 é́ ΣΑΣ", "▁mark", "a▁b", "ﬁ ½ 　x",
    "\x00\x01 \r\n", "🙂" * 50, "long text. " * 40_000]


def plain(texts: list[str | None]) -> list[tuple]:
    """Links by looking at every byte offset; byte-level letters from the library's own decoder."""
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    vocabulary = {k: t for t, k in library.get_vocab().items()}
    letters = {c: bytes([b]) for b in range(256) for c in [token_letter(b)]}
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        bytes_a = [b"".join(letters[c] for c in vocabulary[k]) for k in a]
        bytes_b = []
        for k in b:
            p = model.id_to_piece(k)
            bytes_b.append(bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode())
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(None)
            continue
        ends = []
        for side in (bytes_a, bytes_b):
            at, found = 0, {}
            for k, t in enumerate(side):
                at += len(t)
                found[at] = k
            ends.append(found)
        links, groups, i, j = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][at], ends[1][at]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i:x + 1])) + "|" + ",".join(map(str, b[j:y + 1])))
            i, j = x + 1, y + 1
        docs.append((len(a), len(b), groups, links))
    counts = Counter(p for d in docs if d for p in d[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else
        (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == most[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
        for d in docs]


def token_letter(byte: int) -> str:
    """The letter of a byte, found by decoding: every letter of the alphabet stands for one byte."""
    if not LETTERS:
        from tokenizers.pre_tokenizers import ByteLevel as Split

        for c in Split.alphabet():
            LETTERS[token_alignment.byte_letters()[c]] = c
        decoded = {c: ByteLevel().decode([c]) for c in LETTERS.values()}
        assert all(decoded[LETTERS[b]] == chr(b) for b in range(128)) and len(LETTERS) == 256
    return LETTERS[byte]


LETTERS: dict[int, str] = {}


@pytest.mark.parametrize("frequent", [1_000_000, 40, 0])
def test_alignment(spark, monkeypatch, frequent):
    """All pairs known to the workers, most joined by shuffle, all joined; a memory that starts afresh often."""
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    monkeypatch.setattr(token_alignment, "MEMO", 500)
    texts = [r.text for r in table(spark, SF, "documents").select("text").limit(60).collect()] + ODD
    rows = [(k, t, *EXTRA) for k, t in enumerate(texts)] + [(None, "one two", *EXTRA), (0, texts[0], *EXTRA)]
    out = token_alignment.align_tokenizers(spark.createDataFrame(rows, DOCS).repartition(6), A, B).collect()
    assert out[0].__fields__ == ["doc_id", *token_alignment.RESULT]
    expected = plain([t for _, t, *_ in rows])
    assert sorted((r.doc_id is None, *[x or 0 for x in r[:1]], *r[1:]) for r in out) == sorted(
        (i is None, i or 0, *e) for (i, *_), e in zip(rows, expected, strict=True))


def test_no_rows_and_no_tokens(spark):
    assert token_alignment.align_tokenizers(spark.createDataFrame([], DOCS), A, B).collect() == []
    out = token_alignment.align_tokenizers(spark.createDataFrame([(1, None, *EXTRA), (2, "▁", *EXTRA)], DOCS), A, B).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_windows_split_nothing():
    """A document cut at its anchors aligns as the whole does, also among others."""
    tool = token_alignment.Aligner(A, B)
    texts = ["the cat sat", "", "  gaps   and\n lines", "▁", "naïve 日本 x y"]
    for (n_a, n_b, n_groups, sha, links), (a, b), text in zip(tool.align(texts), list(tool.encode(texts)), texts, strict=True):
        if text in ("", "▁"):
            assert (n_a, n_b, n_groups, sha, links) == (0, 0, 0, "", b"")
            continue
        [whole] = token_alignment.align_windows([(a, b)], tool.a, tool.b)
        assert (n_a, n_b, n_groups, links) == (len(a), len(b), whole[1], whole[2]) and sha == hashlib.sha256(whole[0].encode()).hexdigest()
        assert whole == token_alignment.align_hollow(a, b, tool.a, tool.b)
    assert len(tool.memo) > 6


def test_tokens_without_bytes():
    """They end where the token before them ends and are linked there too."""
    side_a, side_b = token_alignment.Side([b"ab", b"", b"c"]), token_alignment.Side([b"a", b"b", b"c", b""])
    groups, n, links = token_alignment.align_windows([([0, 1, 2], [0, 1, 3, 2])], side_a, side_b)[0]
    pairs = [(x >> token_alignment.B_BITS, x & (1 << token_alignment.B_BITS) - 1) for x in array("q", links)]
    assert (groups, n) == ("0,1|0,1,3;2|2", 2) and pairs == [(0, 1), (0, 3), (1, 1), (1, 3), (2, 2)]

"""Structure files, compression, sequence reconciliation, job lists and selectors."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from foldloom.sources import files, jobs, pdb


def atom(serial, name, res, chain, num, x, icode=" ", alt=" ", rec="ATOM  ", tail="  1.00 20.00           C  "):
    return f"{rec:6s}{serial:5d} {name:4s}{alt}{res:3s} {chain}{num:4d}{icode}   {x:8.3f}{x + 1:8.3f}{x + 2:8.3f}{tail}"


def lines_of(spark, texts: dict[str, str]):
    return files.split_lines(spark.createDataFrame(list(texts.items()), "path string, text string"))


def lzw(data: bytes, top: int = 16) -> bytes:
    """A straightforward packer for the tests."""
    table, width, codes = {bytes([i]): i for i in range(256)}, 9, []
    size, word = 257, b""
    groups, current = [], []
    for k in range(len(data)):
        symbol = data[k:k + 1]
        if word + symbol in table:
            word += symbol
            continue
        current.append(table[word])
        if size < 1 << top:
            table[word + symbol] = size
            size += 1
            if size - 1 == 1 << width and width < top:
                groups.append((width, current))
                width, current = width + 1, []
        word = symbol
    if word:
        current.append(table[word])
    groups.append((width, current))
    out = bytearray(b"\x1f\x9d" + bytes([0x80 | top]))
    for n, (bits, codes) in enumerate(groups):
        if n < len(groups) - 1:
            codes = codes + [0] * (-len(codes) % 8)
        value = sum(c << (bits * i) for i, c in enumerate(codes))
        out += value.to_bytes((bits * len(codes) + 7) // 8, "little")
    return bytes(out)


@pytest.mark.parametrize("data", [b"", b"a", b"abababababab" * 50, bytes(range(256)) * 40, zlib.compress(b"x" * 9) * 700])
def test_lzw_round_trip(data):
    assert files.expand_lzw(lzw(data)) == data


def test_nested_compression_and_members():
    text = b"ATOM\n" * 500
    assert files.decompress(gzip.compress(lzw(text))) == text
    assert files.decompress(gzip.compress(text) + gzip.compress(b"more")) == text + b"more"
    assert files.decompress(text) == text


def test_files_are_read_whatever_their_compression(spark, tmp_path):
    text = "\r\n".join(atom(i, " CA ", "ALA", "A", i, float(i)) for i in range(1, 4)) + "\r\n\r\nEND\r"
    (tmp_path / "a.pdb").write_bytes(text.encode())
    (tmp_path / "b.ent.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.pdb.Z").write_bytes(lzw(text.encode()))
    counts = files.read_lines(spark, str(tmp_path)).groupBy("path").count().collect()
    assert len(counts) == 3 and all(r["count"] == 4 for r in counts)


def test_path_search(tmp_path):
    (tmp_path / "ab").mkdir()
    for name in ("1abc.pdb.gz", "pdb2xyz.ent"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "ab" / "pdb9abz.ent.Z").write_bytes(b"x")
    assert files.resolve_path(str(tmp_path / "1abc")).endswith("1abc.pdb.gz")
    assert files.resolve_path("2xyz", [str(tmp_path)]).endswith("pdb2xyz.ent")
    assert files.resolve_path("9abz", mirror=str(tmp_path)).endswith("pdb9abz.ent.Z")
    assert files.resolve_path("nothing", [str(tmp_path)]) is None


def test_atoms_models_ter_and_bad_lines(spark):
    text = "\n".join([
        "MODEL        1", atom(1, " N  ", "ALA", "A", 1, 1.0), atom(2, " CA ", "ALA", "A", 1, 2.0, alt="A"), atom(3, " CA ", "ALA", "A", 1, 3.0, alt="B"),
        atom(4, " CA ", "GLY", "A", 1, 4.0, icode="B"), "TER       5      GLY A   1B", atom(6, " CA ", "HOH", "A", 9, 5.0, rec="HETATM"),
        atom(7, " CA ", "ALA", "b", 1, 6.0)[:53], atom(8, " CA ", "ALA", "b", 2, 7.0), atom(9, " CA ", "ALA", "b", 3, 8.0).replace("   8.000", "   x.yyy"),
        "ENDMDL", "MODEL        2", atom(1, " CA ", "ALA", "A", 1, 9.0)])
    lines = lines_of(spark, {"f": text})
    got = pdb.atoms(lines).orderBy("model_ord", "chain_id", "line_no").collect()
    assert [(r.model_no, r.chain_id, r.serial) for r in got] == [(1, "A", 1), (1, "A", 2), (1, "A", 3), (1, "A", 4), (1, "b", 8), (2, "A", 1)]
    rows = pdb.residues(lines).orderBy("model_ord", "chain_id", "res_idx").collect()
    assert [(r.chain_id, r.res_num, r.ins_code, r.x, r.letter) for r in rows] == [
        ("A", 1, " ", 2.0, "A"), ("A", 1, "B", 4.0, "G"), ("b", 2, " ", 7.0, "A"), ("A", 1, " ", 9.0, "A")]


def test_hetero_ends_are_trimmed_and_hetero_chains_dropped(spark):
    text = "\n".join([
        atom(1, " O  ", "HOH", "A", 1, 1.0, rec="HETATM"), atom(2, " CA ", "ALA", "A", 2, 2.0), atom(3, " CA ", "MSE", "A", 3, 3.0, rec="HETATM"),
        atom(4, " O  ", "HOH", "A", 4, 4.0, rec="HETATM"), atom(5, " CA ", "MSE", "B", 1, 5.0, rec="HETATM")])
    rows = pdb.residues(lines_of(spark, {"f": text})).orderBy("chain_id", "res_idx").collect()
    assert [(r.chain_id, r.res_name) for r in rows] == [("A", "ALA"), ("A", "MSE")]


def test_sequence_completes_atoms(spark):
    seq = "SEQRES   1 A    6  MET ALA GLY SER THR VAL"
    atoms = [atom(i, " CA ", n, "A", num, float(num)) for i, (n, num) in enumerate([("ALA", 2), ("GLY", 3), ("VAL", 6)])]
    rows = pdb.residues(lines_of(spark, {"f": "\n".join([seq, *atoms])})).orderBy("res_idx").collect()
    assert [(r.res_name, r.res_num, r.x is None) for r in rows] == [
        ("MET", 1, True), ("ALA", 2, False), ("GLY", 3, False), ("SER", 4, True), ("THR", 5, True), ("VAL", 6, False)]
    alien = pdb.residues(lines_of(spark, {"f": "\n".join(["SEQRES   1 A    2  TRP TRP", *atoms])})).collect()
    assert len(alien) == 3


def test_sequence_alignment_rules():
    assert pdb.align_to_sequence(["A", "B", "C"], [1, 2, 3], ["A", "X", "B", "C"]) == [(0, 0), (1, 2), (2, 3)]
    assert pdb.align_to_sequence(["A", "Q", "C"], [1, 2, 3], ["A", "B", "C"]) == [(0, 0), (2, 2)]
    assert pdb.align_to_sequence(["A"], [1], ["A"]) is None
    numbers, codes = pdb.number_missing([None, 5, None, None, 6, None], [" "] * 6)
    assert numbers == [4, 5, 6, 6, 6, 7] and codes[2:4] == ["Y", "Z"]


def test_annotations_and_headers(spark):
    atoms = [atom(i, " CA ", "ALA", "A", i, float(i)) for i in range(1, 9)]
    text = "\n".join([
        "REMARK   2 X", "HEADER    TEST", "REMARK 987 CHAIN A FROM custom", "CRYST1   1", "HELIX    1   1 ALA A    2  ALA A    5  1",
        "SSBOND   1 CYS A    3    CYS A    7", "HELIX    2   2 ALA A    2  ALA A   99  1", *atoms])
    lines = lines_of(spark, {"dir/1abc.pdb": text})
    rows = pdb.residues(lines)
    notes = pdb.annotations(lines, rows)
    helix = notes["helices"].collect()
    assert [(r.res1, r.res2, r.length, r["class"]) for r in helix] == [(1, 4, 4, 1)]
    assert [(r.res1, r.res2) for r in notes["ssbonds"].collect()] == [(2, 6)]
    header = pdb.ordered_records(lines, pdb.HEADER_RECORDS).orderBy("kind_rank", "line_no").collect()
    assert [r.line[:6] for r in header] == ["HEADER", "REMARK"]
    assert pdb.chain_names(lines, rows).collect()[0].id_string == "custom"


def test_job_lists(spark):
    text = ["a:A", "", "# note", "-o second", " b ", "c", "-o third", "d"]
    rows = jobs.split_jobs(spark.createDataFrame(list(enumerate(text)), "line_no int, line string")).orderBy("job_id", "sel_ord").collect()
    assert [(r.job_id, r.out_prefix, r.selector) for r in rows] == [
        (0, "alignment", "a:A"), (1, "second", "b"), (1, "second", "c"), (2, "third", "d")]


def test_selecting_chains(spark):
    text = "\n".join(
        [atom(i, " CA ", "ALA", c, i, float(i)) for c in "AB" for i in range(1, 6)] + [atom(1, " CA ", "GLY", " ", 1, 0.0)])
    lines = lines_of(spark, {"f": text})
    rows = pdb.residues(lines)
    chains = pdb.chain_names(lines, rows)
    asked = ["f", "f:A(2-4)B", "f:ZA", "f:A:7,B", "f:A(4-2)B", "missing", "f::0"]
    wanted = jobs.parse_selectors(spark.createDataFrame(
        [(k, 0, s) for k, s in enumerate(asked)], "job_id long, sel_ord int, selector string"))
    requests = wanted.withColumn("path", F.when(F.col("file") == "f", F.lit("f")))
    chosen, problems = jobs.select_chains(requests, chains, rows)
    got = {}
    for r in chosen.orderBy("job_id", "chain").collect():
        got.setdefault(r.job_id, []).append((r.chain_id, r.first_idx, r.last_idx))
    assert got == {0: [("A", 0, 4), ("B", 0, 4)], 1: [("A", 1, 3), ("B", 0, 4)], 6: [("A", 0, 4), ("B", 0, 4)]}
    texts = {(r.job_id, r.problem) for r in problems.collect()}
    assert {(2, "no such chain"), (3, "no such model"), (4, "bad residue range"), (5, "cannot read structure")} <= texts
    assert {j for j, p in texts if p == "fewer than two chains"} == {2, 3, 4, 5}
    ready = jobs.job_residues(chosen, rows).where("job_id = 1 AND chain = 0").orderBy("res_idx").collect()
    assert [(r.res_idx, r.res_num) for r in ready] == [(0, 2), (1, 3), (2, 4)]


def test_loader_follows_the_file(spark):
    """Chains in file order, atoms before MODEL, TER of an unknown chain, SEQRES-only chains, renamed HET residues."""
    def het(serial, name, res, chain, num, x):
        return atom(serial, name, res, chain, num, x).replace("ATOM  ", "HETATM", 1)

    text = "\n".join([
        "SEQRES   1 C    2  GLY VAL", atom(1, " CA ", "ALA", "B", 1, 1.0), "MODEL        1", het(2, " N  ", "MSE", "B", 2, 2.0),
        atom(3, " CA ", "MET", "B", 2, 2.5), "TER       4      MET Z   2", atom(5, " CA ", "GLY", "B", 3, 3.0), atom(6, " CA ", "SER", "A", 1, 4.0),
        "ENDMDL", "CISPEP   1 MET B    2    ALA B    1          2       0.00", "SSBOND   1 CYS B    1    CYS B    2"])
    lines = lines_of(spark, {"x.pdb": text})
    rows = pdb.residues(lines)
    found = sorted((r.chain_id, r.model_ord, r.model_no, r.res_idx, r.res_name) for r in rows.collect())
    assert found == [("A", 1, 1, 0, "SER"), ("B", 1, 1, 0, "ALA"), ("B", 1, 1, 1, "MET"), ("C", 1, 1, 0, "GLY"), ("C", 1, 1, 1, "VAL")]
    order = [r.chain_id for r in pdb.chain_names(lines, rows).orderBy("file_ord").collect()]
    assert order == ["B", "A", "C"]
    notes = pdb.annotations(lines, rows)
    assert notes["cispeps"].count() == 0 and [(r.model_ord, r.res1, r.res2) for r in notes["ssbonds"].collect()] == [(1, 0, 1)]

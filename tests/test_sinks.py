"""Line formats against small goldens, and secondary structure on planted bonds."""

import pytest

from foldloom.operators import secondary
from foldloom.sinks import text


def rows_of(spark, rows, names=("one:A", "two:B")):
    return spark.createDataFrame(
        [(1, 2, k, k, row, names[k]) for k, row in enumerate(rows)],
        "job_id long, aln_id long, slot int, chain long, row string, id_string string")


def file_of(lines):
    return [r.line for r in lines.orderBy("major", "minor").collect()]


@pytest.mark.parametrize("n, sizes", [(59, [59]), (60, [60]), (61, [60, 1])])
def test_fasta_wrapping(spark, n, sizes):
    out = file_of(text.fasta(rows_of(spark, ["A" * n])))
    assert out[0] == ">one:A" and [len(x) for x in out[1:]] == sizes


def test_pir(spark):
    out = file_of(text.pir(rows_of(spark, ["A" * 65])))
    assert out == [">P1;one:A", "one:A", " " + " AAAAAAAAAA" * 6, "  AAAAA*", ""]


@pytest.mark.parametrize("n", [49, 50, 51])
def test_msf(spark, n):
    out = file_of(text.msf(rows_of(spark, ["A" * n, "-" * n]), "x", "now"))
    assert out[0] == f"MSF of: x from:    1 to: {n:4d}" and out[1] == f"x MSF: {n:4d}  Type: P now  Check: 9999  .." and out[2] == ""
    check = sum((i % 57 + 1) * ord("A") for i in range(n)) % 10000
    assert out[3] == f"Name:  one:A          Len:  {n:4d}  Check:  {check:4d}  Weight:  1.00"
    assert out[5:8] == ["", "//", ""] and out[8].startswith("one:A        AAAAAAAAAA AAAAAAAAAA ")
    assert not out[8].endswith(" ") and out[9].startswith("two:B        ..........") and len(out) == (11 if n <= 50 else 14)


def test_msf_names(spark):
    rows = rows_of(spark, ["A", "A"], ("averylongname1:A", "averylongname1:B"))
    names = [r.name for r in text.msf_names(rows).orderBy("slot").collect()]
    assert len(set(names)) == 2 and all(len(n) <= 13 for n in names)


def test_report(spark):
    rows = rows_of(spark, ["AC-D", "-CED"])
    info = spark.createDataFrame([(1, 2, "[1,0]", 12.3456, 2, 1.23456, 2, 0.001234, 1)],
                                 "job_id long, aln_id long, tree string, score double, n_chains int, rmsd double, n_core int, pvalue double, reference long")
    numbers = spark.createDataFrame([(1, c, i, i + 5, " ") for c in (0, 1) for i in range(3)], "job_id long, chain long, res_idx int, res_num int, ins_code string")
    assert file_of(text.report(rows, info, numbers)) == [
        "(two:B, one:A)", "Core Residues: 2", "Core RMSD: 1.235", "Raw Score: 12.346", "P-value: 1.2340e-03", "Reference structure: two:B", "",
        "one:A   AC-D     7  (A)", "two:B   -CED     7  (B)", ""]


def test_scripts_colour_full_blocks_only(spark):
    cells = [(1, 2, s, s, b, c, r) for s in (0, 1) for b, c, r in ((0, 0, 0), (0, 1, 1), (2, 3, 5))] + [(1, 2, 0, 0, 1, 2, 3)]
    columns = spark.createDataFrame(cells, "job_id long, aln_id long, slot int, chain long, block int, col int, res_idx int")
    members = spark.createDataFrame([(1, 2, 0, 0), (1, 2, 1, 1)], "job_id long, aln_id long, slot int, chain long")
    numbers = spark.createDataFrame([(1, c, i, i + 1, " ") for c in (0, 1) for i in range(7)], "job_id long, chain long, res_idx int, res_num int, ins_code string")
    full = text.full_blocks(columns, members)
    assert file_of(text.script(full, numbers)) == [
        "select all", "cartoon", "select 1-2:A,6-6:A", "color red", "select 1-2:B,6-6:B", "color blue", "select all"]
    assert file_of(text.view(full, numbers))[2] == 'color ribbon,res,side of chain "A" and num 1,2,6 in red;'


def test_coordinates_and_files(spark, tmp_path):
    atoms = spark.createDataFrame(
        [(1, 2, s, i, 0, " CA ", " ", "ALA" if i else "MSE", i + 1, " ", 5 if i else 20, float(i), 0.0, -1.5, None, None, "C", 0) for s in (0, 1) for i in (0, 1)],
        "job_id long, aln_id long, slot int, res_idx int, atom_ord int, name string, alt_loc string, res_name string, res_num int, ins_code string, "
        "code int, x double, y double, z double, occupancy float, temp_factor float, element string, charge int")
    lines = text.coordinates(atoms, atoms.select("job_id", "aln_id", "slot", "res_idx", "res_name"))
    out = file_of(lines)
    assert out[0] == "SEQRES   1 A    2  MSE ALA"
    assert out[2] == "HETATM    1  CA  MSE A   1       0.000   0.000  -1.500  1.00  0.00           C  "
    assert out[3].startswith("ATOM      2  CA  ALA A   2") and out[4] == "TER       3      ALA A   2 "
    assert out[5].startswith("HETATM    4") and out[-1] == "END".ljust(80)
    prefixes = spark.createDataFrame([(1, str(tmp_path / "out"))], "job_id long, out_prefix string")
    text.write_files(lines, prefixes, "pdb")
    assert (tmp_path / "out.pdb").read_text().splitlines() == out


def bonds_of(spark, pairs):
    return spark.createDataFrame([(0, 0, d, a) for d, a in pairs], "job_id long, chain long, donor int, acceptor int")


def test_helices(spark):
    got = secondary.helices(bonds_of(spark, [(i + 4, i) for i in range(3, 8)] + [(20, 23), (21, 24)] + [(40, 35)])).collect()
    assert {(r.start, r.length, r["class"]) for r in got} == {(3, 9, 1), (20, 4, 5)}


def test_ladders_and_sheets(spark):
    anti = [(2, 20), (20, 2), (4, 18), (18, 4)]
    parallel = [(30, 49), (51, 30), (32, 51), (53, 32)]
    got = secondary.strand_pairs(bonds_of(spark, anti + parallel))
    rows = {(r.start1, r.start2, r.direction, r.length) for r in got.collect()}
    assert (2, 20, -1, 3) in rows and any(d == 1 and s1 == 30 and s2 == 50 and n >= 3 for s1, s2, d, n in rows)
    points = spark.createDataFrame([(0, 0, k, float(k), 0.0, 0.0) for k in range(60)], "job_id long, chain long, res_idx int, x double, y double, z double")
    sheets = secondary.sheets(got, points).collect()
    assert {r.sheet for r in sheets} == {0, 1}

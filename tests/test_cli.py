"""Options and a whole run over files."""

import gzip

import pytest
from conftest import rotation, walk

from foldloom import cli


def test_option_precedence():
    opts = cli.options(["-b1", "-f", "all", "a", "b"], "-c 3 -b0 -p0")
    assert opts.bent == 1 and opts.cutoff == 3.0 and opts.partial == 0 and opts.seqres == 1 and opts.formats == cli.FORMATS
    assert cli.options(["a"]).formats == ("pdb", "txt", "fasta", "spt")
    with pytest.raises(ValueError):
        cli.options(["-f", "doc"])
    with pytest.raises(ValueError):
        cli.options(["-c", "-2"])


def structure(points, chain):
    names = ["ALA", "GLY", "SER", "VAL", "LEU", "LYS"]
    return "\n".join(
        f"ATOM  {i + 1:5d}  CA  {names[i % 6]} {chain}{i + 1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C  "
        for i, (x, y, z) in enumerate(points)) + "\nTER\n"


def test_whole_run(spark, tmp_path):
    base = walk(30, 21)
    (tmp_path / "one.pdb").write_text(structure(base, "A"))
    (tmp_path / "two.pdb.gz").write_bytes(gzip.compress(structure(base @ rotation(6).T + 9, "B").encode()))
    (tmp_path / "list").write_text(f"# pair\n-o {tmp_path}/out\none:A\ntwo\nlost\n")
    opts = cli.options(["-L", str(tmp_path / "list"), "-b1", "-f", "all"])
    problems = cli.run(spark, opts, [str(tmp_path)]).collect()
    assert [p.problem for p in problems] == ["cannot read structure"]
    report = (tmp_path / "out.txt").read_text()
    assert "Core Residues: 30" in report and "Core RMSD: 0.00" in report
    fasta = (tmp_path / "out.fasta").read_text().splitlines()
    assert fasta[0] == ">one:A" and fasta[2] == ">two:B" and fasta[1] == fasta[3] and len(fasta[1]) == 30
    for name in ("out.pir", "out.msf", "out.spt", "out.spdbv", "out.pdb", "out_bent.pdb"):
        assert (tmp_path / name).exists()
    atoms = [line for line in (tmp_path / "out.pdb").read_text().splitlines() if line.startswith("ATOM")]
    first = {line[22:26]: line[30:54] for line in atoms if line[21] == "A"}
    second = {line[22:26]: line[30:54] for line in atoms if line[21] == "B"}
    assert len(first) == len(second) == 30
    for num, place in first.items():
        for k in range(0, 24, 8):
            assert abs(float(place[k:k + 8]) - float(second[num][k:k + 8])) < 0.01

"""Command line: structure files in, aligned coordinates, sequences and reports out.

Options come from the command line, then from ``FOLDLOOM_PARAMS``, then from the defaults.
"""

from __future__ import annotations

import argparse
import logging
import os
import shlex
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.scoring import TABLE_SIZE
from foldloom.operators import layout
from foldloom.operators.rigid import move_by_block, move_chains
from foldloom.plans import job
from foldloom.plans.progressive import multiple_alignment
from foldloom.session import cut_lineage
from foldloom.sinks import text
from foldloom.sources import files, jobs, pdb

FORMATS = ("pdb", "txt", "fasta", "pir", "msf", "spt", "spdbv")
DEFAULTS = "-f pdb,txt,fasta,spt -c 5.0 -b0 -r0 -l1 -s1 -v1 -d1 -p1"
log = logging.getLogger("foldloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foldloom", description=__doc__)
    p.add_argument("-o", dest="prefix", default=None, help="output prefix")
    p.add_argument("-L", dest="list_file", default=None, help="list of selectors; '-o prefix' lines start jobs")
    p.add_argument("-c", dest="cutoff", type=float, default=None, help="distance cutoff of the final extension")
    p.add_argument("-f", dest="formats", default=None, help="output formats, or all")
    for flag, name in (("b", "bent"), ("r", "renumber"), ("l", "relabel"), ("s", "seqres"), ("v", "verbose"), ("d", "progress"), ("p", "partial")):
        p.add_argument(f"-{flag}", dest=name, nargs="?", const=1, type=int, choices=(0, 1), default=None)
    p.add_argument("-t", dest="score_table", default=None, help="file with score values at every 0.001 Angstrom; else they come from the chains")
    p.add_argument("-g", dest="max_skips", type=int, default=None, help="residues of the atoms that may be missing from SEQRES, plus one")
    p.add_argument("selectors", nargs="*")
    return p


def options(argv: Sequence[str], environment: str | None = None) -> argparse.Namespace:
    """Merge command line, environment and defaults, in that order of precedence."""
    layers = [parser().parse_args(list(argv)), parser().parse_args(shlex.split(environment or "")), parser().parse_args(shlex.split(DEFAULTS))]
    merged = argparse.Namespace()
    for name in vars(layers[0]):
        merged.__dict__[name] = next((v for v in (getattr(layer, name) for layer in layers) if v not in (None, [])), None)
    chosen = FORMATS if merged.formats == "all" else tuple(merged.formats.split(","))
    unknown = set(chosen) - set(FORMATS)
    if unknown:
        raise ValueError(f"unsupported output format: {', '.join(sorted(unknown))}")
    if merged.cutoff < 0:
        raise ValueError("the cutoff must not be negative")
    merged.formats = chosen
    return merged


def job_table(spark: SparkSession, opts: argparse.Namespace) -> DataFrame:
    """Jobs from the list file and the arguments."""
    prefix = opts.prefix or jobs.DEFAULT_PREFIX
    sources = []
    if opts.list_file:
        lines = files.split_lines(spark.read.text(opts.list_file, wholetext=True).select(
            F.input_file_name().alias("path"), F.col("value").alias("text"))).drop("path")
        sources.append(lines)
    if opts.selectors:
        rows = [(i - len(opts.selectors), s) for i, s in enumerate(opts.selectors)]
        sources.append(spark.createDataFrame(rows, "line_no int, line string"))
    if not sources:
        raise ValueError("nothing to align")
    lines = sources[0]
    for more in sources[1:]:
        lines = lines.unionByName(more)
    return jobs.split_jobs(lines, prefix)


def score_values(spark: SparkSession, path: str) -> list[float]:
    """Score table of a file of numbers; its size is fixed by the scored range."""
    values = [float(v) for v in spark.read.text(path, wholetext=True).first()["value"].split()[:TABLE_SIZE]]
    if len(values) < TABLE_SIZE - 1:
        raise ValueError(f"a score table has at least {TABLE_SIZE - 1} values")
    return values + values[-1:] * (TABLE_SIZE - len(values))


def run(spark: SparkSession, opts: argparse.Namespace, search: Sequence[str] = (), mirror: str | None = None) -> DataFrame:
    """Align every job and write its files; returns the problem rows."""
    listed = job_table(spark, opts)
    wanted = cut_lineage(jobs.parse_selectors(listed))
    # Only distinct file names come to the driver, to be looked up in the search path.
    names = [r.file for r in wanted.select("file").distinct().toLocalIterator()]
    found = {n: p for n in names if (p := files.resolve_path(n, search, mirror))}
    lookup = spark.createDataFrame([(n, f"file:{os.path.abspath(p)}") for n, p in found.items()] or [("", "")], "file string, path string")
    if not found:
        return wanted.select("job_id", "sel_ord", F.lit("cannot read structure").alias("problem"))
    requests = wanted.join(lookup, "file", "left")
    lines = cut_lineage(files.read_lines(spark, sorted({os.path.abspath(p) for p in found.values()})))
    residues = cut_lineage(pdb.residues(lines, bool(opts.seqres), bool(opts.renumber), opts.max_skips or pdb.SKIP_LIMIT))
    chains = pdb.chain_names(lines, residues)
    selected, problems = jobs.select_chains(requests, chains, residues)
    selected = cut_lineage(selected)
    loaded = cut_lineage(jobs.job_residues(selected, residues))
    prefixes = listed.select("job_id", "out_prefix").distinct()
    curve = score_values(spark, opts.score_table) if opts.score_table else None
    merged = multiple_alignment(loaded.select("job_id", "chain", "res_idx", "letter", "x", "y", "z"), curve)
    apart = merged["alignments"].where("n_cols = 0").select("job_id", F.lit(0).alias("sel_ord"), F.lit("no common structure").alias("problem"))
    problems = problems.select("job_id", F.col("sel_ord").cast("int").alias("sel_ord"), "problem").unionByName(apart)
    done = job.finish_alignments(merged, loaded, opts.cutoff, bool(opts.partial))
    ids = selected.select("job_id", "chain", "id_string")
    numbers = loaded.select("job_id", "chain", "res_idx", "res_num", "ins_code", "res_name", "letter")
    _write(opts, done["alignments"], done["columns"], done["members"], ids, numbers, prefixes, "")
    if "pdb" in opts.formats:
        atoms = _atoms(lines, residues, selected)
        moved = move_chains(atoms, done["moves"])
        text.write_files(_coordinate_file(moved, done["members"], numbers), prefixes, "pdb")
        if opts.bent:
            table, block_maps = job.bent_blocks(merged, loaded)
            bent = move_by_block(atoms, table, block_maps)
            text.write_files(_coordinate_file(bent, done["members"], numbers), prefixes.withColumn("out_prefix", F.concat("out_prefix", F.lit("_bent"))), "pdb")
    return problems


def _atoms(lines: DataFrame, residues: DataFrame, selected: DataFrame) -> DataFrame:
    """Atoms of the selected chains with their residue index inside the selection."""
    keys = ["path", "model_ord", "chain_id"]
    placed = residues.where("run IS NOT NULL").select(*keys, "run", "res_idx", "code", "res_num", "ins_code")
    raw = pdb.atoms(lines).drop("res_num", "ins_code")
    joined = raw.join(placed, [*keys, "run"]).join(selected.drop("id_string"), keys).where("res_idx BETWEEN first_idx AND last_idx")
    return joined.withColumn("res_idx", (F.col("res_idx") - F.col("first_idx")).cast("int"))


def _coordinate_file(atoms: DataFrame, members: DataFrame, numbers: DataFrame) -> DataFrame:
    placed = atoms.join(members, ["job_id", "chain"])
    return text.coordinates(placed, members.join(numbers, ["job_id", "chain"]))


def _write(opts, alignments, columns, members, ids, numbers, prefixes, suffix: str) -> None:
    rows = cut_lineage(layout.sequence_alignment(columns, members, numbers).join(ids, ["job_id", "chain"]))
    blocks = text.full_blocks(columns, members)
    stamp = time.strftime("%d-%b-%y %X")
    writers = {
        "txt": lambda: text.report(rows, alignments, numbers), "fasta": lambda: text.fasta(rows), "pir": lambda: text.pir(rows),
        "msf": lambda: text.msf(rows, opts.prefix or jobs.DEFAULT_PREFIX, stamp), "spt": lambda: text.script(blocks, numbers),
        "spdbv": lambda: text.view(blocks, numbers)}
    for name in opts.formats:
        if name in writers:
            text.write_files(writers[name](), prefixes, name)
            if opts.verbose:
                log.info("   wrote %s files", name)


def main(argv: Sequence[str] | None = None) -> int:
    import sys

    opts = options(sys.argv[1:] if argv is None else argv, os.environ.get("FOLDLOOM_PARAMS"))
    spark = SparkSession.builder.appName("foldloom").getOrCreate()
    search = [p for p in spark.conf.get("spark.foldloom.search.path", "").split(":") if p]
    problems = run(spark, opts, search, spark.conf.get("spark.foldloom.mirror.path", None))
    count = 0
    for row in problems.toLocalIterator():
        count += 1
        log.warning(" * job %s: %s", row["job_id"], row["problem"])
    return 1 if count else 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Text outputs of alignments as rows of lines: FASTA, PIR, MSF, report, viewer scripts, coordinates.

Every function returns (job_id, aln_id, major, minor, line); ordering by (major, minor) gives the file.
``rows`` are gapped rows (layout.sequence_alignment) with ``id_string``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.residues import chain_label, in_capitals
from foldloom.operators.layout import wrapped

KEYS = ["job_id", "aln_id"]
# Colours of the viewer scripts, in order.
SCRIPT_COLOURS = ("red", "blue", "green", "purple", "cyan", "orange", "yellow", "greenblue", "magenta", "[255,171,187]")
VIEW_COLOURS = (
    "red", "blue", "green", "purple", "cyan", "orange", "yellow", "<0.18,0.54,0.34>", "<1.0,0.0,1.0>", "<1.0,0.67,0.73>")
LINE, TENS = 60, 10
MSF_LINE, MSF_NAME, MSF_CHECK_CYCLE, MSF_CHECK_MODULUS = 50, 13, 57, 10000
SCRIPT_RANGES, VIEW_BLOCKS = 10, 30
SEQRES_PER_LINE = 13


def _lines(df: DataFrame, major: Column, minor: Column, line: Column) -> DataFrame:
    return df.select(*KEYS, major.cast("long").alias("major"), minor.cast("long").alias("minor"), line.alias("line"))


def fasta(rows: DataFrame) -> DataFrame:
    """A ``>id`` line and 60 letters per line."""
    head = _lines(rows, F.col("slot"), F.lit(0), F.concat(F.lit(">"), "id_string"))
    return head.unionByName(_lines(wrapped(rows, LINE), F.col("slot"), F.col("line_no") + 1, F.col("part")))


def in_tens(text: Column) -> Column:
    """Blank before every group of ten letters."""
    return F.regexp_replace(text, "(.{1,10})", " $1")


def pir(rows: DataFrame) -> DataFrame:
    """``>P1;id``, the title, 60 letters per line in groups of ten, a closing star, an empty line."""
    parts = wrapped(rows, LINE)
    last = F.max("line_no").over(Window.partitionBy(*KEYS, "slot"))
    body = parts.withColumn("_last", last)
    text = F.concat(F.lit(" "), in_tens(F.col("part")), F.when(F.col("line_no") == F.col("_last"), F.lit("*")).otherwise(F.lit("")))
    empty = rows.where(F.length("row") == 0)
    return (
        _lines(rows, F.col("slot"), F.lit(-2), F.concat(F.lit(">P1;"), "id_string"))
        .unionByName(_lines(rows, F.col("slot"), F.lit(-1), F.col("id_string")))
        .unionByName(_lines(body, F.col("slot"), F.col("line_no"), text))
        .unionByName(_lines(body.where("line_no = _last"), F.col("slot"), F.col("line_no") + 1, F.lit("")))
        .unionByName(_lines(empty, F.col("slot"), F.lit(0), F.lit(" *")))
        .unionByName(_lines(empty, F.col("slot"), F.lit(1), F.lit("")))
    )


def checksum(row: Column) -> Column:
    """Sum of letter codes weighted 1..57 in turn, modulo 10000."""
    codes = F.transform(F.split(in_capitals(row), ""), lambda c, i: F.ascii(c) * (i % MSF_CHECK_CYCLE + 1))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, v: acc + v) % MSF_CHECK_MODULUS


def msf_names(rows: DataFrame) -> DataFrame:
    """Thirteen-character names; equal ones get the chain and, if those repeat too, a counter."""
    name = F.when(F.length("id_string") > 13, F.substring("id_string", 1, 12)).otherwise(F.col("id_string"))
    named = rows.withColumn("_name", name).withColumn("_chain", F.coalesce(F.nullif(F.substring_index("id_string", ":", -1), F.col("id_string")), F.lit("_")))
    same_name = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "_name"))
    same_both = Window.partitionBy(*KEYS, "_name", "_chain")
    stem = F.substring_index(F.substring_index("id_string", ":", 1), " ", 1)
    count = F.row_number().over(same_both.orderBy("slot")) - 1
    return named.withColumn("_n", same_name).withColumn("_m", F.count(F.lit(1)).over(same_both)).withColumn("_k", count).withColumn(
        "name",
        F.when(F.col("_m") > 1, F.concat(F.substring(stem, 1, 8), F.lit(":"), "_chain", F.col("_k").cast("string")))
        .when(F.col("_n") > 1, F.concat(F.substring(stem, 1, 10), F.lit(":"), "_chain")).otherwise(F.col("_name")),
    ).drop("_name", "_chain", "_n", "_m", "_k")


def msf(rows: DataFrame, title: str, stamp: str) -> DataFrame:
    """MSF header with checksums, then 50 letters per line in tens; gaps are dots."""
    named = msf_names(rows).withColumn("_len", F.length("row"))
    first = named.where("slot = 0")
    head = _lines(first, F.lit(0), F.lit(0), F.format_string(f"MSF of: {title} from:    1 to: %4d", "_len")).unionByName(
        _lines(first, F.lit(0), F.lit(1), F.format_string(f"{title} MSF: %4d  Type: P {stamp}  Check: 9999  ..", "_len"))).unionByName(
        _lines(first, F.lit(0), F.lit(2), F.lit("")))
    names = _lines(named, F.lit(1), F.col("slot"), F.format_string(
        "Name:  %-13s  Len:  %4d  Check:  %4d  Weight:  1.00", "name", "_len", checksum(F.col("row"))))
    rule = _lines(first.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2)))), F.lit(2), F.col("_k"),
                  F.when(F.col("_k") == 1, F.lit("//")).otherwise(F.lit("")))
    parts = wrapped(named, MSF_LINE)
    dotted = F.regexp_replace(F.regexp_replace("part", "-", "."), "(.{10})(?=.)", "$1 ")
    body = _lines(parts, F.col("line_no") + 3, F.col("slot"), F.concat(F.rpad("name", MSF_NAME, " "), dotted))
    gaps = _lines(parts.where("slot = 0"), F.col("line_no") + 3, F.lit(2**31), F.lit(""))
    return head.unionByName(names).unionByName(rule).unionByName(body).unionByName(gaps)


def tree_string(tree: Column, names: Column) -> Column:
    """Assembly tree with id strings: ``names`` maps chain to id.

    The stored tree is bracketed; leaves are replaced through the map in one pass over its tokens.
    """
    tokens = F.regexp_extract_all(tree, F.lit(r"(\[|\]|,|-?[0-9]+)"), F.lit(1))
    shown = F.transform(tokens, lambda t: F.when(t == "[", F.lit("(")).when(t == "]", F.lit(")")).when(t == ",", F.lit(", ")).otherwise(
        F.element_at(names, t.try_cast("long") if hasattr(t, "try_cast") else t.cast("long"))))
    return F.array_join(shown, "")


def report(rows: DataFrame, alignments: DataFrame, numbered: DataFrame) -> DataFrame:
    """Text report: tree, core size, RMSD, score, p-value for pairs, reference and 60-column rows.

    ``numbered``: job_id, chain, res_idx, res_num, ins_code gives the number printed after each line.
    """
    ids = rows.groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("chain", "id_string"))).alias("_ids"), F.max(F.length("id_string")).alias("_w"))
    info = alignments.join(ids, KEYS)
    p = F.when(F.col("pvalue") >= 0.01, F.format_string("P-value: %.4f", "pvalue")).otherwise(F.format_string("P-value: %.4e", "pvalue"))
    head = info.select(*KEYS, F.posexplode(F.array(
        tree_string(F.col("tree"), F.col("_ids")),
        F.format_string("Core Residues: %d", "n_core"), F.format_string("Core RMSD: %.3f", "rmsd"),
        F.format_string("Raw Score: %.3f", "score"), p,
        F.concat(F.lit("Reference structure: "), F.element_at("_ids", F.col("reference"))), F.lit(""))).alias("_k", "line")).where("line IS NOT NULL")
    head = _lines(head, F.lit(-1), F.col("_k"), F.col("line"))
    from foldloom.operators.layout import last_residue_number
    parts = last_residue_number(rows, LINE).join(ids.select(*KEYS, "_w"), KEYS).withColumn("res_idx", F.greatest(F.col("n_letters") - 1, F.lit(0)))
    body = parts.join(numbered.select("job_id", "chain", "res_idx", "res_num", "ins_code"), ["job_id", "chain", "res_idx"])
    line = F.concat(F.expr("rpad(id_string, _w, ' ')"), F.lit("   "), "part", F.format_string(" %5d%s (%s)", "res_num", "ins_code", chain_label(F.col("slot"))))
    return head.unionByName(_lines(body, F.col("line_no"), F.col("slot"), line)).unionByName(
        _lines(parts.where("slot = 0"), F.col("line_no"), F.lit(2**31), F.lit("")))


def full_blocks(columns: DataFrame, members: DataFrame) -> DataFrame:
    """Ranges of the blocks in which every chain is present in every column."""
    width = members.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    filled = columns.groupBy(*KEYS, "block").agg(F.count("res_idx").alias("_filled"), (F.max("col") - F.min("col") + 1).alias("_w"))
    full = filled.join(width, KEYS).where("_filled = _n * _w").select(*KEYS, "block")
    return columns.join(full, [*KEYS, "block"], "left_semi").groupBy(*KEYS, "slot", "chain", "block").agg(
        F.min("res_idx").alias("first_idx"), F.max("res_idx").alias("last_idx"))


def _coloured(blocks: DataFrame, per_line: int) -> DataFrame:
    order = Window.partitionBy(*KEYS, "slot").orderBy("block")
    return blocks.withColumn("_group", F.floor((F.row_number().over(order) - 1) / per_line).cast("int"))


def _palette(colours: tuple[str, ...]) -> Column:
    return F.element_at(F.lit(list(colours)), (F.col("slot") % len(colours) + 1).cast("int"))


def script(blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """Viewer script: ten residue ranges per select, one colour per chain."""
    numbers = numbered.select("job_id", "chain", "res_idx", F.concat(F.col("res_num").cast("string"), F.trim("ins_code")).alias("_n"))
    ends = blocks.join(numbers.withColumnsRenamed({"res_idx": "first_idx", "_n": "_from"}), ["job_id", "chain", "first_idx"]).join(
        numbers.withColumnsRenamed({"res_idx": "last_idx", "_n": "_to"}), ["job_id", "chain", "last_idx"])
    text = F.concat("_from", F.lit("-"), "_to", F.lit(":"), chain_label(F.col("slot")))
    grouped = _coloured(ends.withColumn("_r", text), SCRIPT_RANGES).groupBy(*KEYS, "slot", "_group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "_r"))), lambda e: e["_r"]), ",").alias("_t"))
    body = grouped.select(*KEYS, "slot", F.explode(F.array(
        F.struct((F.col("_group") * 2).alias("k"), F.concat(F.lit("select "), "_t").alias("line")),
        F.struct((F.col("_group") * 2 + 1).alias("k"), F.concat(F.lit("color "), _palette(SCRIPT_COLOURS)).alias("line")))).alias("e"))
    keys = blocks.select(*KEYS).distinct()
    edges = keys.select(*KEYS, F.inline(F.array(
        F.struct(F.lit(-1).alias("m"), F.lit(0).alias("k"), F.lit("select all").alias("line")),
        F.struct(F.lit(-1).alias("m"), F.lit(1).alias("k"), F.lit("cartoon").alias("line")),
        F.struct(F.lit(2**31 - 1).alias("m"), F.lit(0).alias("k"), F.lit("select all").alias("line")))))
    return _lines(body, F.col("slot"), F.col("e.k"), F.col("e.line")).unionByName(_lines(edges, F.col("m"), F.col("k"), F.col("line")))


def view(blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """Second viewer dialect: residue numbers, thirty blocks per command."""
    cells = _coloured(blocks, VIEW_BLOCKS).withColumn("res_idx", F.explode(F.sequence("first_idx", "last_idx")))
    named = cells.join(numbered.select("job_id", "chain", "res_idx", "res_num"), ["job_id", "chain", "res_idx"])
    grouped = named.groupBy(*KEYS, "slot", "_group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_idx", "res_num"))), lambda e: e["res_num"].cast("string")), ",").alias("_t"))
    colour = _palette(VIEW_COLOURS)
    line = F.concat(F.lit('color ribbon,res,side of chain "'), chain_label(F.col("slot")), F.lit('" and num '), "_t",
                    F.when(colour.startswith("<"), F.lit(" by ")).otherwise(F.lit(" in ")), colour, F.lit(";"))
    edges = blocks.select(*KEYS).distinct().select(*KEYS, F.inline(F.array(
        F.struct(F.lit(-1).alias("m"), F.lit(0).alias("k"), F.lit("please do").alias("line")),
        F.struct(F.lit(-1).alias("m"), F.lit(1).alias("k"), F.lit("color ribbon,res,side of all in grey;").alias("line")),
        F.struct(F.lit(2**31 - 1).alias("m"), F.lit(0).alias("k"), F.lit("thank you").alias("line")))))
    return _lines(grouped, F.col("slot"), F.col("_group"), line).unionByName(_lines(edges, F.col("m"), F.col("k"), F.col("line")))


def atom_line(serial: Column, label: Column) -> Column:
    """One coordinate record; HETATM where the residue is unknown and not named so."""
    rec = F.when((F.col("code") == 20) & (F.col("res_name") != "UNK"), F.lit("HETATM")).otherwise(F.lit("ATOM  "))
    charge = F.when(F.coalesce(F.col("charge"), F.lit(0)) == 0, F.lit("  ")).otherwise(
        F.concat(F.abs("charge").cast("string"), F.when(F.col("charge") < 0, F.lit("-")).otherwise(F.lit("+"))))
    return F.format_string(
        "%s%5d %4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s%s", rec, serial, "name", "alt_loc", "res_name", label,
        "res_num", "ins_code", "x", "y", "z", F.coalesce(F.col("occupancy").cast("double"), F.lit(1.0)),
        F.coalesce(F.col("temp_factor").cast("double"), F.lit(0.0)), F.coalesce("element", F.lit("")), charge)


def coordinates(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """Coordinate file of an alignment: SEQRES, ATOM/HETATM, TER, MASTER and END records.

    ``atoms``: keys, slot, res_idx, atom_ord, name, alt_loc, res_name, res_num, ins_code, code, x, y, z,
    occupancy, temp_factor, element, charge.  ``residues``: keys, slot, res_idx, res_name.
    Serials run across chains and each TER takes one.
    """
    label = chain_label(F.col("slot"))
    order = Window.partitionBy(*KEYS).orderBy("slot", "res_idx", "atom_ord")
    numbered = atoms.withColumn("_serial", F.row_number().over(order) + F.col("slot"))
    body = _lines(numbered, F.col("slot") * 2 + 1, F.col("_serial"), atom_line(F.col("_serial"), label))
    last = numbered.groupBy(*KEYS, "slot").agg(F.max_by(F.struct("_serial", "res_name", "res_num", "ins_code"), "_serial").alias("t"))
    ter = _lines(last, F.col("slot") * 2 + 1, F.col("t._serial") + 1, F.format_string(
        "TER   %5d      %3s %1s%4d%1s", F.col("t._serial") + 1, F.col("t.res_name"), label, F.col("t.res_num"), F.col("t.ins_code")))
    seq = residues.withColumn("_k", F.floor(F.col("res_idx") / SEQRES_PER_LINE).cast("int")).groupBy(*KEYS, "slot", "_k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_idx", "res_name"))), lambda e: F.lpad(e["res_name"], 3, " ")), " ").alias("_t"))
    length = residues.groupBy(*KEYS, "slot").agg(F.count(F.lit(1)).alias("_len"))
    seq = seq.join(length, [*KEYS, "slot"])
    seqres = _lines(seq, F.col("slot").cast("long") - 2**31, F.col("_k"), F.format_string("SEQRES %3d %1s %4d  %s", F.col("_k") + 1, label, "_len", "_t"))
    counts = atoms.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_a"), F.count_distinct("slot").alias("_c"))
    lines = seq.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_s"))
    master = counts.join(lines, KEYS).select(*KEYS, F.inline(F.array(
        F.struct(F.lit(0).alias("k"), F.format_string("MASTER        0    0    0    0    0    0    0    0%5d%5d    0%5d          ", "_a", "_c", "_s").alias("line")),
        F.struct(F.lit(1).alias("k"), F.rpad(F.lit("END"), 80, " ").alias("line")))))
    return seqres.unionByName(body).unionByName(ter).unionByName(_lines(master, F.lit(2**31), F.col("k"), F.col("line")))


def write_files(lines: DataFrame, prefixes: DataFrame, extension: str) -> None:
    """Write one text file per job: ``<prefix>.<extension>`` in the prefix's (shared) folder.

    Jobs are spread over tasks; each task sorts its lines on Spark's side and streams them to the files.
    """
    ordered = lines.join(prefixes.select("job_id", "out_prefix"), "job_id").repartition("job_id").sortWithinPartitions("job_id", "major", "minor")

    def stream(rows) -> None:
        path, handle = None, None
        for row in rows:
            wanted = f"{row['out_prefix']}.{extension}"
            if wanted != path:
                if handle:
                    handle.close()
                path, handle = wanted, open(wanted, "w", encoding="latin-1", newline="\n")
            handle.write(row["line"] + "\n")
        if handle:
            handle.close()

    ordered.select("out_prefix", "line").foreachPartition(stream)

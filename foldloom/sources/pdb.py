"""Fixed-width structure records as DataFrames: atoms, residues, chains and annotations.

All steps are keyed by file (and chain), so a scan over many files is spread by file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.residues import with_codes
from foldloom.session import cut_lineage, small_batches, spread

CHAIN = ["path", "model_ord", "model_no", "chain_id"]
# Header and crystal record kinds in output order, and the cached annotation kinds.
HEADER_RECORDS = (
    "HEADER", "OBSLTE", "TITLE ", "SPLIT ", "CAVEAT", "COMPND", "SOURCE", "KEYWDS", "EXPDTA", "NUMMDL",
    "MDLTYP", "AUTHOR", "REVDAT", "SPRSDE", "JRNL  ", "REMARK",
)
CRYSTAL_RECORDS = (
    "CRYST1", "ORIGX1", "ORIGX2", "ORIGX3", "SCALE1", "SCALE2", "SCALE3", "MTRIX1", "MTRIX2", "MTRIX3", "TVECT ",
)
ANNOTATION_RECORDS = ("DBREF ", "SEQADV", "HELIX ", "SHEET ", "TURN  ", "SSBOND", "LINK  ", "CISPEP")
#: Default of how many residues of the atoms may be left out where they are aligned with SEQRES.
SKIP_LIMIT = 2


def field(start: int, end: int, line: str = "line") -> Column:
    """Characters start..end (0-based, end exclusive)."""
    return F.substring(line, start + 1, end - start)


def number(start: int, end: int, kind: str = "int") -> Column:
    """Leading decimal number of a field, NULL if there is none."""
    pattern = r"^\s*([+-]?\d+)" if kind == "int" else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.expr(f"try_cast(nullif(regexp_extract(substring(line, {start + 1}, {end - start}), '{pattern}', 1), '') AS {kind})".replace("\\", "\\\\"))


def with_models(lines: DataFrame) -> DataFrame:
    """Add the record name and the model each line belongs to.

    Lines before the first MODEL belong to it; model 0 stands for files without any.
    """
    rec = F.upper(F.rpad(field(0, 6), 6, " "))
    file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("rec") == "MODEL ", F.coalesce(number(6, 20), F.lit(0)))
    whole = Window.partitionBy("path")
    first = F.min_by(opened, F.when(opened.isNotNull(), F.col("line_no"))).over(whole)
    return lines.withColumn("rec", rec).withColumn(
        "model_ord", F.greatest(F.count(opened).over(file), F.when(F.count(opened).over(whole) > 0, 1).otherwise(0)).cast("int")).withColumn(
        "model_no", F.coalesce(F.last(opened, ignorenulls=True).over(file), first, F.lit(0)))


def atoms(lines: DataFrame) -> DataFrame:
    """ATOM and HETATM records of every model and chain, up to the TER that ends the chain."""
    modelled = with_models(lines)
    file = Window.partitionBy("path", "model_ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_atom = F.col("rec").isin("ATOM  ", "HETATM") & (F.length("line") > 53)
    near = modelled.where(F.col("rec").isin("ATOM  ", "HETATM", "TER   ")).withColumn(
        "_own", F.when(is_atom, field(21, 22)))
    named = near.withColumn("_last", F.last("_own", ignorenulls=True).over(file)).withColumn("_seen", F.collect_set("_own").over(file))
    ter = (F.col("rec") == "TER   ") & (F.length("line") >= 21)
    # a TER that names no chain seen so far ends the last one
    ended = F.when((F.length("line") > 21) & F.array_contains("_seen", field(21, 22)), field(21, 22)).otherwise(F.col("_last"))
    chained = named.withColumn("chain_id", F.when(ter, ended).otherwise(F.col("_own")))
    by_chain = Window.partitionBy(*CHAIN)
    first_ter = F.min(F.when(F.col("rec") == "TER   ", F.col("line_no"))).over(by_chain)
    kept = chained.where("chain_id IS NOT NULL").withColumn("ter_line", first_ter).where(
        is_atom & (F.col("ter_line").isNull() | (F.col("line_no") < F.col("ter_line"))))
    name_element = F.regexp_replace(field(12, 14), "[0-9 ]", "")
    long = F.length("line") >= 66
    parsed = kept.select(
        *CHAIN, "line_no", (F.col("rec") == "HETATM").alias("is_het"), F.col("ter_line").isNotNull().alias("has_ter"),
        number(6, 11).alias("serial"), field(12, 16).alias("name"), field(16, 17).alias("alt_loc"),
        field(17, 20).alias("res_name"), number(22, 26).alias("res_num"), field(26, 27).alias("ins_code"),
        number(30, 38, "double").alias("x"), number(38, 46, "double").alias("y"), number(46, 54, "double").alias("z"),
        F.when(long, number(54, 60, "float")).alias("occupancy"), F.when(long, number(60, 66, "float")).alias("temp_factor"),
        F.when((F.length("line") >= 78) & (F.trim(field(76, 78)) != ""), F.trim(field(76, 78))).otherwise(name_element).alias("element"),
        F.expr("CAST(try_cast(substring(line, 79, 1) AS int) * CASE substring(line, 80, 1) WHEN '-' THEN -1 ELSE 1 END AS tinyint)").alias("charge"),
    ).where("res_num IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    order = Window.partitionBy(*CHAIN).orderBy("line_no")
    changed = (F.lag("res_num").over(order).isNull() | (F.lag("res_num").over(order) != F.col("res_num"))
               | (F.lag("ins_code").over(order) != F.col("ins_code")))
    return parsed.withColumn("_new", changed.cast("int")).withColumn(
        "run", (F.sum("_new").over(order) - 1).cast("int")).withColumn(
        "atom_ord", (F.row_number().over(order) - 1).cast("int")).drop("_new")


def atom_residues(atom_rows: DataFrame) -> DataFrame:
    """Residues seen in atoms, with their alpha carbon, unwanted hetero ends trimmed.

    A residue is hetero if all of its atoms are, and named by its first ATOM record if it has one; leading and trailing hetero residues without an alpha
    carbon go, and chains of nothing but unterminated hetero atoms go altogether.
    """
    carbon = F.col("name") == " CA "
    grouped = atom_rows.groupBy(*CHAIN, "run").agg(
        F.min_by("res_name", F.struct("is_het", "atom_ord")).alias("res_name"), F.min("res_num").alias("res_num"),
        F.min("ins_code").alias("ins_code"), F.min("is_het").alias("is_het"), F.max(carbon).alias("has_ca"),
        F.max("has_ter").alias("has_ter"),
        F.min_by(F.struct("x", "y", "z"), F.when(carbon, F.col("atom_ord"))).alias("ca"),
    ).withColumn("ca", F.when(F.col("has_ca"), F.col("ca")))
    chain = Window.partitionBy(*CHAIN)
    wanted = F.when(~F.col("is_het") | F.col("has_ca"), F.col("run"))
    return grouped.withColumn("_lo", F.min(wanted).over(chain)).withColumn("_hi", F.max(wanted).over(chain)).withColumn(
        "_real", F.max(~F.col("is_het")).over(chain)).where(
        "run BETWEEN _lo AND _hi AND (_real OR has_ter)").drop("_lo", "_hi", "_real")


def seqres(lines: DataFrame) -> DataFrame:
    """Residue names of SEQRES records per chain, in order (path, chain_id, seq_ord, res_name)."""
    named = lines.where((F.upper(field(0, 6)) == "SEQRES") & (F.length("line") >= 21)).select(
        "path", "line_no", field(11, 12).alias("chain_id"), field(8, 10).alias("_count"),
        F.posexplode(F.transform(F.sequence(F.lit(20), F.lit(68), F.lit(4)), lambda p: F.upper(F.substring("line", p, F.lit(3))))).alias("_k", "res_name"))
    blank = F.min(F.when(F.trim("res_name") == "", F.col("_k"))).over(Window.partitionBy("path", "line_no"))
    wanted = named.withColumn("_blank", blank).where(
        "(_blank IS NULL OR _k < _blank) AND NOT (_count = ' 0' AND res_name = 'UNK')")
    order = Window.partitionBy("path", "chain_id").orderBy("line_no", "_k")
    return wanted.select("path", "chain_id", (F.row_number().over(order) - 1).cast("int").alias("seq_ord"), "res_name")


def align_to_sequence(
    names: list[str], numbers: list[int], sequence: list[str], max_skips: int = SKIP_LIMIT
) -> list[tuple[int, int]] | None:
    """Pairs (atom residue, sequence position): fewest skipped residues, then fewest unexplained jumps."""
    n = len(names)
    limit = min(max_skips, n - 1)
    where = {name: np.array([i for i, s in enumerate(sequence) if s == name], dtype=int) for name in set(names)}
    cost: list[dict[int, tuple[int, int, tuple | None]]] = []
    for a in range(n):
        row: dict[int, tuple[int, int, tuple | None]] = {}
        for s in where[names[a]]:
            options = [(a, 0, None)] if a < limit else []
            for back in range(1, limit + 1):
                if a - back < 0:
                    break
                jump = numbers[a] - numbers[a - back]
                for s0, (skips, gaps, _) in cost[a - back].items():
                    if s0 < s and skips + back - 1 < limit:
                        step = s - s0
                        options.append((skips + back - 1, gaps + (step != 1 and step != jump), (a - back, s0)))
            if options:
                row[int(s)] = min(options, key=lambda o: o[:2])
        cost.append(row)
    ends = [
        (skips + n - 1 - a, gaps, a, s) for a in range(max(0, n - limit), n)
        for s, (skips, gaps, _) in cost[a].items() if skips + n - 1 - a < limit
    ]
    if not ends:
        return None
    _, _, a, s = min(ends)
    path = []
    at: tuple | None = (a, s)
    while at is not None:
        path.append(at)
        at = cost[at[0]][at[1]][2]
    return path[::-1]


def number_missing(numbers: list[int | None], codes: list[str]) -> tuple[list[int], list[str]]:
    """Number residues without one: down before the first, up after the last and from the left inside;
    where that would reach the right flank, the rest step back from it with codes Z, Y, ..."""
    known = [i for i, v in enumerate(numbers) if v is not None]
    numbers, codes = list(numbers), list(codes)
    if not known:
        return list(range(1, len(numbers) + 1)), codes
    for i in range(known[0] - 1, -1, -1):
        numbers[i] = numbers[i + 1] - 1
    for i in range(known[-1] + 1, len(numbers)):
        numbers[i] = numbers[i - 1] + 1
    for left, right in zip(known, known[1:]):
        for i in range(left + 1, right):
            following = numbers[i - 1] + 1 if codes[i - 1] in ("", " ") or i == left + 1 else None
            if following is not None and following < numbers[right]:
                numbers[i] = following
                continue
            for k, j in enumerate(range(right - 1, i - 1, -1)):
                numbers[j], codes[j] = numbers[right], chr(ord("Z") - k % 26)
            break
    return numbers, codes


_SEQ_SCHEMA = (
    "path string, model_ord int, model_no int, chain_id string, res_idx int, run int, res_name string, "
    "res_num int, ins_code string, x double, y double, z double"
)


_SEEN = ["run", "res_name", "res_num", "ins_code", "x", "y", "z"]


def _reconcile(rows: list[list], seq: list[str], max_skips: int) -> list[list]:
    """Residues of a chain (values of _SEEN, in order) completed from its sequence."""
    path = align_to_sequence([r[1] for r in rows], [int(r[2]) for r in rows], seq, max_skips) if rows and seq else None
    if path is not None:
        merged = []
        marks = [(-1, -1), *path, (len(rows), len(seq))]
        for (a0, s0), (a1, s1) in zip(marks, marks[1:]):
            if a1 - a0 > 1:
                merged.extend(rows[a0 + 1:a1])
            else:
                merged.extend([None, name, None, " ", None, None, None] for name in seq[s0 + 1:s1])
            if a1 < len(rows):
                merged.append(rows[a1])
        rows = merged
        numbers, codes = number_missing([None if r[2] is None else int(r[2]) for r in rows], [r[3] for r in rows])
        for r, v, c in zip(rows, numbers, codes):
            r[2], r[3] = v, c
    elif not rows:
        rows = [[None, name, k + 1, " ", None, None, None] for k, name in enumerate(seq)]
    return rows


def _reconcile_batches(batches: Iterator[pa.RecordBatch], max_skips: int) -> Iterator[pa.RecordBatch]:
    """A batch holds many chains, each as one row with its residues and its sequence."""
    schema = pa.schema([
        *zip(CHAIN, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True), ("res_idx", pa.int32()),
        *zip(_SEEN, (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()), strict=True)])
    for batch in batches:
        found = []
        for chain in batch.to_pylist():
            key = [chain[c] for c in CHAIN]
            rows = _reconcile([[r[c] for c in _SEEN] for r in chain["seen"]], [r["res_name"] for r in chain["named"]], max_skips)
            found.extend((*key, k, *r) for k, r in enumerate(rows))
        columns = zip(*found) if found else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def residues(lines: DataFrame, use_seqres: bool = True, renumber: bool = False, max_skips: int = SKIP_LIMIT) -> DataFrame:
    """Residue table of every chain: residues from atoms, completed from SEQRES where it aligns.

    At most ``max_skips`` - 1 residues of the atoms may be missing from the sequence.
    """
    seen = cut_lineage(atom_residues(atoms(lines)).select(
        *CHAIN, "run", "res_name", "res_num", "ins_code", F.col("ca.x").alias("x"), F.col("ca.y").alias("y"), F.col("ca.z").alias("z")))
    order = Window.partitionBy(*CHAIN).orderBy("run")
    plain = seen.withColumn("res_idx", (F.row_number().over(order) - 1).cast("int"))
    if use_seqres:
        chains = seen.select(*CHAIN).distinct()
        # chains that only SEQRES knows exist in every model, without coordinates
        models = chains.select("path", "model_ord", "model_no").distinct()
        named = seqres(lines).select("path", "chain_id").distinct().join(chains.select("path", "chain_id").distinct(), ["path", "chain_id"], "left_anti")
        chains = chains.unionByName(named.join(models, "path", "left").select(
            "path", F.coalesce("model_ord", F.lit(0)).alias("model_ord"), F.coalesce("model_no", F.lit(0)).alias("model_no"), "chain_id"))
        sequence = chains.join(seqres(lines), ["path", "chain_id"])
        covered = sequence.select(*CHAIN).distinct()
        one = seen.join(covered, CHAIN, "left_semi").select(*CHAIN, F.struct(*_SEEN).alias("seen"))
        two = sequence.select(*CHAIN, F.struct("seq_ord", "res_name").alias("named"))
        parts = spread(one.unionByName(two, allowMissingColumns=True), CHAIN).groupBy(*CHAIN).agg(
            *(F.array_sort(F.collect_list(c)).alias(c) for c in ("seen", "named")))
        small_batches(lines.sparkSession)
        aligned = parts.mapInArrow(lambda batches: _reconcile_batches(batches, max_skips), _SEQ_SCHEMA)
        plain = plain.join(covered, CHAIN, "left_anti").select(aligned.columns).unionByName(aligned)
    if renumber:
        plain = plain.withColumn("res_num", F.col("res_idx") + 1).withColumn("ins_code", F.lit(" "))
    return with_codes(plain)


def chain_names(lines: DataFrame, residue_rows: DataFrame) -> DataFrame:
    """One row per chain with its place in the file and its id string: the file name, its chain, or the one given by a remark."""
    remark = lines.where(F.col("line").rlike("^REMARK 987 CHAIN . FROM ")).select(
        "path", F.substring("line", 18, 1).alias("chain_id"), F.trim(F.expr("substring(line, 25)")).alias("_given")).dropDuplicates(["path", "chain_id"])
    base = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(gz|Z)$", ""), r"\.(pdb|ent)$", "")
    chains = residue_rows.groupBy(*CHAIN).agg(F.count(F.lit(1)).cast("int").alias("length"))
    first = lines.withColumn("_rec", F.upper(F.rpad(field(0, 6), 6, " "))).where(F.col("_rec").isin("ATOM  ", "HETATM", "SEQRES")).withColumn(
        "chain_id", F.when(F.col("_rec") == "SEQRES", field(11, 12)).otherwise(field(21, 22)))
    # file order: by the first atom of a chain, then by its first SEQRES line
    atom_line, any_line = F.min(F.when(F.col("_rec") != "SEQRES", F.col("line_no"))), F.min("line_no")
    first = first.groupBy("path", "chain_id").agg(F.struct(atom_line.isNull().alias("none"), F.coalesce(atom_line, any_line).alias("at")).alias("_first"))
    own = F.when(F.col("chain_id") == " ", base).otherwise(F.concat_ws(":", base, "chain_id"))
    placed = chains.join(first, ["path", "chain_id"], "left").withColumn(
        "file_ord", F.row_number().over(Window.partitionBy("path", "model_ord").orderBy("_first", "chain_id")) - 1).drop("_first")
    return placed.join(remark, ["path", "chain_id"], "left").select(*CHAIN, "length", "file_ord", F.coalesce("_given", own).alias("id_string"))


def ordered_records(lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Header or crystal lines in the order of their kinds, chain remarks left out."""
    rank = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.upper(F.rpad(field(0, 6), 6, " "))).cast("int")
    return lines.withColumn("kind_rank", rank).where("kind_rank > 0").where(~F.col("line").rlike("^REMARK 987")).select(
        "path", "kind_rank", "line_no", "line")


def annotation_lines(lines: DataFrame) -> DataFrame:
    """Cached annotation records, padded to 80 columns."""
    rec = F.upper(F.rpad(field(0, 6), 6, " "))
    return lines.where(rec.isin(*ANNOTATION_RECORDS)).select(
        "path", "line_no", rec.alias("rec"), F.rpad(F.substring("line", 1, 72), 80, " ").alias("line"))


def residue_numbers(residue_rows: DataFrame) -> DataFrame:
    """First residue of every model for every (chain, number, insertion code)."""
    return residue_rows.groupBy("path", "model_ord", "model_no", "chain_id", "res_num", "ins_code").agg(F.min("res_idx").alias("res_idx"))


def annotations(lines: DataFrame, residue_rows: DataFrame) -> dict[str, DataFrame]:
    """HELIX, SHEET, SSBOND, CISPEP, DBREF and SEQADV rows resolved to residue indices.

    Every model has its own rows; a CISPEP record with a model number belongs to that model only.  A
    record whose residues are not both found in a model is dropped there.
    """
    cached, lookup = annotation_lines(lines), residue_numbers(residue_rows)

    def resolve(rec: str, ends: list[tuple[int, int, int, int]], extra: list[Column]) -> DataFrame:
        rows = cached.where(F.col("rec") == rec)
        names = []
        for k, (chain, num, num_end, code) in enumerate(ends, 1):
            rows = rows.withColumn(f"_c{k}", field(chain, chain + 1)).withColumn(f"_n{k}", number(num, num_end)).withColumn(f"_i{k}", field(code, code + 1))
            found = lookup.select(
                "path", F.col("model_ord").alias(f"_m{k}"), F.col("model_no").alias(f"_o{k}"), F.col("chain_id").alias(f"_c{k}"), F.col("res_num").alias(f"_n{k}"), F.col("ins_code").alias(f"_i{k}"), F.col("res_idx").alias(f"res{k}"))
            rows = rows.join(found, ["path", f"_c{k}", f"_n{k}", f"_i{k}"])
            names.append(f"res{k}")
        rows = rows.where("_c1 = _c2 and _m1 = _m2")
        return rows.select("path", F.col("_m1").alias("model_ord"), F.col("_o1").alias("_model"), "line_no", F.col("_c1").alias("chain_id"), *names, *extra)

    length = (F.col("res2") - F.col("res1") + 1).alias("length")
    found = {
        "helices": resolve("HELIX ", [(19, 21, 25, 25), (31, 33, 37, 37)], [
            number(38, 40).alias("class"), F.trim(field(11, 14)).alias("helix_id"), field(40, 70).alias("comment"), length]),
        "strands": resolve("SHEET ", [(21, 22, 26, 26), (32, 33, 37, 37)], [
            F.trim(field(11, 14)).alias("sheet_id"), number(7, 10).alias("strand"), number(38, 40).alias("sense"), length]),
        "ssbonds": resolve("SSBOND", [(15, 17, 21, 21), (29, 31, 35, 35)], [
            F.trim(field(59, 65)).alias("symmetry1"), F.trim(field(66, 72)).alias("symmetry2")]),
        "cispeps": resolve("CISPEP", [(15, 17, 21, 21), (29, 31, 35, 35)], [
            number(43, 46).alias("model_no"), number(53, 59, "double").alias("angle")]),
        "dbrefs": resolve("DBREF ", [(12, 14, 18, 18), (12, 20, 24, 24)], [
            F.trim(field(26, 32)).alias("database"), F.trim(field(33, 41)).alias("accession"), F.trim(field(42, 54)).alias("code")]),
        "seqadvs": resolve("SEQADV", [(16, 18, 22, 22), (16, 18, 22, 22)], [
            F.trim(field(24, 28)).alias("database"), F.trim(field(29, 38)).alias("accession"), F.trim(field(49, 70)).alias("conflict")]),
    }
    found["cispeps"] = found["cispeps"].where("coalesce(model_no, 0) in (0, _model)")
    return {name: rows.drop("_model") for name, rows in found.items()}


def sheet_pairs(lines: DataFrame, residue_rows: DataFrame) -> DataFrame:
    """Strand pairs that SHEET records register: path, model_ord, chain_id, sheet_id, strand, start1, start2, direction, length.

    A record names one residue of its strand and the residue of the strand before that it is bonded to.
    Parallel bonds join residues one apart, so one of the two moves by one, away from the bonded atom.
    From that pair the ladder is carried back and forth as far as both strands reach.  A record opens a
    sheet anew if the one before it has another sheet or chain or was not understood; ladders of one
    residue are dropped; the lower strand comes first.
    """
    lookup = residue_numbers(residue_rows)
    # fixed columns of (chain, number, insertion code): first and last residue, registered one, its partner in the strand before
    places = {"start": (21, 22, 26), "end": (32, 33, 37), "cur": (49, 50, 54), "prev": (64, 65, 69)}
    rows = annotation_lines(lines).where("rec = 'SHEET '").join(lookup.select("path", "model_ord").distinct(), "path")
    for name, (chain, num, code) in places.items():
        keys = {f"_c_{name}": field(chain, chain + 1), f"_n_{name}": number(num, code), f"_i_{name}": field(code, code + 1)}
        found = lookup.select(
            "path", "model_ord", *(F.col(c).alias(k) for k, c in zip(keys, ("chain_id", "res_num", "ins_code"))), F.col("res_idx").alias(name))
        rows = rows.withColumns(keys).join(found, ["path", "model_ord", *keys], "left")
    rows = rows.select(
        "path", "model_ord", "line_no", F.col("_c_start").alias("chain_id"), field(11, 14).alias("sheet_id"), number(7, 10).alias("strand"),
        number(38, 40).alias("direction"), (field(42, 43) == "N").alias("at_n"), *places,
        ((F.col("_c_start") == F.col("_c_end")) & (F.col("_c_cur") == F.col("_c_prev"))).alias("sound"),
        (F.col("_c_cur") == F.col("_c_start")).alias("inside"))
    fields = ["line_no", "chain_id", "sheet_id", "strand", "direction", "at_n", *places, "sound", "inside"]
    scan = rows.groupBy("path", "model_ord").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"))
    kept = [c for c in fields if c not in ("sound", "inside")]
    kinds = {"chain_id": "string", "sheet_id": "string", "at_n": "boolean"}
    nothing = F.array().cast("array<struct<" + ",".join(f"{c}:{kinds.get(c, 'int')}" for c in (*kept, "low", "high")) + ">>")
    none = F.lit(None).cast("int")

    def step(state: Column, x: Column) -> Column:
        """The strand before (chain NULL: none) and the records registered so far."""
        def then(chain: Column, found: Column = None) -> Column:
            low, high = (F.when(chain.isNotNull(), x[c]).otherwise(none) for c in ("start", "end"))
            return F.struct(chain.alias("chain"), x["sheet_id"].alias("sheet"), low.alias("low"), high.alias("high"),
                            (state["found"] if found is None else found).alias("found"))

        lost, here = F.lit(None).cast("string"), F.when(x["start"].isNotNull() & x["end"].isNotNull(), x["chain_id"])
        first = ~F.coalesce((state["chain"] == x["chain_id"]) & (state["sheet"] == x["sheet_id"]), F.lit(False))
        usable = x["inside"] & x["direction"].isin(1, -1) & here.isNotNull() & x["cur"].isNotNull() & x["prev"].isNotNull()
        row = F.struct(*(x[c].cast(kinds.get(c, "int")).alias(c) for c in kept), state["low"].alias("low"), state["high"].alias("high"))
        return F.when(~x["sound"], then(lost)).when(first, then(here)).when(F.coalesce(usable, F.lit(False)), then(here, F.concat(state["found"], F.array(row)))).otherwise(then(lost))

    begin = F.struct(F.lit(None).cast("string").alias("chain"), F.lit(None).cast("string").alias("sheet"), none.alias("low"), none.alias("high"), nothing.alias("found"))
    rows = scan.select("path", "model_ord", F.inline(F.aggregate("records", begin, step, lambda state: state["found"])))
    up, start, end = F.col("direction") == 1, F.col("start"), F.col("end")
    cur_moves = F.when(F.col("at_n"), F.when(F.col("cur") < start, -1)).otherwise(F.when(F.col("cur") > end, 1))
    prev_moves = F.when(F.col("at_n"), 1).otherwise(-1)
    rows = rows.withColumns({
        "cur": F.col("cur") + F.when(up, F.coalesce(cur_moves, F.lit(0))).otherwise(0),
        "prev": F.col("prev") + F.when(up & cur_moves.isNull(), prev_moves).otherwise(0)})
    back = F.greatest(F.lit(0), F.least(F.col("prev") - F.col("low"), F.when(up, F.col("cur") - start).otherwise(end - F.col("cur"))))
    rows = rows.withColumn("_back", back).withColumns({"prev": F.col("prev") - F.col("_back"), "cur": F.col("cur") - F.col("direction") * F.col("_back")})
    on = F.greatest(F.lit(0), F.least(F.col("high") - F.col("prev"), F.when(up, end - F.col("cur")).otherwise(F.col("cur") - start)))
    swap, turn = F.col("prev") >= F.col("cur"), F.when(up, 0).otherwise(F.col("length") - 1)
    return rows.withColumn("length", (on + 1).cast("int")).where("length >= 2").select(
        "path", "model_ord", "chain_id", F.trim("sheet_id").alias("sheet_id"), "strand",
        F.when(swap, F.col("cur") - turn).otherwise(F.col("prev")).cast("int").alias("start1"),
        F.when(swap, F.col("prev") + turn).otherwise(F.col("cur")).cast("int").alias("start2"), "direction", "length")

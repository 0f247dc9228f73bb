"""Job lists and chain selectors.

A selector is ``path[:group{,group}]``; a group is ``[chains][:model]``; each chain is one letter with
an optional residue range ``(first[code]-last[code])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PREFIX = "alignment"


def split_jobs(lines: DataFrame, default_prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """List-file lines (line_no, line) to selectors (job_id, out_prefix, sel_ord, selector).

    ``-o prefix`` starts a new job; blank lines and lines starting with # are skipped.  The running
    count needs one order over the list; lists from several files are split by ``path`` when present.
    """
    keys = ["path"] if "path" in lines.columns else []
    trimmed = lines.withColumn("line", F.trim("line")).where("line <> '' AND NOT line LIKE '#%'")
    prefix = F.when(F.col("line").rlike(r"^-o\s+"), F.trim(F.regexp_replace("line", r"^-o\s+", "")))
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = trimmed.withColumn("_p", prefix)
    numbered = marked.withColumn("job_id", F.count("_p").over(order)).withColumn(
        "out_prefix", F.coalesce(F.last("_p", ignorenulls=True).over(order), F.lit(default_prefix)))
    inside = Window.partitionBy(*keys, "job_id").orderBy("line_no")
    return numbered.where("_p IS NULL").select(
        *keys, "job_id", "out_prefix", (F.row_number().over(inside) - 1).cast("int").alias("sel_ord"), F.col("line").alias("selector"))


def parse_selectors(selectors: DataFrame) -> DataFrame:
    """One row per requested chain.

    Adds file, has_selector, model (NULL = first), chain (NULL = all), range_first, code_first,
    range_last, code_last and the order columns group_ord, chain_ord.
    """
    kept = selectors.columns
    body = F.expr("CASE WHEN instr(selector, ':') > 0 THEN substring(selector, instr(selector, ':') + 1) END")
    split = selectors.withColumn("file", F.expr("CASE WHEN instr(selector, ':') > 0 THEN left(selector, instr(selector, ':') - 1) ELSE selector END")).withColumn(
        "_body", F.when(body != "", body)).withColumn("has_selector", F.col("_body").isNotNull())
    groups = split.select(*kept, "file", "has_selector", F.posexplode(F.split(F.coalesce("_body", F.lit("")), ",")).alias("group_ord", "_group"))
    chains = groups.withColumn("model", F.expr(r"try_cast(nullif(regexp_extract(_group, ':([0-9]+)$', 1), '') AS int)")).withColumn(
        "_chains", F.regexp_replace("_group", r":[0-9]*$", ""))
    tokens = chains.withColumn("_tokens", F.expr(r"regexp_extract_all(_chains, '[^()](?:[(][^)]*[)])?', 0)"))
    exploded = tokens.select(*kept, "file", "has_selector", "group_ord", "model", F.posexplode_outer("_tokens").alias("chain_ord", "_token"))
    pattern = r"^.[(](-?[0-9]+)([A-Za-z]?)-(-?[0-9]+)([A-Za-z]?)[)]$"

    def part(k: int) -> str:
        return f"nullif(regexp_extract(_token, '{pattern}', {k}), '')"

    return exploded.select(
        *kept, "file", "has_selector", "group_ord", F.coalesce("chain_ord", F.lit(0)).alias("chain_ord"), "model",
        F.substring("_token", 1, 1).alias("chain"), F.expr(f"try_cast({part(1)} AS int)").alias("range_first"),
        F.expr(part(2)).alias("code_first"), F.expr(f"try_cast({part(3)} AS int)").alias("range_last"), F.expr(part(4)).alias("code_last"))


def select_chains(requests: DataFrame, chains: DataFrame, residues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve requests against loaded chains: (selected chains, problems).

    ``requests`` carry ``path`` (the resolved file, NULL if unreadable).  Selected chains have job_id,
    chain (ordinal in the job), path, model_ord, chain_id, first_idx, last_idx, id_string.  Problems
    (unreadable file, missing model or chain, bad range, fewer than two chains) are rows, not errors.
    """
    keys = ["path", "model_ord", "chain_id"]
    models = chains.groupBy("path", "model_ord").agg(F.min("model_no").alias("model_no"), F.count(F.lit(1)).alias("n_chains"))
    firsts = chains.groupBy("path").agg(F.min("model_ord").alias("first_ord"))
    ids = ["job_id", "sel_ord", "group_ord", "chain_ord"]
    req = requests.join(firsts, "path", "left")
    asked = F.when(F.col("model").isNull(), F.col("model_ord") == F.col("first_ord")).otherwise(F.col("model_no") == F.col("model"))
    placed = req.join(models.withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & asked, "left").drop("_path")
    wanted = placed.withColumnRenamed("chain", "_want")
    matched = wanted.join(chains.select(*keys, "id_string", "length", "file_ord"), ["path", "model_ord"], "left").where(
        F.col("_want").isNull() & ((F.col("chain_id") != " ") | (F.col("n_chains") == 1)) | (F.col("_want") == F.col("chain_id")))
    numbers = residues.groupBy(*keys, "res_num", "ins_code").agg(F.min("res_idx").alias("_idx"))

    def bound(df: DataFrame, num: str, code: str, out: str) -> DataFrame:
        found = numbers.select(*keys, F.col("res_num").alias(num), F.col("ins_code").alias("_code"), F.col("_idx").alias(out))
        return df.withColumn("_code", F.coalesce(code, F.lit(" "))).join(found, [*keys, num, "_code"], "left").drop("_code")

    ranged = bound(bound(matched, "range_first", "code_first", "_from"), "range_last", "code_last", "_to")
    ok = F.col("range_first").isNull() | (F.col("_from").isNotNull() & F.col("_to").isNotNull() & (F.col("_to") >= F.col("_from")))
    good = ranged.where(ok)
    order = Window.partitionBy("job_id").orderBy("sel_ord", "group_ord", "chain_ord", "file_ord", "chain_id")
    chosen = good.withColumn("chain", (F.row_number().over(order) - 1).cast("long")).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("job_id")))
    selected = chosen.where("_n >= 2").select(
        "job_id", "chain", *keys, F.coalesce("_from", F.lit(0)).alias("first_idx"),
        F.coalesce("_to", F.col("length") - 1).alias("last_idx"), "id_string")

    def problem(df: DataFrame, text: str) -> DataFrame:
        return df.select("job_id", "sel_ord", F.lit(text).alias("problem"))

    missing_chain = wanted.where("model_ord IS NOT NULL").join(matched.select(*ids).distinct(), ids, "left_anti")
    few = requests.select("job_id").distinct().join(selected.select("job_id").distinct(), "job_id", "left_anti").select(
        "job_id", F.lit(None).cast("int").alias("sel_ord"))
    problems = (
        problem(req.where("first_ord IS NULL"), "cannot read structure")
        .unionByName(problem(placed.where("model_ord IS NULL AND first_ord IS NOT NULL"), "no such model"))
        .unionByName(problem(missing_chain, "no such chain"))
        .unionByName(problem(ranged.where(~ok), "bad residue range"))
        .unionByName(problem(few, "fewer than two chains"))
    )
    return selected, problems


def job_residues(selected: DataFrame, residues: DataFrame) -> DataFrame:
    """Residues of the selected chains, renumbered from 0 inside a range, as the engine's input."""
    return selected.join(residues, ["path", "model_ord", "chain_id"]).where("res_idx BETWEEN first_idx AND last_idx").select(
        "job_id", "chain", (F.col("res_idx") - F.col("first_idx")).cast("int").alias("res_idx"), "letter", "res_name", "res_num",
        "ins_code", "x", "y", "z")

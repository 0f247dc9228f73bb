"""Repair of conversation structure by a run-length min-plus dynamic program.

A conversation should read ``(s?(ua)+)?`` in its role initials.  Rows are kept (K), given another
role (R), deleted (D) or inserted (I) at least cost, see ``COSTS``.  A row matters to the costs only
through its symbol, the role initial with its fault; equal consecutive symbols are a run.  The costs
of a row are a 4 x 4 matrix over the grammar's states, those of a run its power in the min-plus
semiring, taken from cached binary powers.  From the last run backwards this gives the cost to go
at every run's end; forwards the edits are unrolled, halving each run with the same powers, and
the letter that is least in ASCII wins among cheapest ones.  Unrolled runs are remembered.

Rows are sorted by range of (conversation, turn) and one pass over a range repairs the conversations
that lie wholly inside it.  Matrices multiply associatively, so conversations that reach over a
range's border, and any that outgrow ``BUFFER_ROWS``, are repaired in pieces: one matrix a piece, costs
to go at the piece's ends from the matrices of a conversation (one a range at most), four possible
unrollings a piece, of which the true one is picked along the pieces.  No task holds more rows than
a range, whatever share one conversation has.  Only the digest of a repaired conversation reads its
text in one task, in order and in blocks, as SHA-256 must.

Defined results: null roles and texts are one space, null turns come first; rows of equal turn are
ordered by role, text and a digest of both; the null id is a conversation of its own; repeated
conversations' rows fall together under their id; rows marked absent only name their conversation,
whose result has zeros, an empty audit and the digest of the empty string if nothing else is left;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import prepare, same
from foldloom.session import cut_lineage

#: Cost of each edit, and of a truncated row that stays.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5, "truncated": 5}
#: Most rows and characters of a conversation that a pass holds before it is repaired in pieces.
BUFFER_ROWS, BUFFER_CHARS = 20_000, 4_000_000
#: Characters of a block of repaired text.
BLOCK_CHARS = 1_000_000
SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after s, after u, after a.  The grammar ends in the first or the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FAR = 1 << 60
NEXT_FREE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # where a user or assistant row leads
KEEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "o": {}}
#: A symbol is a role class with - (sound) or t (truncated), or x for a row that must go.
GONE = "x"
Costs = tuple[int, int, int, int]
Matrix = tuple[Costs, ...]


def options(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, letters in ASCII order."""
    out = [("D", COSTS["D"], state)]
    if symbol != GONE:
        extra = COSTS["truncated"] if symbol[1] == "t" else 0
        if state in KEEPS[symbol[0]]:
            out.append(("K", COSTS["K"] + extra, KEEPS[symbol[0]][state]))
        out.append(("R", COSTS["R"] + extra, NEXT_FREE[state]))
    return out


def with_inserts(costs: Costs) -> Costs:
    """Costs to go if rows may be inserted first; three inserts only repeat one."""
    best = costs
    for _ in range(2):
        best = tuple(min(costs[q], COSTS["I"] + best[NEXT_FREE[q]]) for q in range(4))
    return best


END: Costs = with_inserts((0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """Transition of ``2 ** k`` rows of a symbol."""
    if k:
        return multiply(power(symbol, k - 1), power(symbol, k - 1))
    rows = []
    for state in range(4):
        # inserted rows first: one column at a time is the cost to go to that state
        rows.append([min((c for _, c, q in options(symbol, state) if q == goal), default=FAR) for goal in range(4)])
    columns = [with_inserts(tuple(rows[q][goal] for q in range(4))) for goal in range(4)]
    return tuple(tuple(min(columns[goal][q], FAR) for goal in range(4)) for q in range(4))


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def run_matrix(symbol: str, n: int) -> Matrix | None:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power(symbol, k) if out is None else multiply(out, power(symbol, k))
    return out


def before(matrix: Matrix, costs: Costs) -> Costs:
    return tuple(min(row[k] + costs[k] for k in range(4)) for row in matrix)


def before_run(symbol: str, n: int, costs: Costs) -> Costs:
    """Costs to go ahead of ``n`` rows, from those behind them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs = before(power(symbol, k), costs)
    return costs


@lru_cache(maxsize=20_000)
def unroll_run(symbol: str, n: int, state: int, behind: Costs) -> tuple[str, int]:
    """Edits of a run and the state after it; ``behind`` may be short of any constant."""
    if n > 1:
        half = n // 2
        first, state = unroll_run(symbol, half, state, lowered(before_run(symbol, n - half, behind)))
        second, state = unroll_run(symbol, n - half, state, behind)
        return first + second, state
    ahead = before_run(symbol, 1, behind)
    letters = ""
    while True:
        found = {letter: q for letter, cost, q in options(symbol, state) if cost + behind[q] == ahead[state]}
        if COSTS["I"] + ahead[NEXT_FREE[state]] == ahead[state]:
            found["I"] = NEXT_FREE[state]
        letter = min(found)
        letters, state = letters + letter, found[letter]
        if letter != "I":
            return letters, state


def lowered(costs: Costs) -> Costs:
    least = min(costs)
    return tuple(c - least for c in costs)


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in rows)) for s, rows in groupby(symbols)]


def unroll(runs: list[tuple[str, int]], behind: Costs, starts: tuple[int, ...]) -> tuple[Costs, list[tuple[str, int]]]:
    """Costs to go ahead of the runs, and for each start state the edits and the state after them."""
    costs = [behind]
    for symbol, n in reversed(runs):
        costs.append(before_run(symbol, n, costs[-1]))
    costs.reverse()
    out = []
    for state in starts:
        letters = []
        for (symbol, n), after in zip(runs, costs[1:], strict=True):
            edits, state = unroll_run(symbol, n, state, lowered(after))
            letters.append(edits)
        out.append(("".join(letters), state))
    return costs[0], out


def closing(state: int) -> str:
    """Inserts that end the grammar."""
    return {AFTER_S: "II", AFTER_U: "I"}.get(state, "")


def repaired(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """Lines ``role:text`` that the edits leave of rows (role, text)."""
    for letter in edits:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEEPS[role[0]][state]
        else:
            state = NEXT_FREE[state]
            role = "user" if state == AFTER_U else "assistant"
        yield f"{role}:{text}"


def symbol_of(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(symbol, fault) of a row."""
    words = text.strip(SPACE)
    if not words or seen:
        return GONE, "duplicate" if words else "blank"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (f"{kind}-", "") if words[-1] in ".!?" else (f"{kind}t", "truncated")


LEGAL = {"su", "ua", "au"}
RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def illegal_pairs(initials: list[str]) -> int:
    return sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))


def repair_rows(rows: list[tuple[int | None, str, str]]) -> tuple:
    """Result of one conversation, rows (turn, role, text) in order: the RESULTS, audit, digest."""
    seen: set[tuple[str, str]] = set()
    symbols, faults = [], []
    for _, role, text in rows:
        symbol, fault = symbol_of(role, text, (role, text) in seen)
        seen.add((role, text))
        symbols.append(symbol)
        faults.append(fault)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    costs, [(edits, state)] = unroll(runs_of(symbols), END, (START,))
    edits += closing(state)
    lines = "\n".join(repaired(edits, START, iter([(role, text) for _, role, text in rows])))
    return (
        gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        illegal_pairs([role[:1] for _, role, _ in rows]), costs[START], edits, hashlib.sha256(lines.encode()).hexdigest())


def walk_range(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of the conversations wholly inside a sorted range, and the rows of the others, numbered."""
    at = TaskContext.get().partitionId() << 33
    held: list[tuple] = []
    chars, whole = 0, False  # the first conversation may have begun in the range before
    current: tuple | None = None
    done: list[tuple] = []
    open_rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        results = list(zip(*done, strict=True)) or [()] * 9
        rows = list(zip(*open_rows, strict=True)) or [()] * 6
        n, m = len(done), len(open_rows)
        names = dict(zip(("conv", *RESULTS, "audit", "repaired_sha256"), results, strict=True))
        loose = dict(zip(("conv", "at", "turn", "role", "text", "absent"), rows, strict=True))
        columns = [
            [*names["conv"], *loose["conv"]] if f.name == "conv" else
            [*(names.get(f.name) or [None] * n), *(loose.get(f.name) or [None] * m)] for f in schema]
        done.clear()
        open_rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def give_up() -> None:
        nonlocal at
        for conv, turn, role, text, absent in held:
            open_rows.append((conv, at, turn, role, text, absent))
            at += 1
        held.clear()

    for source in batches:
        for row in zip(*(source.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "absent")), strict=True):
            if current is None or row[0] != current[0]:
                if whole and held:
                    present = [r[1:4] for r in held if not r[4]]
                    done.append((held[0][0], *repair_rows(present)))
                    held.clear()
                whole, chars = current is not None, 0
                current = (row[0],)
            held.append(row)
            chars += len(row[3])
            if not whole or len(held) > BUFFER_ROWS or chars > BUFFER_CHARS:
                whole = False
                give_up()
        if done or open_rows:
            yield batch()
    give_up()
    if done or open_rows:
        yield batch()


def piece_matrix(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    rows = rows[~rows["absent"]]
    initials = rows["initial"].tolist()
    matrix = None
    for symbol, n in runs_of(rows["symbol"].tolist()):
        step = run_matrix(symbol, n)
        matrix = step if matrix is None else multiply(matrix, step)
    flat = None if matrix is None else [c for row in matrix for c in row]
    return pd.DataFrame({
        "conv": [rows["conv"].iloc[0] if len(rows) else key[0]], "part": [key[1]], "matrix": [flat], "illegal": [illegal_pairs(initials)],
        "first": [initials[0] if initials else None], "last": [initials[-1] if initials else None]})


def piece_costs(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind every piece of a conversation; its cost and illegal pairs on the first."""
    pieces = pieces.sort_values("part")
    behind, costs = [], END
    for flat in reversed(pieces["matrix"].tolist()):
        behind.append(list(costs))
        if flat is not None:
            costs = before(tuple(tuple(int(c) for c in flat[4 * q:4 * q + 4]) for q in range(4)), costs)
    edges = [(a, b) for a, b, flat in zip(pieces["first"], pieces["last"], pieces["matrix"], strict=True) if flat is not None]
    illegal = int(pieces["illegal"].sum()) + sum(a[1] + b[0] not in LEGAL for a, b in zip(edges, edges[1:], strict=False))
    top = [True] + [False] * (len(pieces) - 1)
    return pd.DataFrame({
        "conv": [key[0]] * len(pieces), "part": pieces["part"], "behind": behind[::-1],
        "cost": [costs[START] if t else 0 for t in top], "illegal": [illegal if t else 0 for t in top]})


def piece_edits(key: tuple, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """The four unrollings of a piece."""
    rows = rows.sort_values("at")
    rows = rows[~rows["absent"]]
    _, ways = unroll(runs_of(rows["symbol"].tolist()), tuple(int(c) for c in plan["behind"].iloc[0]), (0, 1, 2, 3))
    return pd.DataFrame({"conv": [key[0]], "part": [key[1]], "edits": [[e for e, _ in ways]], "states": [[q for _, q in ways]]})


def picked_edits(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("part")
    state, out = START, []
    for part, edits, states in zip(pieces["part"], pieces["edits"], pieces["states"], strict=True):
        out.append([key[0], part, state, edits[state]])
        state = int(states[state])
    if out:
        out[-1][3] += closing(state)
    return pd.DataFrame(out, columns=["conv", "part", "state", "edits"])


def piece_text(key: tuple, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """Repaired lines of a piece in blocks, each line with its line end."""
    rows = rows.sort_values("at")
    rows = rows[~rows["absent"]]
    blocks, block, size = [], [], 0
    for line in repaired(plan["edits"].iloc[0], int(plan["state"].iloc[0]), zip(rows["role"], rows["text"], strict=True)):
        block.append(line + "\n")
        size += len(line)
        if size > BLOCK_CHARS:
            blocks.append("".join(block))
            block, size = [], 0
    if block:
        blocks.append("".join(block))
    return pd.DataFrame({"conv": [key[0]] * len(blocks), "part": [key[1]] * len(blocks), "ord": range(len(blocks)), "block": pd.Series(blocks, dtype=object)})


def digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of each conversation, which come in order; the last line end is left out."""
    current, digest, waiting = None, None, ""
    for batch in batches:
        for conv, block in zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if current is None or conv != current[0]:
                if current is not None:
                    digest.update(waiting[:-1].encode())
                    yield pa.RecordBatch.from_pydict({"conv": [current[0]], "repaired_sha256": [digest.hexdigest()]}, schema=schema)
                current, digest, waiting = (conv,), hashlib.sha256(), ""
            digest.update(waiting.encode())
            waiting = block
    if current is not None:
        digest.update(waiting[:-1].encode())
        yield pa.RecordBatch.from_pydict({"conv": [current[0]], "repaired_sha256": [digest.hexdigest()]}, schema=schema)


def symbols(rows: DataFrame) -> DataFrame:
    """Faults and symbols of open rows; what was seen earlier is joined on the row's number, a unique key."""
    present = rows.where("not absent")
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = present.groupBy("conv", mark.alias("h")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    words = F.btrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(F.col("absent"), "").when(words == "", "blank").when(F.col("is_first").isNull(), "duplicate")
        .when(~F.right(words, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(fault.isin("blank", "duplicate"), GONE).otherwise(F.concat(kind, F.when(fault == "truncated", "t").otherwise("-")))
    return rows.join(firsts, "at", "left").select(
        "conv", F.shiftright("at", 33).alias("part"), "at", "turn", "absent", initial.alias("initial"), fault.alias("fault"), symbol.alias("symbol"))


def repair_in_pieces(rows: DataFrame) -> DataFrame:
    """(conv, RESULTS, audit, repaired_sha256) of written rows (conv, at, turn, role, text, absent)."""
    kind = rows.schema["conv"].dataType.simpleString()
    marked = cut_lineage(symbols(rows))
    by_piece = marked.groupBy("conv", "part")
    matrices = by_piece.applyInPandas(
        piece_matrix, f"conv {kind}, part long, matrix array<long>, illegal long, first string, last string")
    plan = cut_lineage(matrices.groupBy("conv").applyInPandas(piece_costs, f"conv {kind}, part long, behind array<long>, cost long, illegal long"))
    edits = by_piece.cogroup(plan.groupBy("conv", "part")).applyInPandas(
        piece_edits, f"conv {kind}, part long, edits array<string>, states array<int>")
    picked = cut_lineage(edits.groupBy("conv").applyInPandas(picked_edits, f"conv {kind}, part long, state int, edits string"))
    blocks = rows.withColumn("part", F.shiftright("at", 33)).groupBy("conv", "part").cogroup(picked.groupBy("conv", "part")).applyInPandas(
        piece_text, f"conv {kind}, part long, ord int, block string")
    arrow = pa.schema([("conv", arrow_type(rows)), ("repaired_sha256", pa.string())])
    ordered = blocks.repartition("conv").sortWithinPartitions("conv", "part", "ord").select("conv", "block")
    hashed = ordered.mapInArrow(lambda it: digests(it, arrow), f"conv {kind}, repaired_sha256 string")

    audits = picked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "edits"))).alias("p")).select(
        "conv", F.array_join("p.edits", "").alias("audit"))
    totals = plan.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    faults = marked.groupBy("conv").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = marked.where("not absent").select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = totals
    for other in (audits, faults, turns, hashed):
        other = other.withColumnRenamed("conv", "c")
        out = out.join(other, same(F.col("conv"), F.col("c")), "left").drop("c")
    return out.select(
        "conv", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in RESULTS], "audit",
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv"].dataType)


def repair(turns: DataFrame, conv_col: str = "conv_id", absent: Column | None = None) -> DataFrame:
    """Per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has turn, role and text; rows where ``absent`` holds only name their conversation.
    """
    prepare(turns.sparkSession)
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(False) if absent is None else absent).alias("absent"))
    # the last key tells repeated rows apart, so that a range's border can fall between them
    order = [
        F.col("conv"), F.col("turn"), F.left("role", F.lit(32)), F.left("text", F.lit(64)), F.md5(F.concat_ws("\x00", "role", "text")),
        F.monotonically_increasing_id()]
    keys = [f"k{i}" for i in range(len(order))]
    rows = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    kind = arrow_type(rows)
    long = pa.int64()
    schema = pa.schema([
        ("conv", kind), ("at", long), ("turn", long), ("role", pa.string()), ("text", pa.string()), ("absent", pa.bool_()),
        *((n, long) for n in RESULTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    name = turns.schema[conv_col].dataType.simpleString()
    ddl = f"conv {name}, at long, turn long, role string, text string, absent boolean, " + ", ".join(
        f"{n} long" for n in RESULTS) + ", audit string, repaired_sha256 string"
    walked = cut_lineage(rows.mapInArrow(lambda it: walk_range(it, schema), ddl))
    results = ["conv", *RESULTS, "audit", "repaired_sha256"]
    whole = walked.where("at is null").select(results)
    pieces = repair_in_pieces(walked.where("at is not null").select("conv", "at", "turn", "role", "text", "absent"))
    return whole.unionByName(pieces).withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted damage by ``crc32(conv_id:turn) % 20``; rows it drops are marked absent.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("absent"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")

"""Secondary structure from backbone atoms: hydrogen bonds, helices, strand pairs and sheets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import geometry as g
from foldloom.operators.radius import radius_join

CHAIN = ["job_id", "chain"]
# Energy model of the hydrogen bond.
BOND_CONSTANT = -27888.0
BOND_CUTOFF = -500.0
BOND_REACH = 9.0
#: Residues of a chain that all meet when bonds are looked for; longer chains go over grid cells.
SHORT_CHAIN = 300
CLASH_DISTANCE = 0.5
CLASH_ENERGY = -9900.0
# Helix kinds as (bond step, class code).
HELIX_KINDS = ((4, 1), (3, 5), (5, 3))


def _atom(prefix: str) -> tuple[Column, Column, Column]:
    return g.vec(*(f"{prefix}{c}" for c in "xyz"))


def hydrogen_bonds(backbone: DataFrame) -> DataFrame:
    """Best two acceptors (energy below the cutoff) of every donor.

    ``backbone``: job_id, chain, res_idx, letter and nx..nz, cax..caz, cx..cz, ox..oz (NULL if missing).
    The hydrogen sits one unit from N along the reversed C=O of the residue before.  Acceptors come
    from a join on alpha carbons, in chains that are not short over grid cells.  Result: job_id, chain, donor, acceptor, energy, rank.
    """
    backbone = backbone.withColumn("_short", F.count(F.lit(1)).over(Window.partitionBy(*CHAIN)) <= SHORT_CHAIN)
    order = Window.partitionBy(*CHAIN).orderBy("res_idx")
    near = F.lag("res_idx").over(order) == F.col("res_idx") - 1
    back = backbone.select(
        "*", *(F.when(near, F.lag(f"{a}{c}").over(order)).alias(f"_p{a}{c}") for a in "co" for c in "xyz"))
    unit = g.normalise(g.subtract(_atom("_pc"), _atom("_po")))
    donors = back.where("letter <> 'P' AND cx IS NOT NULL AND ox IS NOT NULL").select(
        *CHAIN, F.col("cax").alias("x"), F.col("cay").alias("y"), F.col("caz").alias("z"), "res_idx", "_short", "nx", "ny", "nz",
        *(h.alias(f"h{c}") for c, h in zip("xyz", g.add(unit, _atom("n"))))).where("hx IS NOT NULL AND x IS NOT NULL")
    acceptors = backbone.where("cax IS NOT NULL AND cx IS NOT NULL AND ox IS NOT NULL").select(
        *CHAIN, F.col("cax").alias("x"), F.col("cay").alias("y"), F.col("caz").alias("z"), "res_idx", "_short",
        "cx", "cy", "cz", "ox", "oy", "oz")
    pairs = radius_join(donors, acceptors, BOND_REACH, CHAIN, hot_cell=None, small="_short").where("b_res_idx <> a_res_idx AND b_res_idx <> a_res_idx - 1")
    h, n, c, o = _atom("a_h"), _atom("a_n"), _atom("b_c"), _atom("b_o")
    apart = {"ho": g.distance(h, o), "hc": g.distance(h, c), "no": g.distance(n, o), "nc": g.distance(n, c)}
    measured = pairs.select(*CHAIN, F.col("a_res_idx").alias("donor"), F.col("b_res_idx").alias("acceptor"),
                            *(v.alias(f"_{k}") for k, v in apart.items()))
    clash = F.least("_ho", "_hc", "_no", "_nc") < CLASH_DISTANCE
    inverse = {k: F.try_divide(F.lit(1.0), F.col(f"_{k}")) for k in apart}
    energy = F.when(clash, F.lit(CLASH_ENERGY)).otherwise(
        BOND_CONSTANT * (inverse["ho"] - inverse["hc"] + inverse["nc"] - inverse["no"]))
    best = Window.partitionBy(*CHAIN, "donor").orderBy("energy", "acceptor")
    return measured.withColumn("energy", energy).where(F.col("energy") < BOND_CUTOFF).withColumn(
        "rank", F.row_number().over(best)).where("rank <= 2").select(*CHAIN, "donor", "acceptor", "energy", "rank")


def helices(bonds: DataFrame) -> DataFrame:
    """Runs of at least two consecutive bonds between i and i+k (k = 4, 3, 5), either way round.

    A chain is scanned once for each k: a helix masks the positions of its run, so that a run of the
    other direction inside it is not reported and one that reaches out of it begins behind it; at one
    position bonds pointing forward come first.  They span one residue less than bonds pointing back.
    Result: job_id, chain, start, length, class.
    """
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(c).alias("class")) for k, c in HELIX_KINDS)))
    marked = bonds.select(
        *CHAIN, F.least("donor", "acceptor").alias("i"), F.abs(F.col("donor") - F.col("acceptor")).alias("_step"),
        (F.col("donor") > F.col("acceptor")).alias("back"), kinds.alias("k")).where("_step = k.step").distinct()
    order = Window.partitionBy(*CHAIN, "_step", "back").orderBy("i")
    run = Window.partitionBy(*CHAIN, "_step", "back", "_island")
    ends = marked.withColumn("_island", F.col("i") - F.row_number().over(order)).withColumn("end", F.max("i").over(run))
    kind = [*CHAIN, F.col("_step").alias("step"), F.col("k.class").alias("class")]
    at = ends.groupBy(*kind, "i").agg(
        F.max(F.when(~F.col("back"), F.col("end"))).alias("forward"), F.max(F.when(F.col("back"), F.col("end"))).alias("backward"))
    scan = at.groupBy(*CHAIN, "step", "class").agg(F.array_sort(F.collect_list(F.struct("i", "forward", "backward"))).alias("at"))
    nothing = F.array().cast("array<struct<start:int,end:int,back:int>>")

    def step(state: Column, x: Column) -> Column:
        def taken(end: Column, back: int) -> Column:
            found = F.struct(x["i"].cast("int").alias("start"), end.cast("int").alias("end"), F.lit(back).alias("back"))
            return F.struct((end + 1).cast("int").alias("free"), F.concat(state["runs"], F.array(found)).alias("runs"))

        return F.when(x["i"] < state["free"], state).when(x["forward"] > x["i"], taken(x["forward"], 0)).when(
            x["backward"] > x["i"], taken(x["backward"], 1)).otherwise(state)

    found = scan.select(*CHAIN, "step", "class", F.inline(F.aggregate(
        "at", F.struct(F.lit(-1).alias("free"), nothing.alias("runs")), step, lambda state: state["runs"])))
    return found.select(*CHAIN, "start", (F.col("end") - F.col("start") + F.col("step") + F.col("back")).cast("int").alias("length"), "class")


def _ladders(bonds: DataFrame) -> DataFrame:
    """The ladder of strands that every bond begins: anti and par as (start1, start2, direction, length), NULL if none.

    A rung is a pair of bonds (both ways for antiparallel strands; i to j-1 and j+1 to i for parallel
    ones).  Rungs two residues apart on the same diagonal form islands; a single bond at an end extends
    the ladder by one.  A ladder has at least two residues; its lower strand comes first.
    """
    other = bonds.select(*CHAIN, F.col("donor").alias("acceptor"), F.col("acceptor").alias("donor"))
    anti = bonds.join(other, [*CHAIN, "donor", "acceptor"]).select(
        *CHAIN, "donor", "acceptor", F.lit(-1).alias("direction"), F.col("donor").alias("i"), F.col("acceptor").alias("j"))
    closing = bonds.select(*CHAIN, F.col("acceptor").alias("donor"), (F.col("donor") - 2).alias("acceptor"))
    parallel = bonds.join(closing, [*CHAIN, "donor", "acceptor"]).select(
        *CHAIN, "donor", "acceptor", F.lit(1).alias("direction"), F.col("donor").alias("i"), (F.col("acceptor") + 1).alias("j"))
    rungs = anti.unionByName(parallel).withColumn("diagonal", F.col("j") - F.col("direction") * F.col("i"))
    island = [*CHAIN, "direction", "diagonal", "_island"]
    order = Window.partitionBy(*CHAIN, "direction", "diagonal", F.pmod("i", F.lit(2))).orderBy("i")
    rungs = rungs.withColumn("_island", F.col("i") - 2 * F.row_number().over(order))
    runs = rungs.groupBy(*island).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    anti_side = F.col("direction") == -1
    mate_hi, mate_lo = (F.col("diagonal") + F.col("direction") * F.col(x) for x in ("hi", "lo"))
    # The single bond that may follow the last or precede the first rung.
    after = runs.select("*", (F.col("hi") + 2).alias("donor"), F.when(anti_side, mate_hi - 2).otherwise(mate_hi + 1).alias("acceptor"))
    grown = after.join(bonds.withColumn("_after", F.lit(1)), [*CHAIN, "donor", "acceptor"], "left").drop("donor", "acceptor")
    ahead = grown.select("*", F.when(anti_side, mate_lo + 2).otherwise(mate_lo - 1).alias("donor"), (F.col("lo") - 2).alias("acceptor"))
    grown = ahead.join(bonds.withColumn("_before", F.lit(1)), [*CHAIN, "donor", "acceptor"], "left").drop("donor", "acceptor")
    first, last = F.col("lo") - F.coalesce("_before", F.lit(0)), F.col("hi") + F.coalesce("_after", F.lit(0))
    sized = grown.select(*island, first.alias("s1"), (F.col("diagonal") + F.col("direction") * first).alias("s2"), (last - first + 1).alias("length"))
    swap = F.col("s1") > F.col("s2")
    # written from its other strand, an antiparallel ladder begins at the other end
    turn = F.when(anti_side, F.col("length") - 1).otherwise(0)
    ladder = F.struct(
        F.when(swap, F.col("s2") - turn).otherwise(F.col("s1")).cast("int").alias("start1"),
        F.when(swap, F.col("s1") + turn).otherwise(F.col("s2")).cast("int").alias("start2"),
        F.col("direction").cast("int").alias("direction"), F.col("length").cast("int").alias("length"))
    long_ones = sized.where("length >= 2").select(*island, ladder.alias("ladder"))
    return rungs.join(long_ones, island).groupBy(*CHAIN, "donor", "acceptor").agg(
        F.max(F.when(anti_side, F.col("ladder"))).alias("anti"), F.max(F.when(~anti_side, F.col("ladder"))).alias("par"))


def strand_pairs(bonds: DataFrame) -> DataFrame:
    """Ladders of paired strands: start1, start2, direction (-1 antiparallel, 1 parallel), length.

    Bonds are taken in order of donor and acceptor.  One that a ladder accepted before explains (its
    residues, or the acceptor's successor, are paired there) is passed over; otherwise it adds the
    antiparallel ladder it begins, or else the parallel one.
    """
    b = bonds.select(*CHAIN, "donor", "acceptor").distinct()
    marked = b.join(_ladders(b), [*CHAIN, "donor", "acceptor"]).groupBy(*CHAIN).agg(
        F.array_sort(F.collect_list(F.struct("donor", "acceptor", "anti", "par"))).alias("bonds"))
    nothing = F.array().cast("array<struct<start1:int,start2:int,direction:int,length:int>>")

    def paired(ladder: Column, one: Column, two: Column) -> Column:
        low, high = F.least(one, two), F.greatest(one, two)
        inside = (ladder["start1"] <= low) & (low < ladder["start1"] + ladder["length"])
        return inside & (ladder["start2"] + ladder["direction"] * (low - ladder["start1"]) == high)

    def step(accepted: Column, bond: Column) -> Column:
        explained = F.exists(accepted, lambda p: paired(p, bond["donor"], bond["acceptor"]) | paired(p, bond["donor"], bond["acceptor"] + 1))
        return F.when(explained, accepted).otherwise(F.concat(accepted, F.array(F.coalesce(bond["anti"], bond["par"]))))

    return marked.select(*CHAIN, F.inline(F.aggregate("bonds", nothing, step)))


_SHEETS = "job_id long, chain long, sheet int, ord int, start1 int, start2 int, direction int, length int"


def _oriented(pairs: DataFrame) -> DataFrame:
    """Residues of every ladder seen from either strand: pair, turned, near, far (paired residues).

    A ladder leads from its near to its far strand; turned ones begin at the second strand.
    """
    cells = pairs.select(*CHAIN, "pair", F.inline(F.transform(
        F.sequence(F.lit(0), F.col("length") - 1),
        lambda k: F.struct((F.col("start1") + k).alias("one"), (F.col("start2") + F.col("direction") * k).alias("two")))))
    return cells.select(*CHAIN, "pair", F.inline(F.array(
        F.struct(F.lit(0).alias("turned"), F.col("one").alias("near"), F.col("two").alias("far")),
        F.struct(F.lit(1).alias("turned"), F.col("two").alias("near"), F.col("one").alias("far")))))


def strand_edges(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Which oriented ladder may follow which: they share a strand residue and the step across it goes on.

    A step goes on if the way from the near residue to the shared one and from there to the far residue of
    the next ladder have a positive dot product (a negative one folds back).  ``pairs`` carries ``pair``, the
    ladder's number in its chain; ``points``: job_id, chain, res_idx, x, y, z.
    """
    cells = _oriented(pairs)
    shared = cells.select(*CHAIN, F.col("pair").alias("pair1"), F.col("turned").alias("turned1"), F.col("near").alias("r1"), F.col("far").alias("r2"))
    ahead = cells.select(*CHAIN, F.col("pair").alias("pair2"), F.col("turned").alias("turned2"), F.col("near").alias("r2"), F.col("far").alias("r3"))
    steps = shared.join(ahead, [*CHAIN, "r2"]).where("pair1 <> pair2")
    for k in (1, 2, 3):
        steps = steps.join(points.select(*CHAIN, F.col("res_idx").alias(f"r{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz")), [*CHAIN, f"r{k}"])
    p1, p2, p3 = (g.vec(f"x{k}", f"y{k}", f"z{k}") for k in (1, 2, 3))
    on = g.dot(g.subtract(p2, p1), g.subtract(p3, p2)) > 0
    return steps.where(on).select(*CHAIN, "pair1", "turned1", "pair2", "turned2").distinct()


def _assemble(key: tuple, pairs: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Walk the graph from each ladder without a sheet, to both sides at once, lowest ladder first."""
    pairs = pairs.sort_values("pair").set_index("pair")
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, t, q, u in sorted(zip(edges["pair1"], edges["turned1"], edges["pair2"], edges["turned2"], strict=True)):
        after.setdefault((p, t), []).append((q, u))
    rows, placed, sheet = [], set(), 0
    for start in pairs.index:
        if start in placed:
            continue
        row, inside = [(start, 0)], {start}
        while True:
            grown = False
            # to the left the walk leads out of the first ladder's near strand: the turned ladder's far one
            for left in (True, False):
                p, t = row[0] if left else row[-1]
                found = next((q for q in after.get((p, 1 - t if left else t), ()) if q[0] not in inside), None)
                if found is not None:
                    inside.add(found[0])
                    row.insert(0, (found[0], 1 - found[1])) if left else row.append(found)
                    grown = True
            if not grown:
                break
        placed |= inside
        for k, (p, t) in enumerate(row):
            r = pairs.loc[p]
            reach = r["length"] - 1 if r["direction"] < 0 else 0
            ends = (r["start2"] - reach, r["start1"] + reach) if t else (r["start1"], r["start2"])
            rows.append((*key, sheet, k, *ends, r["direction"], r["length"]))
        sheet += 1
    return pd.DataFrame(rows, columns=["job_id", "chain", "sheet", "ord", "start1", "start2", "direction", "length"])


def sheets(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Sheets as ordered, oriented strand pairs.

    A ladder that has no sheet begins one and may be joined there by ladders of earlier sheets.  A group
    is the ladders of one chain and the edges among them.
    """
    numbered = pairs.withColumn("pair", F.row_number().over(Window.partitionBy(*CHAIN).orderBy("start1", "start2", "direction", "length")))
    edges = strand_edges(numbered, points).select(F.col("job_id").alias("_job"), F.col("chain").alias("_chain"), "pair1", "turned1", "pair2", "turned2")
    return numbered.groupBy(*CHAIN).cogroup(edges.groupBy("_job", "_chain")).applyInPandas(_assemble, _SHEETS)


def record_lines(helix_rows: DataFrame, numbered: DataFrame, label: Column) -> DataFrame:
    """HELIX records (job_id, chain, ord, line) for computed or loaded helices."""
    num = numbered.select(*CHAIN, "res_idx", "res_name", "res_num", "ins_code")
    first = num.withColumnsRenamed({"res_idx": "start", "res_name": "_n1", "res_num": "_r1", "ins_code": "_i1"})
    last = num.withColumnsRenamed({"res_idx": "_end", "res_name": "_n2", "res_num": "_r2", "ins_code": "_i2"})
    order = Window.partitionBy(*CHAIN).orderBy("start", "class")
    ends = helix_rows.withColumn("_end", F.col("start") + F.col("length") - 1).join(first, [*CHAIN, "start"]).join(last, [*CHAIN, "_end"])
    return ends.withColumn("ord", F.row_number().over(order)).select(*CHAIN, "ord", F.format_string(
        "HELIX  %3d %3d %3s %1s %4d%1s %3s %1s %4d%1s%2d%30s %5d", "ord", "ord", "_n1", label, "_r1", "_i1", "_n2", label, "_r2", "_i2",
        "class", F.lit(""), "length").alias("line"))


def sheet_lines(sheet_rows: DataFrame, numbered: DataFrame, label: Column) -> DataFrame:
    """SHEET records (job_id, chain, ord, line) of oriented strand pairs (sheet, ord, start1, start2, direction, length).

    A sheet of n pairs has n + 1 strands: the near strand of its first pair, then every far strand with
    the middle pair of residues as its registration (antiparallel O to N; parallel N of the residue after).
    """
    num = numbered.select(*CHAIN, "res_idx", "res_name", "res_num", "ins_code")
    size, d = F.col("length"), F.col("direction")
    middle = F.floor(size / 2).cast("int")
    far = F.when(d < 0, F.col("start2") - size + 1).otherwise(F.col("start2"))
    none = F.lit(None).cast("int")
    strands = sheet_rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*CHAIN, "sheet")) + 1).select(*CHAIN, "sheet", "n", F.inline(F.concat(
        F.when(F.col("ord") == 0, F.array(F.struct(
            F.lit(1).alias("strand"), F.lit(0).alias("sense"), F.col("start1").alias("a"), (F.col("start1") + size - 1).alias("b"), none.alias("c"), none.alias("p"))
        )).otherwise(F.array()),
        F.array(F.struct(
            (F.col("ord") + 2).alias("strand"), d.alias("sense"), far.alias("a"), (far + size - 1).alias("b"), (F.col("start2") + d * middle).alias("c"),
            (F.col("start1") + middle + F.when(d > 0, 1).otherwise(0)).alias("p"))))))
    for k in "abcp":
        strands = strands.join(num.select(*CHAIN, F.col("res_idx").alias(k), *(F.col(c).alias(f"_{c}_{k}") for c in ("res_name", "res_num", "ins_code"))), [*CHAIN, k], "left")

    def shown(k: str) -> list[Column | str]:
        return [f"_res_name_{k}", label, f"_res_num_{k}", f"_ins_code_{k}"]

    head = F.format_string("SHEET  %3d %3d%2d %3s %1s%4d%1s %3s %1s%4d%1s%2d", "strand", F.col("sheet") + 1, "n", *shown("a"), *shown("b"), "sense")
    ties = F.when(F.col("c").isNotNull(), F.format_string("  O  %3s %1s%4d%1s  N  %3s %1s%4d%1s", *shown("c"), *shown("p"))).otherwise("")
    order = Window.partitionBy(*CHAIN).orderBy("sheet", "strand")
    return strands.select(*CHAIN, F.row_number().over(order).alias("ord"), F.rpad(F.concat(head, ties), 80, " ").alias("line"))

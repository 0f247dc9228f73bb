"""Near-duplicate documents, lines and vectors against brute force, and their edge cases."""

from __future__ import annotations

import os
import re
import time
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foldloom.llm import common, line_dedup, links, minhash_dedup, vector_dedup
from foldloom.llm.common import table
from foldloom.session import cut_lineage, scratch_folder

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, id string, node long, row string, th string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def roots(nodes, pairs) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(sets: dict, percent: int = 80):
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared: dict = {}
    for ids in where.values():
        for pair in combinations(ids, 2):
            shared[pair] = shared.get(pair, 0) + 1
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def test_near_duplicates_as_brute_force(spark):
    docs = table(spark, SF, "documents").where("length(text) < 3000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    expected = roots(sets, linked(sets))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, shingle_words=2).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), expected[i], expected[i] == i) for i, s in sets.items()}
    assert len(set(expected.values())) < len(sets)


def test_a_dense_group_of_near_copies(spark):
    """Many pairs just below and above the threshold in one group."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 14), replace=False):
            words[p] = f"x{i}_{p}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 2) for i, t in rows}
    expected = roots(sets, linked(sets))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == expected
    assert 1 < len(set(expected.values())) < 150


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [
        (1, None, "a", 1, None, "t"), (2, "", "a", 1, None, "t"), (3, " \t\n", None, None, "x", None), (4, "one", "a", 1, "x", "t"),
        (5, "ONE", "a", 1, "x", "t"), (6, long, "a", 1, "x", "t"), (7, long + " more", "a", 1, "x", "t"), (7, long + " more", "a", 1, "x", "t"),
        (None, "one", "a", 1, "x", "t"), (None, "alone here", "a", 1, "x", "t"), (9, "É one", "a", 1, "x", "t"), (10, "é one", "a", 1, "x", "t")]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle_words=2).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in out}
    assert by[(1, 0)] == (1, True) and by[(2, 0)] == (2, True) and by[(3, 0)] == (3, True)
    assert by[(4, 1)] == (4, True) and by[(5, 1)] == (4, False) and by[(None, 1)] in ((4, False), (None, True))
    assert by[(6, 29_999)] == (6, True) and by[(7, 30_000)] == (6, False)
    assert by[(9, 1)] == (9, True) and by[(10, 1)] == (10, True)  # only A-Z are lowered
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 300)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


def lines_kept(spark, rows, schema="doc_id long, text string", **options):
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, schema), **options)
    return sorted(((r.row.doc_id, r.text, r.n_removed) for r in out.collect()), key=lambda r: (r[0] is None, r[0], str(r[1])))


WORDS = [f"token{k}" for k in range(60)]
LINE = " ".join(WORDS)


def test_lines_exact_and_fuzzy(spark):
    near = " ".join([*WORDS[:30], "changed", *WORDS[31:]])
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(2, f"{LINE}\nshort line\n{other}"), (1, f"first one is here today\n{LINE.upper()}"), (3, f"short line\n  {near} "), (4, f"{other}\n\n{LINE}")]
    assert lines_kept(spark, rows) == [
        (1, f"first one is here today\n{LINE.upper()}", 0), (2, f"short line\n{other}", 1), (3, "short line", 1), (4, "", 2)]


def test_lines_edge_cases(spark):
    giant = " ".join(f"g{k}xyz" for k in range(5000))
    rows = [
        (1, None, "a", 1, "r", "t"), (2, "", "a", 1, "r", "t"), (3, LINE, "a", 1, "r", "t"), (3, LINE, "a", 1, "r", "t"),
        (None, LINE, "a", 1, "r", "t"), (4, giant, "a", 1, "r", "t"), (5, giant + " tail", "a", 1, "r", "t"), (6, "a b c d e f", "a", 1, "r", "t"),
        (7, f"{LINE}\n{LINE}", "a", 1, "r", "t"), (8, "a b c d e f", "a", 1, "r", "t")]
    assert lines_kept(spark, rows, DOCS) == [
        (1, None, 0), (2, "", 0), (3, LINE, 0), (3, LINE, 0), (4, giant, 0), (5, "", 1), (6, "a b c d e f", 0), (7, "", 2), (8, "", 1), (None, "", 1)]
    assert lines_kept(spark, [], DOCS) == []


def test_lines_as_brute_force(spark):
    """Of every exactly repeated line one occurrence stays, in the smallest document; shared lines of copies go."""
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.row.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}

    def normal(x):
        return x.lower().replace("\t", " ").replace("\r", " ").strip(" ")

    def counts(x):
        return sum(1 for w in normal(x).split(" ") if re.search(r"[^\W_]", w)) >= 5

    seen = set()
    for i in sorted(texts):
        left = got[i].split("\n")
        for x in texts[i].split("\n"):
            if x in left and counts(x):
                assert normal(x) not in seen
        seen |= {normal(x) for x in texts[i].split("\n") if counts(x)}
        it = iter(texts[i].split("\n"))
        assert got[i] == "" or all(any(x == y for y in it) for x in left)  # whole lines, in order
        assert [x for x in texts[i].split("\n") if not counts(x)] == [x for x in left if not counts(x)] or got[i] == ""


def word_edits(a, b, most):
    """Word edit distance, or most + 1 beyond."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def test_every_similar_line_is_found(spark):
    """Lines with evenly spread edits, at the least similarity that links, and just below it."""
    rng = np.random.default_rng(11)
    rows, gone = [], set()
    for i, n in enumerate([*range(5, 31), 40, 50, 80, 200]):
        base = [f"w{i}x{k}" for k in range(n)]
        k = line_dedup.slack(n, 0.8)
        for j, edits in enumerate((k, k, k + 1)):
            words = list(base)
            spots = [int((p + 0.5) * n / edits) for p in range(edits)] if j != 1 else rng.choice(n, edits, replace=False)
            for p in spots:
                words[p] = f"y{i}j{j}p{p}"
            rows.append((1000 * (j + 1) + i, " ".join(words)))
            if j < 2:
                gone.add(1000 * (j + 1) + i)
        dropped = [w for p, w in enumerate(base) if p not in {int((q + 0.5) * n / k) for q in range(k)}]
        rows += [(i, " ".join(base)), (9000 + i, " ".join(dropped))]
        if len(dropped) >= 5:
            gone.add(9000 + i)
    got = lines_kept(spark, rows)
    texts = dict(rows)
    removed = {r[0] for r in got if r[2]}
    assert gone <= removed
    for i in {i for i, _ in rows} - gone:
        if i in removed:  # near one of the others, not the base
            near = [texts[o].split() for o in texts if o % 1000 == i % 1000 and o != i]
            w = texts[i].split()
            assert any(word_edits(w, v, m := line_dedup.slack(max(len(w), len(v)), 0.8)) <= m for v in near)


def test_large_keys_are_dealt_and_equal_ones_meet_once(spark, monkeypatch):
    """Groups do not hang on how the open pairs of a key are dealt; keys of the same nodes are one."""
    monkeypatch.setattr(links, "SALTED", 2)
    nodes = [7 * i if i % 3 else 7 * i + 2 for i in range(60)]
    rows = [(k, n) for k in (1, 2, 3) for n in nodes] + [(4, nodes[0]), (4, nodes[1]), (5, nodes[9])]
    members = links.shared_keys(spark.createDataFrame(rows, "key long, node long"))
    assert members.groupBy("key").count().orderBy("count").select("count").collect() == [(2,), (60,)]
    features = spark.createDataFrame([(n, n) for n in nodes], "node long, v long")
    asked = []

    def confirm(pairs):
        asked.append(sorted(map(tuple, pairs.collect())))
        return pairs.where("abs(a - b) <= 7")

    got = {r.node: r.component for r in links.linked_groups(members, confirm, features, lambda x, y: F.abs(F.col(x + "v") - F.col(y + "v")) <= 8).collect()}
    pairs = [(a, b) for a in nodes for b in nodes if a < b <= a + 7]
    root = roots(nodes, pairs)
    assert got == {n: root[n] for n in nodes if any(n in p for p in pairs)}
    assert len(asked) == 2 and len(set(asked[0] + asked[1])) == len(asked[0] + asked[1])


def test_keys_of_lines_are_the_rare_grams(spark):
    """Three in five of a line's grams are keys, the rarest; linked lines share one under any ranks, at other similarities too."""
    rng = np.random.default_rng(3)
    lines, links = [], []
    for similarity in (0.8, 0.6, 0.45):
        for n in (1, 2, 5, 9, 10, 14, 15, 52, 130):
            base = [int(c) for c in rng.integers(0, line_dedup.CODES if n % 2 else 6, n)]
            other, k = list(base), line_dedup.slack(n, similarity)
            for p in (int((j + 0.5) * n / k) for j in range(k)):
                other[p] = line_dedup.CODES - 1 - p
            links.append((similarity, len(lines), len(lines) + 1))
            lines += [base, other]
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, codes array<short>")
    common = [0] * (line_dedup.CODES // 2) + [9] * (line_dedup.CODES // 2)
    for similarity in (0.8, 0.6, 0.45):
        for ranks in (line_dedup.word_ranks(nodes), common):
            keys: dict = {}
            for r in line_dedup.line_keys(nodes, similarity, ranks).collect():
                keys.setdefault(r.node, set()).add(r.key)
            assert all(keys[a] & keys[b] for s, a, b in links if s == similarity)
            if similarity == 0.8:
                assert all(len(keys[i]) <= 0.6 * len(w) + 1 for i, w in enumerate(lines) if len(w) > 1)


def test_similar_lines_of_the_table_as_brute_force(spark):
    """All pairs of lines of 5 to 400 words that share words enough are compared; the same groups are found."""
    docs = table(spark, SF, "documents").where("length(text) < 4000")
    places: dict = {}
    for r in docs.orderBy("doc_id").collect():
        for k, x in enumerate(r.text.split("\n")):
            w = tuple(x.lower().replace("\t", " ").replace("\r", " ").strip(" ").split(" "))
            if len(w) >= 5:
                places.setdefault(w, []).append((r.doc_id, k))
    lines = list(places)
    where: dict = {}
    for i, w in enumerate(lines):
        for x in set(w):
            where.setdefault(x, []).append(i)
    pairs = []
    for i, w in enumerate(lines):
        # of slack + 1 of the longer's words one is left; the rarest are looked at
        rare = sorted(w, key=lambda x: len(where[x]))[:line_dedup.slack(len(w) * 5 // 4 + 1, 0.8) + 1]
        for j in {j for x in rare for j in where[x] if j < i}:
            v = lines[j]
            most = line_dedup.slack(max(len(w), len(v)), 0.8)
            if abs(len(w) - len(v)) <= most and len(set(w) ^ set(v)) <= 2 * most and word_edits(w, v, most) <= most:
                pairs.append((i, j))
    root = roots(range(len(lines)), pairs)
    groups: dict = {}
    for i, w in enumerate(lines):
        groups.setdefault(root[i], []).extend(places[w])
    expected: dict = {}
    for members in groups.values():
        for d, k in sorted(members)[1:]:
            expected.setdefault(d, set()).add(k)
    base = line_dedup.keyed(docs, "doc_id", "text").select("id", "th", "text")
    got = {r.id: set(r.lines) for r in line_dedup.repeated_lines(base).collect()}
    assert got == expected and len(pairs) > 20


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (found.apply(k).getName() for k in range(found.size())) if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.sum("id").alias("s"))
    assert cut_lineage(rows.join(rows.select("k", F.lit(1).alias("one")), "k")).count() == 5_000
    for _ in range(50):  # files go when the executors hear of it
        if not (left := {f for f in shuffle_files(spark) - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    assert len(left) <= 1  # that of the count


def test_documents_are_not_sorted_and_line_tables_go(spark, monkeypatch):
    """Where the lines to remove are too many for a broadcast, documents pass one shuffle with their text once; the working tables are deleted."""
    rows = [(i, "\n".join(f"line of five words {i // 2} {k}" for k in range(4))) for i in range(40)]
    want = lines_kept(spark, rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with scratch_folder(spark) as folder:
        out = line_dedup.drop_repeated_lines(docs)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert len(os.listdir(folder.removeprefix("file:"))) == 1
    assert sorted((r.row.doc_id, r.text, r.n_removed) for r in out.collect()) == want


def brute_vectors(rows, cosine=0.95):
    v = np.array([r[1] for r in rows], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    label = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(n), label[i]) for i, n in zip(ids, near.sum(1))}


def test_vectors_as_brute_force(spark, monkeypatch):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows += [(10_000 + k, (centre + 0.08 * rng.normal(size=64)).tolist()) for k in range(150)]
    rows += [(20_000 + k, rows[3][1]) for k in range(40)]
    short = rng.normal(size=(300, 5))
    monkeypatch.setattr(vector_dedup, "PER_PIVOT", 60)
    monkeypatch.setattr(vector_dedup, "BLOCK", 100)
    short = [(30_000 + k, v.tolist()) for k, v in enumerate(short)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(
        spark.createDataFrame(rows + short, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_vectors(rows) | brute_vectors(short)


def test_vectors_are_not_copied_into_cells(spark, monkeypatch):
    """Evenly spread vectors are near every plane: they are written twice at most, whatever the number of cells; blocks of a round are bounded."""
    monkeypatch.setattr(vector_dedup, "PER_PIVOT", 50)
    monkeypatch.setattr(vector_dedup, "BLOCK", 1_500)
    points = np.random.default_rng(8).normal(size=(2_500, 32))
    points[2_400:] = points[:100] * 3 + 0.01
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    with scratch_folder(spark) as folder:
        out = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    written = sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder.removeprefix("file:")) for f in files)
    assert written < 3 * points.nbytes
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute_vectors(rows)


def test_vector_rounds_hold_a_block_each():
    strips, rounds = vector_dedup.rounds_of([(64, 0, 200_000), (64, 1, 10), (8, 0, 5), (1_000_000, 0, 3)])
    assert rounds == 5 and [len(of) for _, _, of in strips] == [1, 4, 1, 1]
    assert vector_dedup.rounds_of([]) == ([], 0)


def test_vectors_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, node string, v int, id string"
    rows = [
        (1, [1.0, 0.0], "n", 1, "i"), (2, [2.0, 0.0], "n", 1, "i"), (3, [0.0, 0.0], "n", 1, "i"), (4, None, "n", 1, "i"), (5, [1.0, None], "n", 1, "i"),
        (6, [float("nan"), 1.0], "n", 1, "i"), (7, [float("inf"), 1.0], "n", 1, "i"), (8, [], "n", 1, "i"), (9, [1.0, 0.0, 0.0], "n", 1, "i"),
        (None, [1.0, 0.0], "n", 1, "i"), (10, [0.0, 1.0], "n", 1, "i"), (11, [1.0, 0.0], "n", 1, "i"), (12, [2.0, 0.0, 0.0], "n", 1, "i"),
        (13, [1.0, 0.0, 0.0, 0.0], "n", 1, "i")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 13, None)}
    assert got == {**alone, 1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), 9: (1, 9, True), 12: (1, 9, False)}
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []

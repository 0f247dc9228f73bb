"""The two classifiers: held-out accuracy, obfuscated insults, edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from foldloom.llm import quality, toxicity
from foldloom.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, label int, id string, score string"


def area(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    ones = labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.parametrize(("scorer", "label", "least"), [(quality.quality_scores, "quality", 0.97), (toxicity.toxicity_scores, "toxic", 0.8)])
def test_held_out_rows(spark, scorer, label, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = scorer(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert area(*(np.array(x) for x in zip(*held))) >= least


def insults(spark, extra):
    """A made-up labelled corpus in which the insults are 'blorgnik' and 'snarfel'."""
    rng = np.random.default_rng(1)
    plain = ["river", "window", "garden", "silver", "morning", "paper", "yellow", "market", "simple", "winter", "answer", "bridge"]
    rows, labels = [], []
    for k in range(400):
        words = rng.choice(plain, 40).tolist()
        bad = k % 4 == 0
        if bad:
            words[11], words[25] = "blorgnik", "snarfel"
        rows.append((k, " ".join(words[:20]) + ". " + " ".join(words[20:]), 0, "i", "s"))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows + [(1000 + k, t, 0, "i", "s") for k, t in enumerate(extra)], DOCS)
    out = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return [r.predicted for r in sorted(out.where("doc_id >= 1000").collect(), key=lambda r: r.doc_id)]


def test_gapped_and_inserted_insults(spark):
    frame = "the river window {} garden silver morning"
    bad = ["blorgnik", "BLORGNIK!!", "bl-org-nik", "b l o r g n i k", "blorrgnik", "bl0rgn1k", "blorgniik", "snarfel", "snarfelx", "bl.org.nik"]
    clean = ["bridge", "morning", "yellow paper"]
    assert insults(spark, [frame.format(x) for x in [*bad, *clean]]) == [1] * len(bad) + [0] * len(clean)


@pytest.mark.parametrize("scorer", [quality.quality_scores, toxicity.toxicity_scores])
def test_edge_cases(spark, scorer):
    rows = [(1, None, 1, "i", "s"), (2, "", 1, "i", "s"), (3, "x" * 50_000, 1, "i", "s"), (3, "x" * 50_000, 1, "i", "s"), (None, "word one. two", 1, "i", "s"),
            (4, "é 1 !!! ...", 1, "i", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = "doc_id long, quality int, toxic int"
    full = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 0), (None, 1, 1), (4, None, None)], labels)
    for given in (full, spark.createDataFrame([(3, 1, 1)], labels), spark.createDataFrame([], labels)):
        out = scorer(docs, given).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert scorer(spark.createDataFrame([], DOCS), full).collect() == []

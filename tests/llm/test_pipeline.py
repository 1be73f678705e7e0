"""The stages' decisions on the smallest tables, and their columns."""

import os
import random

import pytest

import corpus_pipeline
from llm.conftest import sentence
from llm.test_decontam import brute as brute_hits
from llm.test_minhash import classes
from resight.llm.store import kept

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        docs = kept(stage(spark, docs, FOLDER), "stage")
        if name != "packing":
            assert docs.columns == names
    rows = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in before.items()}
    ids = {n: {d for d, _ in r} for n, r in rows.items()}
    assert ids["near duplicates"] <= ids["toxicity"] < ids["quality"]
    near = classes(rows["near duplicates"])
    assert ids["decontamination"] == {d for d, c in near.items() if d == c}
    clean = {d for d, _, hit, _ in brute_hits(rows["decontamination"], items) if not hit or d < 0}
    assert ids["packing"] == clean
    assert {r.doc_id for r in docs.collect()} == ids["packing"]


def test_stages_take_odd_rows(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet") if os.path.isdir(FOLDER) else None
    if labels is None:
        pytest.skip("needs the driver tables")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[2:4]:
        docs = kept(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == documents.columns
    found = [r.doc_id for r in docs.collect()]
    assert found.count(None) == 2 and found.count(15) == 1 and 8 not in found and 7 in found


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
def test_texts_that_share_an_id_stay(spark):
    rng = random.Random(4)
    base = sentence(rng, 90)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(7, base), (7, sentence(rng, 80)), (7, sentence(rng, 70)), (7, base), (8, near), (9, None), (9, ""), (None, base), (10, "own words"), (10, "own words")]
    docs = spark.createDataFrame([(*r, "?", "?") for r in rows], "doc_id long, text string, _stage_mark string, low string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    found = stages["near duplicates"](spark, docs, FOLDER)
    assert found.columns == docs.columns
    got = [(r.doc_id, r.text) for r in found.collect()]
    group = [g for g in got if g in ((7, base), (8, near))]
    assert len(group) == 1
    others = [rows[k] for k in (1, 2, 5, 6, 7, 8)]
    assert sorted(map(str, got)) == sorted(map(str, [*group, *others]))
    for name in ("quality", "toxicity", "decontamination"):
        assert stages[name](spark, docs, FOLDER).columns == docs.columns

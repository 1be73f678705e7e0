"""Both classifiers: held-out accuracy, odd texts, tables without labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import sentence
from resight.llm import labelled, quality, toxicity
from resight.llm import text as tx


@pytest.fixture(scope="module")
def judged(spark):
    """Texts of which some are junk (quality 0), and some hold a bad word (toxic 1)."""
    rng, rows = random.Random(6), []
    for i in range(700):
        words = sentence(rng, rng.randrange(20, 120)).split()
        junk, bad = rng.random() < 0.3, rng.random() < 0.3
        if junk:
            words = [w.upper() + "!!" for w in words]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["horrid", "vilely", "nastier"])
        rows.append((i, " ".join(words), int(not junk), int(bad)))
    docs = spark.createDataFrame([(*r[:2], "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2], r[3], "y") for r in rows] + [(None, 1, 1, "y"), (3, None, None, "y"), (9999, 1, 0, "y")], "doc_id long, quality int, toxic int, text string")
    return docs, labels


@pytest.mark.parametrize(("module", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(judged, module, target):
    docs, labels = judged
    model = module.fit(docs, labels)
    got = module.scored(docs, model).join(labels, "doc_id").where(labelled.held_out(F.col("doc_id")) & F.col(target).isNotNull()).collect()
    right = [(r["score"] >= 0.5) == bool(r[target]) for r in got]
    assert len(right) > 100 and np.mean(right) >= 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_texts_and_carried_columns(spark, judged, documents, odd_texts, module):
    model = module.fit(*judged)
    rows = module.scored(documents, model, tuple(documents.columns), "_mark").collect()
    assert len(rows) == len(odd_texts) and all(0 <= r["_mark"] <= 1 and r["score"] == "?" for r in rows)
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((d or -1, t or "") for d, t in odd_texts)
    empty = {r["_mark"] for r in rows if not r.text}
    assert len(empty) == 1


@pytest.mark.parametrize(("module", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, documents, no_documents, module, target):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.scored(documents, module.fit(documents, none)).collect()} == {0.5}
    one = spark.createDataFrame([(7, 1, 1), (8, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in module.scored(documents, module.fit(documents, one)).collect())
    assert module.scored(no_documents, module.fit(no_documents, none)).count() == 0


def test_rows_kept_from_fitting(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "'t' as text")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    used = labelled.labelled_texts(docs, labels, "quality", 50)
    assert used.count() == 50
    assert used.where(labelled.held_out(F.col("doc_id"))).count() == 0


def test_trees_on_a_plain_rule():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.grow(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_ngrams_stay_within_texts():
    data, at = np.frombuffer("abé日".encode() + b"xyz", np.uint8), np.array([0, 7, 10])
    chars, bounds = toxicity.characters(data, at)
    assert list(bounds) == [0, 6, 11] and chars[3] == toxicity._codes(np.array([0xE9], np.uint32))[0]
    model = toxicity.Linear(np.sort(toxicity.ngrams(chars, 3)[[1, 7]]), np.array([1.0, 2.0]), 0.0)
    rows, _ = model.held(data, at)
    assert sorted(rows.tolist()) == [0, 1]
    crossing = toxicity.Linear(toxicity.ngrams(chars, 3)[[4]], np.array([1.0]), 0.0)
    assert len(crossing.held(data, at)[0]) == 0


def grams(text):
    data, at = tx.utf8(pa.array([text]))
    chars, _ = toxicity.characters(data, at)
    return {int(g) for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for g in toxicity.ngrams(chars, n)}


def test_scripts_share_no_ngrams():
    texts = ["idiot moron stupid", "ЫЦЫбж идиот а н", "ηλίθιος", "غبي جدا", "טיפש", "笨蛋笨蛋笨蛋", "🙂🙃🙂🙃", "ὦἀἠὗὕᾧᾶ"]
    found = [grams(t.replace(" ", "")) for t in texts]
    assert all(not a & b for i, a in enumerate(found) for b in found[:i])
    assert grams("IDIOT ÉÀ\n") == grams("idiot éà ") and grams("идиот") != grams("ИДИОТ")


def test_ngrams_are_told_apart_as_strings_are():
    rng = random.Random(12)
    text = "".join(rng.choice("abcXЫж日🙂é") for _ in range(4000))
    plain = {f" {text.lower() if text.isascii() else text.replace('X', 'x')} "[i : i + n] for n in range(3, 7) for i in range(len(text) + 3 - n)}
    assert len(grams(text)) == len(plain)


def test_statistics_against_plain_counts(spark, judged):
    """Shares of every n-gram in texts of both labels, as the ratios are made from."""
    docs, labels = judged
    some = docs.limit(60).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("label is not null").select("label", "text")
    got = {r.gram: (r.p, r.q) for r in some.mapInArrow(toxicity._counted, "gram long, ones long, zeros long").groupBy("gram").agg(F.sum("ones").alias("p"), F.sum("zeros").alias("q")).collect()}
    want = {}
    for r in some.collect():
        for g in grams(r.text):
            g -= (g >> 63) << 64
            p, q = want.get(g, (0, 0))
            want[g] = (p + r.label, q + 1 - r.label)
    assert got == want

"""Benchmark windows against a dictionary of all windows."""

import random

from llm.conftest import plain_words, sentence
from resight.llm import decontam


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        if 0 < len(w) < 10:
            windows.setdefault(tuple(w), set()).add(item)
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((-1 if doc is None else doc, len(w), len(hit), sorted(str(i) for i in found)))
    return sorted(out)


def test_against_brute_force(spark, documents, odd_texts):
    rng = random.Random(8)
    long_item = sentence(rng, 300, 30)
    repeated = "to be or not to be that is the question to be or not to be"
    items = [
        (1, long_item), (2, "Two, words!"), (3, None), (4, ""), (5, odd_texts[6][1]), (5, odd_texts[6][1]),
        (6, odd_texts[6][1]), (None, "one"), (7, repeated), (8, "x y"), (9, sentence(rng, 9)),
    ]
    rows = list(odd_texts)
    rows += [(500, "start " + long_item + " end"), (501, " ".join(long_item.split()[5:20]) + " gap " + long_item), (502, repeated + " " + repeated), (503, "Two   WORDS two words")]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(odd_texts) :], "doc_id long, text string"))
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string")
    got = decontam.contaminated_words(df, bench).collect()
    named = [(i, t) for i, t in items if i is not None]
    want = brute(rows, items=[(i if i is not None else "null", t) for i, t in items])
    assert named
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, sorted(r.item_ids)) for r in got) == [(d, n, h, [x for x in i if x != "null"]) for d, n, h, i in want]
    assert all(r.n_items == len(r.item_ids) for r in got)


def test_empty_tables(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated_words(no_documents, none).count() == 0
    assert decontam.contaminated_words(documents, none).where("n_hit > 0").count() == 0


def test_without_broadcasts(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    got = decontam.contaminated_words(documents, bench).where("n_hit > 0").collect()
    assert [(r.doc_id, r.n_hit) for r in got] == [(6, 2)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare filler filler word here odd"), (2, "rare " + "f " * 50 + "odd"), (3, "odd rare")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rare odd")], "item_id long, text string")
    texts, items = decontam.numbered(docs), decontam.items_of(bench)
    queries = decontam.looked_up(items, decontam.text_counts(texts, decontam.item_terms(items)))
    near = decontam.proximity_matches(decontam.positional_index(texts, queries), queries, within=10)
    assert {r.doc_id for r in near.join(texts, "row").select("doc_id").collect()} == {1, 3}


def test_runs_no_python(spark, documents):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    plan = decontam.contaminated_words(documents, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

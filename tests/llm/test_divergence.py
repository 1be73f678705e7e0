"""Divergence of sources against plain integers, under forced collisions of digests, and against SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry_points
from resight.llm import divergence
from llm.conftest import ASCII_LOWER

FOLDER = "/root/testdata/sf0.001"


def brute(rows, top=200):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))
        groups[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        own = {s: c for (k, s), c in groups.items() if k == lang}
        words = sorted(t for t, n in held[lang].items() if n >= 3)
        total = {s: sum(c[t] for t in words) for s, c in own.items()}
        whole = {t: sum(c[t] for c in own.values()) for t in words}

        def share(n, of):
            return 1 + 10**9 * (n + 1) // (of + len(words))

        for s, c in own.items():
            pairs = []
            for o, e in own.items():
                if o != s:
                    both = [(share(c[t], total[s]), share(e[t], total[o])) for t in words]
                    pairs.append((-sum((p - q) ** 2 // q for p, q in both), o.encode(), o))
            terms = []
            for t in words:
                p, q = share(c[t], total[s]), share(whole[t], sum(whole.values()))
                if c[t] and p > q:
                    terms.append((-((p - q) ** 2 // q), t.encode(), t))
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, **how):
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for name in ("n", "p", "q", "digest", "term", "place", "run", "docs", "value", "item", "rank"):
        frame = frame.withColumn(name, frame.lang)
    return sorted(tuple(r) for r in divergence.divergences(frame, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    pool = [f"{a}{b}" for a in ("the", "of", "Straße", "日本", "é", "x") for b in ("", "a", "bb", "Q")]
    made = []
    for k in range(160):
        # One source holds a third of all rows, one language nearly all.
        lang, source = rng.choice(["en"] * 5 + ["de", "", None]), rng.choice(["s0", "s0", "s1", "s2", "ſ", None, ""])
        words = rng.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=rng.randrange(0, 40))
        made.append((lang, source, rng.choice([" ", "1", "_\n"]).join(words)))
    made += [("en", "copies", "the same words again")] * 30
    made += [("en", "silent", None), ("en", "quiet", ""), ("xx", "one", "only here"), ("xx", "two", "9 1"), ("zz", "alone", "a a a"), ("yy", "a", "w w"), ("yy", "a", "w"), ("yy", "b", "W, w;w")]
    return made


def test_against_plain_integers(spark, rows):
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_colliding_digests_are_split(spark, rows, bits):
    assert got(spark, rows, bits=bits, size=300, cells=16) == brute(rows)


def test_ties_at_the_last_rank(spark, rows):
    assert got(spark, rows, top=2) == brute(rows, top=2)


def test_a_long_text_in_small_runs(spark):
    rng = random.Random(1)
    rows = [("en", "a", " ".join(f"w{'abcdefghij'[rng.randrange(10)] * rng.randrange(1, 9)}" for _ in range(300_000)))]
    rows += [("en", s, "wa waa wb wb") for s in "abb"]
    assert len(rows[0][2]) > 1 << 20
    assert got(spark, rows, size=1000) == brute(rows)


def test_an_empty_table(spark):
    assert got(spark, []) == []


def test_counts_are_shuffled_without_strings(spark, rows):
    counts = divergence.term_counts(spark.createDataFrame(rows, "lang string, source string, text string"))
    counts = divergence.kept(counts, "counts")
    plan = counts.groupBy("lang", "source", "digest").agg({"n": "sum"})._jdf.queryExecution().executedPlan().toString()
    assert "term" not in plan.split("ReadSchema")[1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
def test_query_against_sql_and_plain_integers(spark):
    frame = entry_points.queries()["op12_divergence"](spark, FOLDER)
    found = sorted(tuple(r) for r in frame.collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "source", "text").collect()]
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(entry_points.oracle_sql()["op12_divergence"])
    assert [d[0] for d in cursor.description] == frame.columns
    assert sorted(cursor.fetchall()) == found

"""The trie of conversation prefixes against a dictionary of prefixes, and against SQL."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry_points
from resight.llm import prefix_trie

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + x[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, x in whole.items():
        ends[x].append(c)
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
            if d:
                children[x[: d - 1]].add(x[:d])

    def below(node):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        saved, leaves = (len(members[node]) - 1) * words, 0 if children[node] else 1
        for child in list(children[node]):
            more = below(child)
            saved, leaves = saved + more[0], leaves + more[1]
        return saved, leaves

    found = []
    for node, own in list(members.items()):
        saved, leaves = below(node)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        found.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves, saved, sha))
    return sorted(found, key=str)


def got(spark, rows, extra=""):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in extra.split():
        frame = frame.withColumn(name, frame.text)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame.repartition(3)).collect()), key=str)


def test_small_alphabet_of_turns(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "x y", "", "z  z z"])) for c in range(90) for t in range(rng.randrange(1, 6))]
    assert got(spark, rows) == brute(rows)


def test_a_third_are_copies_and_one_conversation_is_long(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    rng = random.Random(6)
    rows = [(c * 20, t, "u", f"same {t}") for c in range(60) for t in range(4)]
    rows += [(5, t, "u", f"w{rng.randrange(3)}") for t in range(400)]
    rows += [(c, t, "u", f"same {t}") for c in range(1201, 1260) for t in range(3)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "word " * 300_000
    rows = [
        (None, 0, "u", "not of any"), (0, None, "u", "first"), (0, 1, None, None), (0, 1, "a", "tie"), (0, 1, "a", "tie"), (0, 2, "u", long),
        (20, 5, "u", "no base turns before"), (43, 0, "", "\x00 \x1c"), (44, 0, "u", ""), (45, 0, "u", ""), (46, 0, "u", long), (7, 0, "u", None), (8, 0, "a", "é 🙂"),
    ]
    # Roles and texts are told apart where their joined characters are the same.
    rows += [(61, 0, "ab", "c"), (62, 0, "a", "bc")]
    assert got(spark, rows, extra="head node depth weight leaf block last first words owner") == brute(rows)


def test_turnless_conversations_and_an_empty_table(spark):
    gone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(gone, 0, "u", "skipped"), (gone + 20, 0, "u", "x")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:1]) == brute(rows[:1]) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]
    assert got(spark, []) == []


def test_the_root_is_no_key_and_nothing_is_crossed(spark):
    frame = spark.createDataFrame([(1, 0, "u", "x"), (21, 0, "u", "y")], SCHEMA)
    plan = prefix_trie.prefix_trie(frame)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
def test_query_against_sql_and_brute_force(spark):
    frame = entry_points.queries()["op11_prefix_trie"](spark, FOLDER)
    found = sorted((tuple(r) for r in frame.collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    cursor = con.execute(entry_points.oracle_sql()["op11_prefix_trie"])
    assert [d[0] for d in cursor.description] == frame.columns
    assert sorted(cursor.fetchall(), key=str) == found

"""Shards: equal texts together, near-equal bytes, gapless slots."""

import zlib

from resight.llm import sharding


def test_documents(documents, odd_texts):
    rows = sharding.shard_documents(documents, 8).collect()
    want = sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in odd_texts)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows} <= set(range(8))
    by_text = {}
    for r in rows:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) == 1 for k, x in by_text.items() if k != (0, 1))


def test_levels_balance(spark):
    groups = spark.range(3000).selectExpr("cast(id as string) as g", "1 + (id * 7919) % 1000 as n")
    placed = sharding.balanced_shards(groups, "g", "n", 7, block=50).join(groups, "g").collect()
    sums = [sum(r.n for r in placed if r.shard == s) for s in range(7)]
    assert len(placed) == 3000 and max(sums) - min(sums) <= 10


def test_differencing_keeps_every_part():
    import random

    rng = random.Random(4)
    sums = [tuple(rng.randrange(100) for _ in range(4)) for _ in range(50)]
    target = sharding.difference(sums, 4)
    assert all(sorted(t) == [0, 1, 2, 3] for t in target)
    totals = [sum(p[k] for p, t in zip(sums, target) for k in range(4) if t[k] == s) for s in range(4)]
    assert sum(totals) == sum(map(sum, sums)) and max(totals) - min(totals) <= 20


def test_no_documents(no_documents):
    assert sharding.shard_documents(no_documents).count() == 0

"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows of one group stay together. Differencing keeps partial partitions, each a tuple of shard sums with the
groups behind them, and again and again combines the two of largest spread, the largest sums of one with the
smallest of the other, so that the difference between them cancels. It is done in levels: groups are dealt into
blocks of at most `block` by hash, each block is differenced into one tuple in its own task, and the tuples of
a level are the items of the next, until one is left. The way back only renames shards: a small join a level.

Nulls: a null text has no bytes and counts 1; equal texts (nulls too) are one group. Repeated rows are rows of
one group. An empty table gives an empty result. Only the named columns are used, others may have any names.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.llm.store import kept

BLOCK = 8192
#: Rows that one task numbers, about.
RUN = 50_000


def difference(sums: list[tuple[int, ...]], shards: int) -> list[tuple[int, ...]]:
    """For each item, a tuple of `shards` sums, the shard that each of its parts goes to.

    Ties are broken by the order of the items, so a repeated task gives the same answer.
    """
    heap = []
    for i, parts in enumerate(sums):
        order = sorted(range(shards), key=lambda k: (-parts[k], k))
        held = [(parts[k], [(i, k)]) for k in order]
        heap.append((held[-1][0] - held[0][0], i, held))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        joined = []
        for (a, members), (b, others) in zip(one, reversed(two), strict=True):
            if len(members) < len(others):
                members, others = others, members
            members.extend(others)
            joined.append((a + b, members))
        joined.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
        n += 1
    target = [[0] * shards for _ in sums]
    if heap:
        for shard, (_, members) in enumerate(heap[0][2]):
            for i, k in members:
                target[i][k] = shard
    return [tuple(x) for x in target]


def _level(items: DataFrame, blocks: int, shards: int) -> DataFrame:
    """items (item, sums) to (item, block, sums, targets)."""
    schema = "item string, block long, sums array<long>, targets array<int>"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", kind="stable")
        sums = [tuple(int(x) for x in row) for row in part["sums"]]
        return pd.DataFrame({"item": part["item"], "block": part["block"], "sums": [list(x) for x in sums], "targets": [list(x) for x in difference(sums, shards)]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(solve, schema)


def balanced_shards(groups: DataFrame, key: str, size: str, shards: int = 8, block: int = BLOCK) -> DataFrame:
    """(key, shard) for groups (key unique and a string, size a long), with the shards' sums of size near equal.

    A group larger than all others together still is one piece, so its shard may be larger than the rest.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), shards - 1)
    items = groups.select(F.col(key).alias("item"), F.concat(F.array(F.col(size).cast("long")), zeros).alias("sums"))
    left, levels = groups.count(), []
    while True:
        blocks = max(1, -(-left // block))
        solved = kept(_level(items, blocks, shards), "differenced")
        levels.append(solved)
        if blocks == 1:
            break
        spread = solved.select("block", F.posexplode(F.arrays_zip("sums", "targets")).alias("k", "part"))
        sums = spread.groupBy("block").agg(*[F.sum(F.when(F.col("part.targets") == s, F.col("part.sums")).otherwise(0)).alias(f"s{s}") for s in range(shards)])
        items = sums.select(F.col("block").cast("string").alias("item"), F.array(*[F.col(f"s{s}") for s in range(shards)]).alias("sums"))
        left = blocks
    # A group's size is its first part; a block's parts follow where the level above put them.
    above = None
    for depth, solved in enumerate(reversed(levels)):
        last = depth == len(levels) - 1
        here = solved.select("item", "block", *([F.col("targets")[0].alias("first")] if last else ["targets"]))
        if above is None:
            moved = here.withColumnRenamed("first", "shard") if last else here
        else:
            up = above.select(F.col("item").cast("long").alias("block"), F.col("targets").alias("up"))
            joined = here.join(up, "block")
            moved = (
                joined.withColumn("shard", F.get("up", F.col("first")))
                if last
                else joined.withColumn("targets", F.transform("targets", lambda t: F.get("up", t)))
            )
        above = moved
    return above.select(F.col("item").alias(key), "shard")


def text_size(text: Column) -> Column:
    """Bytes of a text in UTF-8 and one more; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def with_slots(rows: DataFrame, shard: str, order: list[str], parts: int = 64) -> DataFrame:
    """Adds slot, a gapless number from 0 in each shard, without one task for a whole shard.

    Rows are numbered in `parts` runs a shard; the counts of the runs, shards times parts numbers, tell where
    each run begins. Rows equal in every column of `order` may swap their numbers.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside))
    return numbered.join(starts, [shard, "_part"]).withColumn("slot", (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_part", "_n", "_before", "_row")


def shard_documents(documents: DataFrame, shards: int = 8, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; rows of equal texts share a shard.

    Rows are laid out under the law of equal bytes. Groups are known by the SHA-256 of their texts.
    """
    rows = documents.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("grp"),
    )
    rows = kept(rows, "sizes")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    placed = balanced_shards(groups, "grp", "bytes", shards, block)
    parts = 64 + rows.count() // (shards * RUN)
    return with_slots(rows.join(placed, "grp").drop("grp"), "shard", ["doc_id", "text_crc32"], parts)

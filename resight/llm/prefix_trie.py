"""The trie of conversation prefixes, by whole-sequence collapse.

Conversations are rebuilt (see `rebuilt`) and named by chained digests: a node, a distinct sequence of first turns,
is the 128-bit digest of the node above and its last turn. Identical rebuilt conversations are collapsed into one
weighted sequence whose head is their smallest id; only heads' prefixes go on. Sequences that are a proper prefix of
another are dropped by an anti-join, which leaves the leaves. Prefixes are then aggregated with their weights.

A subtree's sum needs no walk over the tree. Every node is owned by the smallest head that passes through it; what a
sequence owns is an end of its path. So of a node's saved tokens the part that counts conversations is the sum, over
the sequences through it, of weight times the words from there on, and the part that counts nodes once is the sum of
the words from there on that each of these sequences owns. Both take one row for each turn of a head.

A conversation is read in order by one task, as its rebuilding demands, in a stream that holds three turns beside the
batch. A node's list of ends is put together from parts of ranges of ids and hashed as a stream. No other step needs
a group together: hot prefixes are aggregated before they are shuffled, and the root is never a key.

Rows without a conv_id belong to no conversation and are left out. Null roles and texts are empty, a null turn comes
first; rows that share a turn are ordered by role, then text, and repeated rows are turns like others. Texts of any
length are hashed whole. An empty table has no nodes. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resight.llm import text as tx
from resight.llm.store import kept

#: Conversations of one block share the first turns of the block's first one, at most LENT of them.
BLOCK, LENT = 20, 4
ROOT = bytes(16)
#: Ids in one part of a list of ends.
LISTED = 10_000


def _below(node: bytes, role: str, text: str) -> bytes:
    own = role.encode()
    return hashlib.blake2b(node + len(own).to_bytes(8, "little") + own + text.encode(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str, int]]:
    """(conversation, role, text, words of the text) of each row."""
    at = batch.schema.get_field_index("text")
    for first, last, data, bounds in tx.slices(batch.column(at)):
        words = np.diff(tx.word_spans(data, bounds)[2]).tolist()
        n = last - first
        yield from zip(batch.column(0).slice(first, n).to_pylist(), batch.column(1).slice(first, n).to_pylist(), batch.column(at).slice(first, n).to_pylist(), words, strict=True)


class _Path:
    """The prefixes of one rebuilt conversation, in order; each is given out when the next one or the end is known."""

    def __init__(self, conv: int):
        self.conv, self.depth, self.node, self.words, self.through = conv, 0, ROOT, 0, 0

    def row(self, last: bool) -> tuple:
        return self.conv, self.depth, self.node, self.words, self.through, last

    def add(self, role: str, text: str, words: int) -> tuple:
        before = self.row(False)
        self.depth, self.node, self.words, self.through = self.depth + 1, _below(self.node, role, text), words, self.through + words
        return before


def _prefixes(batches: Iterator[pa.RecordBatch], block: int, lent: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["conv_id", "depth", "node", "words", "through", "last"]
    base, opening, path, skip, rows = None, [], None, 0, []

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
        rows.clear()
        return out

    for batch in batches:
        for conv, role, text, words in _texts(batch):
            if path is None or conv != path.conv:
                if path is not None:
                    rows.append(path.row(True))
                path, own = _Path(conv), conv - int(np.fmod(conv, block))
                if own != base:
                    base, opening = own, []
                # The first conversation of a block lends its turns, and keeps its own as they are.
                skip = zlib.crc32(str(conv).encode()) % lent if conv != base else 0
                rows += [path.add(*turn) for turn in opening[:skip]]
            if conv == base and len(opening) < lent - 1:
                opening.append((role, text, words))
            if skip:
                skip -= 1
            else:
                rows.append(path.add(role, text, words))
            if len(rows) >= 20_000:
                yield flushed()
    if path is not None:
        rows.append(path.row(True))
    if rows:
        yield flushed()


def rebuilt(conversations: DataFrame, block: int = BLOCK, lent: int = LENT) -> DataFrame:
    """The prefixes of every rebuilt conversation: conv_id, depth (from 0), node, words (of the last text), through
    (words so far) and last (whether it is the whole conversation).

    Conversation c is rebuilt as the first h turns of conversation c - c % block, and its own after its first h,
    where h is the CRC-32 of c's decimals modulo `lent`.
    """
    conv = F.col("conv_id")
    first = conv - conv % F.lit(block)
    turns = conversations.where(conv.isNotNull()).select(
        conv.cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"), first.alias("block")
    )
    order = ["block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = turns.repartition("block").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(lambda b: _prefixes(b, block, lent), "conv_id long, depth long, node binary, words long, through long, last boolean")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal nodes, in order, to (node, first id, ids joined by commas) of at most LISTED ids."""
    rows: list[tuple[bytes, int, list[str]]] = []
    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rows and rows[-1][0] == node and len(rows[-1][2]) < LISTED:
                rows[-1][2].append(str(conv))
            else:
                rows.append((node, conv, [str(conv)]))
        done = rows[:-1]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.int64()), pa.array([",".join(r[2]) for r in done], pa.string())], names=["node", "first", "ids"])
        rows = rows[-1:]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([",".join(r[2]) for r in rows], pa.string())], names=["node", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of lists, in order, to (node, SHA-256 of the whole list)."""
    node, state = None, None
    for batch in batches:
        found = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                found.append((node, state.hexdigest()))
            node, state = own, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def end_lists(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of every node that a conversation ends at: the SHA-256 of its conversations' ids, ascending,
    joined by commas."""
    ends = prefixes.where("last").select("node", "conv_id")
    # By ranges of ids first: a node with very many ends comes from all ranges, in parts.
    parts = ends.repartitionByRange("conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_listed, "node binary, first long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digested, "node binary, ends_sha256 string")


def sequences(prefixes: DataFrame) -> DataFrame:
    """The distinct whole sequences: node, head (smallest id), weight (conversations), total (words), and leaf: whether
    none goes on from it."""
    distinct = prefixes.where("last").groupBy("node").agg(F.min("conv_id").alias("head"), F.count("*").alias("weight"), F.max("through").alias("total"))
    proper = prefixes.where("not last").select("node").distinct()
    leaves = distinct.join(proper, "node", "left_anti").select("node", F.lit(1).alias("leaf"))
    return distinct.join(leaves, "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, lent: int = LENT) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    prefixes = kept(rebuilt(conversations, block, lent), "prefixes")
    heads = kept(sequences(prefixes), "sequences")
    own = heads.select(F.col("head").alias("conv_id"), "weight", "total", "leaf")
    paths = prefixes.where("depth > 0").join(own, "conv_id").select(
        F.col("conv_id").alias("head"), "depth", "node", "weight", "leaf", (F.col("total") - F.col("through") + F.col("words")).alias("rest")
    )
    paths = kept(paths, "paths")
    owners = paths.groupBy("node").agg(F.min("head").alias("owner"))
    up = Window.partitionBy("head").orderBy(F.desc("depth"))
    owned = F.col("head") == F.col("owner")
    steps = paths.join(owners, "node").select(
        "*",
        F.lead("owner").over(up).alias("parent"),
        F.coalesce(F.lag(owned).over(up).cast("long"), F.lit(0)).alias("opens"),
        # What is owned of a path is its end, and the rest shrinks on the way down: the largest rest seen from below.
        F.coalesce(F.max(F.when(owned, F.col("rest"))).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("once"),
    )
    nodes = kept(
        steps.groupBy("node").agg(
            F.min("head").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("parent").alias("parent_conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum("opens").alias("n_children"),
            F.sum("leaf").cast("long").alias("n_leaves"),
            (F.sum(F.col("weight") * F.col("rest")) - F.sum("once")).alias("saved_tokens"),
        ),
        "nodes",
    )
    none = F.lit(None).cast("long")
    tops = nodes.where("depth = 1").select(none.alias("head"), F.lit(0).alias("weight"), F.lit(0).alias("leaf"), F.lit(1).alias("child"), "saved_tokens")
    root = (
        heads.select("head", "weight", "leaf", F.lit(0).alias("child"), F.lit(0).alias("saved_tokens"))
        .unionByName(tops)
        .agg(*[f(c).cast("long").alias(c) for c, f in (("head", F.min), ("weight", F.sum), ("child", F.sum), ("leaf", F.sum), ("saved_tokens", F.sum))])
        .where("head is not null")
    )
    top = root.select(F.lit(ROOT).alias("node"), F.col("head").alias("conv_id"), F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.col("child").alias("n_children"), F.col("leaf").alias("n_leaves"), "saved_tokens")
    least = heads.agg(F.min("head")).scalar()
    below = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id")))
    empty = hashlib.sha256().hexdigest()
    return (
        below.unionByName(top)
        .join(end_lists(prefixes), "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    )


#: The same in SQL. CRC-32 has no function there, so it is computed bit by bit from the id's digits.
ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, (CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(4294967295::BIGINT, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                          lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)
  )) % 4 END) AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), together AS (
  SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h
), whole AS (
  SELECT c.conv_id, coalesce(s.seq, []) AS seq
  FROM convs c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, i) AS seq FROM together GROUP BY conv_id) s ON s.conv_id = c.conv_id
), prefixes AS (
  SELECT conv_id, len(seq) AS l, d, seq[1:d] AS node FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, node[1:d - 1] AS above,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d
), children AS (
  SELECT above AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above
), subtree AS (
  SELECT n.node[1:k] AS node, sum((n_convs - 1) * words) AS saved, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.node = n.node
  GROUP BY n.node[1:k]
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s ON s.node = n.node LEFT JOIN children c ON c.node = n.node
LEFT JOIN nodes p ON p.node = n.above AND n.d > 0
"""

"""Divergence of the sources of a language, term by term, with late strings.

Terms are counted as 64-bit digests: all that is shuffled for counting is a group, a digest and two numbers, summed
in the task that read the texts. Strings stay in the written table of counts. One row for each distinct term of a run
of texts leads to a dictionary of the smallest and the largest string of every digest: where they differ, terms have
collided, and the rows of that digest are counted anew by their strings. Strings are joined back to ranked rows only.

Every shape is by group g = (lang, source). A group's p of a term is 1 + floor(10^9 (count + 1) / (N + V)), N its
occurrences of kept terms, V the kept terms of its language, those in at least `least` of the language's documents.
f(p, q) = floor((p - q)^2 / q). All of it is whole numbers: the scaling in 38 digits, the rest in 64 bits (p is at most
10^9 + 1, and the sum of f over the terms of two groups at most (10^9 + V)^2).

Pairs of sources need every kept term of a language, absent ones too. Terms are dealt by digest to runs of about CELLS
(terms x sources) numbers, however common a language is, and a run gives the sums of all pairs of sources: rows between
tasks grow with pairs and runs, not with pairs and terms.

Null texts, languages and sources are empty strings; a group without terms has counts of 0. Repeated rows are documents
of their own. Equal values are ranked by the item's UTF-8 bytes. Texts are taken whole, in runs of about SLICE bytes (a
longer text is a run of its own). An empty table gives no rows. Columns other than lang, source and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resight.llm import text as tx
from resight.llm.store import kept

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
SLICE = 16 << 20
CELLS = 1 << 18
#: Bytes that stand between terms: all of ASCII but letters.
APART = np.zeros(256, dtype=bool)
APART[:0x41] = APART[0x5B:0x61] = APART[0x7B:0x80] = True

COUNTS = "lang string, source string, digest long, n long, docs long, term string, leads boolean"


def _counts(batches: Iterator[pa.RecordBatch], bits: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        both = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        named, group = np.unique(both, return_inverse=True)
        for first, last, data, at in tx.slices(batch.column(2), size):
            low = tx.LOWER[data]
            starts, ends, words = tx.word_spans(low, at, APART)
            if not len(starts):
                continue
            bounds = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(ends - starts, out=bounds[1:])
            terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[~APART[low]])).dictionary_encode()
            docs = last - first
            # Occurrences to distinct (term, document), then to (term, group).
            key = terms.indices.to_numpy().astype(np.int64) * docs + np.repeat(np.arange(docs), np.diff(words))
            key.sort()
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n, key = np.diff(np.append(heads, len(key))), key[heads]
            key = key // docs * len(named) + group[first:last][key % docs]
            order = np.argsort(key, kind="stable")
            n, key = n[order], key[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total, held, key = np.add.reduceat(n, heads), np.diff(np.append(heads, len(key))), key[heads]
            term, own = key // len(named), key % len(named)
            raw, edges = tx.utf8(terms.dictionary)
            digest = tx.hashed(raw, edges[:-1], edges[1:]) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(named[own] // max(1, len(sources.dictionary)))),
                    sources.dictionary.take(pa.array(named[own] % max(1, len(sources.dictionary)))),
                    pa.array(digest.astype(np.int64)[term]),
                    pa.array(total.astype(np.int64)),
                    pa.array(held.astype(np.int64)),
                    terms.dictionary.take(pa.array(term)),
                    pa.array(np.append(True, term[1:] != term[:-1])),
                ],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(documents: DataFrame, bits: int = 64, size: int = SLICE) -> DataFrame:
    """One row for each run of texts, group and term: lang, source, digest, n (occurrences), docs (documents that hold
    it), term, and leads: true in one row for each run and term. Terms are told apart by their bytes within a run;
    digests have `bits` bits."""
    return _named(documents).mapInArrow(lambda b: _counts(b, bits, size), COUNTS)


def kept_terms(counts: DataFrame, dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """The groups' counts of the terms that at least `least` documents of their language hold: lang, source, digest,
    split (the term's string where its digest is another term's too, else null), n, lang_n, and once: true in one row
    for each language and term."""
    total = F.sum("n").alias("n"), F.sum("docs").alias("docs")
    found = counts.groupBy("lang", "source", "digest").agg(*total).withColumn("split", F.lit(None).cast("string"))
    collided = kept(dictionary.where(F.col("lowest") != F.col("highest")).select("digest"), "collided")
    if not collided.isEmpty():
        anew = counts.join(collided, "digest", "left_semi").groupBy("lang", "source", "digest", F.col("term").alias("split")).agg(*total)
        found = found.join(collided, "digest", "left_anti").unionByName(anew)
    # At most one row for each source of the language.
    term = Window.partitionBy("lang", "digest", "split")
    sums = found.select(
        "*", F.sum("docs").over(term).alias("held"), F.sum("n").over(term).alias("lang_n"), (F.row_number().over(term.orderBy("source")) == 1).alias("once")
    )
    return sums.where(F.col("held") >= least).select("lang", "source", "digest", "split", "n", "lang_n", "once")


def scaled(count: Column, total: Column, terms: Column) -> Column:
    """p: 1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    whole = "decimal(38,0)"
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast(whole) * (count + 1).cast(whole), (total + terms).cast(whole))


def divergences(documents: DataFrame, least: int = LEAST, top: int = TOP, bits: int = 64, size: int = SLICE, cells: int = CELLS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    counts = kept(term_counts(documents, bits, size), "term-counts")
    dictionary = kept(counts.where("leads").groupBy("digest").agg(F.min("term").alias("lowest"), F.max("term").alias("highest")), "terms")
    terms = kept(kept_terms(counts, dictionary, least), "kept-terms")

    none = F.lit(0).cast("long")
    everyone = _named(documents).select("lang", "source").distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("once").alias("kept_terms"))
    groups = kept(
        everyone.join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("own_total", "lang_total", "kept_terms")],
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
            F.count("*").over(Window.partitionBy("lang")).alias("sources"),
        ),
        "groups",
    )
    shares = terms.join(groups, ["lang", "source"]).withColumn("p", scaled(F.col("n"), F.col("own_total"), F.col("kept_terms")))
    columns = "lang", "source", "part", "item", "value", "rank"
    return _top_terms(shares, dictionary, top).select(*columns).unionByName(_pairs(shares, groups, cells).select(*columns))


def _top_terms(shares: DataFrame, dictionary: DataFrame, top: int) -> DataFrame:
    """The terms that a group has most beyond its language."""
    q = scaled(F.col("lang_n"), F.col("lang_total"), F.col("kept_terms"))
    more = shares.withColumn("q", q).where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    group = Window.partitionBy("lang", "source")
    # With all that tie with the last one: strings decide among them, and are joined to these rows only.
    near = more.withColumn("near", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("near") <= top)
    named = near.join(dictionary, "digest").withColumn("item", F.coalesce("split", "lowest"))
    return named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top).withColumn("part", F.lit("term"))


def _pairs(shares: DataFrame, groups: DataFrame, cells: int) -> DataFrame:
    """The divergence of every group from every other source of its language, over all kept terms."""
    runs = F.greatest(F.lit(1), F.ceil(F.col("kept_terms") * F.col("sources") / F.lit(cells))).cast("long")
    dealt = shares.select("lang", F.pmod(F.xxhash64("digest", "split"), runs).alias("run"), "digest", "split", F.col("place").cast("long").alias("place"), "p")
    # p of a term that the group does not have, in every run; a language without kept terms has one run, without terms.
    absent = scaled(F.lit(0).cast("long"), F.col("own_total"), F.greatest(F.col("kept_terms"), F.lit(1)))
    frames = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias("run"), F.col("place").cast("long").alias("place"), absent.alias("p"))

    def summed(key: tuple, own: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        base = frame.sort_values("place")["p"].to_numpy(np.int64)
        g = len(base)
        # Strings of split digests count as terms of their own; a null is one value too.
        term = own.groupby(["digest", "split"], dropna=False, sort=False).ngroup().to_numpy() if len(own) else np.zeros(0, np.int64)
        p = np.tile(base, (int(term.max()) + 1 if len(term) else 0, 1))
        p[term, own["place"].to_numpy(np.int64)] = own["p"].to_numpy(np.int64)
        sums = np.zeros((g, g), np.int64)
        for j in range(g):
            apart = p - p[:, j : j + 1]
            sums[:, j] = (apart * apart // p[:, j : j + 1]).sum(axis=0)
        i, j = np.nonzero(~np.eye(g, dtype=bool))
        return pd.DataFrame({"lang": key[0], "place": i, "other": j, "value": sums[i, j]})

    parts = dealt.groupBy("lang", "run").cogroup(frames.groupBy("lang", "run")).applyInPandas(summed, "lang string, place long, other long, value long")
    names = groups.select("lang", F.col("place").cast("long").alias("place"), "source")
    items = names.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    sums = parts.groupBy("lang", "place", "other").agg(F.sum("value").alias("value")).join(names, ["lang", "place"]).join(items, ["lang", "other"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).withColumn("part", F.lit("pair"))


#: The same in SQL.
ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM words GROUP BY ALL
), vocabulary AS (
  SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 3
), langs AS (
  SELECT lang, sum(n)::BIGINT AS total, count(*) AS v FROM vocabulary GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT c.* FROM counts c JOIN vocabulary USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
         1 + 1000000000::HUGEINT * (v.n + 1) // (l.total + l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN vocabulary v ON v.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

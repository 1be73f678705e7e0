"""Licence scans over a positional rare-token index of licence templates.

The index holds, for each template, the postings (term, position) of its rarest words: the half of them with the
highest inverse document frequency over all scanned files. A file looks up every place of every word of the
index, so one that holds many notices loses none of them. Postings are intersected by
relative position: places in the file and in the template with the same difference support one another. A
template's score there is the share of the indexed weight that meets, and the template is reported if the score
reaches `least` and all of its mandatory key phrases stand in the file.

Beside this, a few base phrases are reported wherever their words stand consecutively.

Everything is a DataFrame expression. Nulls are empty texts without words; files without licence words have no
labels and score 0. Repeated rows are each answered. An empty table gives an empty result. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm.decontam import row_name, word_array
from resight.llm.store import kept


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The usual notices of public licences, in words as `word_array` gives them, and their key phrases.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
)
LEAST = 0.6


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of files, and in how many of them each word of a vocabulary stands."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = files.select(F.array_intersect(word_array(F.col("text")), known).alias("held"))
    counted = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in counted}
    return counts.pop("", 0), counts


def rare_index(templates: tuple[Template, ...], files: int, counts: dict[str, int]) -> list[tuple[int, str, int, float]]:
    """(template, term, position, weight) of the rarest half of each template's words, ties to the earlier word."""
    postings = []
    for k, template in enumerate(templates):
        weight = {w: math.log((files + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in template.words}
        order = sorted(range(len(template.words)), key=lambda i: (-weight[template.words[i]], i))
        postings += [(k, template.words[i], i, weight[template.words[i]]) for i in order[: (len(order) + 1) // 2]]
    return postings


def _phrase_places(words: Column, anchors: Column, phrase: str) -> Column:
    """Starts of a phrase, among anchors (word and place) that hold every place of its first word."""
    first, *rest = phrase.split()

    def stands(x: Column) -> Column:
        whole = x["word"] == first
        for k, w in enumerate(rest, 1):
            whole = whole & F.coalesce(F.get(words, x["place"] + k) == w, F.lit(False))
        return whole

    return F.transform(F.filter(anchors, stands), lambda x: x["place"])


def scan(
    files: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    base: dict[str, str] | None = None,
    least: float = LEAST,
) -> DataFrame:
    """doc_id, n_words, base_places (array of starts, ascending), base_labels, labels and score of every row.

    labels are those of base phrases and of reported templates, score is 1 with a base phrase, else the best
    score of a reported template, else 0.
    """
    base = BASE if base is None else base
    vocabulary = sorted({w for t in templates for w in t.words})
    n, counts = frequencies(files, vocabulary)
    index = rare_index(templates, n, counts)
    weights = {term: weight for _, term, _, weight in index}
    keys = sorted({key for t in templates for key in t.keys})
    firsts = sorted({p.split()[0] for p in (*base, *keys)})
    anchored = sorted({*weights, *firsts})
    spark = files.sparkSession

    words = F.col("words")
    known = F.array(*[F.lit(w) for w in anchored])
    none = F.array().cast("array<struct<word:string,place:int>>")
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda x: x["word"].isin(anchored))
    rows = files.select("doc_id", row_name(F.col("doc_id"), F.col("text")).alias("row"), word_array(F.col("text")).alias("words"))
    rows = rows.withColumn("anchors", F.when(F.arrays_overlap(words, known), placed).otherwise(none))
    anchors = F.col("anchors")
    per_phrase = {p: _phrase_places(words, anchors, p) for p in base}
    found = rows.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        "anchors",
        F.array(*[F.struct(F.lit(label).alias("label"), per_phrase[p].alias("places")) for p, label in base.items()]).alias("base"),
        F.filter(F.array(*[F.when(F.size(_phrase_places(words, anchors, k)) > 0, F.lit(k)) for k in keys]), lambda k: k.isNotNull()).alias("keys"),
    )
    found = found.withColumn("hits", F.filter("anchors", lambda x: x["word"].isin(sorted(weights))))
    found = kept(found.drop("anchors"), "licence-words")

    # Intersection by relative position, for the few rows that look anything up.
    postings = spark.createDataFrame(index, "template int, term string, position int, weight double")
    total: dict[int, float] = {}
    for k, _, _, weight in index:
        total[k] = total.get(k, 0.0) + weight
    about = spark.createDataFrame([(k, t.label, list(t.keys), total[k]) for k, t in enumerate(templates)], "template int, label string, needs array<string>, total double")
    asked = found.where(F.size("hits") > 0).select("row", "keys", "hits").dropDuplicates(["row"])
    met = asked.select("row", F.explode("hits").alias("h")).select("row", F.col("h.word").alias("term"), F.col("h.place").alias("place"))
    met = met.join(F.broadcast(postings), "term").select("row", "template", (F.col("place") - F.col("position")).alias("apart"), "weight")
    best = met.groupBy("row", "template", "apart").agg(F.sum("weight").alias("weight")).groupBy("row", "template").agg(F.max("weight").alias("weight"))
    shares = best.join(F.broadcast(about), "template").withColumn("share", F.least(F.col("weight") / F.col("total"), F.lit(1.0))).where(F.col("share") >= least)
    verified = shares.join(asked.select("row", "keys"), "row").where(F.size(F.array_except("needs", "keys")) == 0)
    reported = verified.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))

    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["places"]) > 0), lambda b: b["label"])))
    places = F.array_sort(F.flatten(F.transform("base", lambda b: b["places"])))
    out = found.join(reported, "row", "left").withColumn("base_labels", base_labels).withColumn("base_places", places)
    own = F.coalesce("own", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        "base_places",
        "base_labels",
        F.array_sort(F.array_union("base_labels", own)).alias("labels"),
        F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )

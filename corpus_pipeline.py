"""From raw documents to packed training sequences: the stages, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm import decontam, minhash, packing, quality, toxicity
from resight.llm.queries import table, tokenizer_path
from resight.llm.store import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

GOOD, TOXIC = 0.7, 0.3


def _free(docs: DataFrame) -> str:
    """A name that no column has: added while a stage decides, and dropped again."""
    taken = {c.lower() for c in docs.columns}
    name = "_stage_mark"
    while name in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    mark = _free(docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, tuple(docs.columns), mark).where(F.col(mark) >= GOOD).drop(mark)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones among them, does not reject."""
    mark = _free(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, tuple(docs.columns), mark).where(F.col(mark) < TOXIC).drop(mark)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id.

    Different texts that share a doc_id are documents of their own, each named by 64 bits of a hash of both: only
    near copies go. Of rows equal in doc_id and text one stays. Rows with a null doc_id are in no class and stay.
    """
    mark = _free(docs)
    digest = F.xxhash64("text")
    shared = docs.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low < high and doc_id is not null")
    shared = kept(shared.select("doc_id", F.xxhash64("doc_id").alias(mark)), "shared-ids")
    name = F.when(F.col(mark).isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))
    rows = docs.where("doc_id is not null").join(shared, "doc_id", "left").withColumn(mark, name)
    found = minhash.near_duplicates(rows.select(F.col(mark).alias("doc_id"), "text"))
    stay = found.where("kept").select(F.col("doc_id").alias(mark)).distinct()
    one = rows.join(stay, mark, "left_semi").dropDuplicates([mark])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    mark = _free(docs)
    found = decontam.contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("n_hit > 0").select(F.col("row").alias(mark)).distinct()
    return docs.withColumn(mark, decontam.row_name(F.col("doc_id"), F.col("text"))).join(gone, mark, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifiers' scores cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of a folder, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, name.replace(" ", "-"))
    return docs

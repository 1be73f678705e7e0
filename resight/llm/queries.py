"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm import bpe, chat, decontam, divergence, fingerprint, licenses, minhash, ngram_lm, packing, prefix_trie, quality, sharding, toxicity
from resight.llm.labelled import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _judged(scores: DataFrame, least: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score of every document."""
    documents = table(spark, folder, "documents")
    return _judged(quality.scored(documents, quality.fit(documents, table(spark, folder, "labels"))), 0.7)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document."""
    documents = table(spark, folder, "documents")
    return _judged(toxicity.scored(documents, toxicity.fit(documents, table(spark, folder, "labels"))), 0.3)


def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The log10 probability of every document under a trigram model of those that are not held out."""
    return ngram_lm.scored(table(spark, folder, "documents"), held_out(F.col("doc_id"), 7, 2), order=3)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark windows that every document holds."""
    found = decontam.contaminated_words(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of packed sequences of at most 1024 tokens; of a longer one the first piece may be shorter."""
    return packing.packed_documents(table(spark, folder, "documents"), tokenizer_path(), end=2, tokens=1024, short_first=True)


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to it and to the next document."""
    pairs = fingerprint.with_next_text(table(spark, folder, "documents"))
    rows = pairs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return fingerprint.fingerprints(
        rows,
        texts={"text": "fingerprint", "edited": "edited_fingerprint", "next_text": ""},
        likeness={"near_edited": ("text", "edited"), "near_next": ("text", "next_text")},
        columns=("doc_id", "n_chars", "edited_sha256"),
    )


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


#: Conversation -1: texts made of control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and a tricky one, formatted, and read back from the formatted text."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(given.unionByName(own)))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    placed = sharding.shard_documents(table(spark, folder, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How the sources of each language differ from each other, and in which terms from their language."""
    return divergence.divergences(table(spark, folder, "documents"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by byte-level BPE, and decoded again."""
    import public_tokenizers

    return bpe.round_trips(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles() -> dict[str, str]:
    return {"op11_prefix_trie": prefix_trie.ORACLE, "op12_divergence": divergence.ORACLE}

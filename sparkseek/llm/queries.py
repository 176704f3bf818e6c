"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import (
    ann,
    chat,
    decontaminate,
    divergence,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    secrets,
    site_quality,
    spelling,
    superminhash,
    token_files,
)
from sparkseek.llm.shared import new_folder, told_by_ids


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    codes = language_id.fit(documents.filter(~held))
    found = language_id.identify(documents.select("doc_id", held.alias("held_out"), "text"), codes)
    return found.drop("text")


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The target are the documents labelled good and harmless, the background all documents."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    documents = told_by_ids(documents, good, "doc_id", "good")
    return lm_scoring.score(documents, lm_scoring.fit_within(documents, F.col("good")))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return decontaminate.find_contamination(documents, table(spark, folder, "benchmark"))


def op4_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts are sources, and the paths below them languages: the documents have no address."""
    documents = table(spark, folder, "documents")
    return site_quality.judge(documents, table(spark, folder, "labels"), F.col("source"), F.col("lang"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return jaccard_join.jaccard_groups(documents, words=3, percent=90)


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(documents))


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, written formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = new_folder(spark, "chat")
    chat.format_turns(conversations).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, tokenizer_path())
    return token_files.read_documents(spark, path)


def op10_hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


def op12_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_site_quality": op4_site_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_source_mix": op6_source_mix,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_token_files": op9_token_files,
    "op10_hash_forest": op10_hash_forest,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_near_duplicates": op12_near_duplicates,
    "op13_source_divergence": op13_source_divergence,
}

"""A corpus made ready for training, stage by stage; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from sparkseek.llm.queries import tokenizer_path
from sparkseek.llm.shared import new_folder, without_ids

DEDUP_WORDS, DEDUP_PERCENT = 5, 80


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without letters; none when no language was learned."""
    codes = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    if not codes.languages:
        return docs
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = language_id.identify(docs.select(others.alias("others"), "text"), codes)
    kept = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.select([F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents that share four fifths of their five-word shingles."""
    groups = jaccard_join.jaccard_groups(docs, words=DEDUP_WORDS, percent=DEDUP_PERCENT)
    return without_ids(docs, groups.filter("doc_id <> component_id").select("doc_id"), "doc_id")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item, or one with other numbers, names or units."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, found.select("doc_id"), "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compressed token files in a new folder, and what they hold for each document."""
    path = new_folder(spark, "token-files")
    token_files.write_token_files(docs, path, tokenizer_path())
    return token_files.read_documents(spark, path)


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]
#: Classifiers, similarity joins and tokenizers are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

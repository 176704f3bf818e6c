"""The whole path from questions to linked, reranked hits."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import embed, rerank, search
from sparkseek.plans.code_search import RANKED_COLUMNS, code_search
from tests.conftest import at, tuples

TEXTS = ["parse the config file", "open a network socket", "config file writer", "sort a list of numbers"]


@pytest.fixture(scope="module")
def world(spark):
    embedder = embed.HashedTokens(64)
    documents = embed.embed_table(
        spark.createDataFrame([(i + 1, 1, 1, "function", None, None, f"src/{i}.cs", t) for i, t in enumerate(TEXTS)],
                              "id long, project_id long, embedding_model_id long, kind string, namespace string, type_name string, source_file string, embedding_text string"),
        "embedding_text", embedder,
    )
    projects = spark.createDataFrame([(1, "p", "https://git", "https://raw", at("2024-01-01"))], "id long, name string, git_url string, git_raw_url string, created_at timestamp")
    models = spark.createDataFrame([(1, "Local", "hash-64", 64)], "id long, provider string, model string, dimensions int")
    return embedder, documents, projects, models


def ask(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, project_id long, question string, limit int")


def test_answers(spark, world):
    embedder, documents, projects, models = world
    requests = ask(spark, (1, 1, "parse config file", 2), (2, 1, " ", None), (3, 8, "x", None), (4, 1, "sort numbers", None))
    answers = code_search(requests, projects, documents, models, embedder, rerank.Pointwise())
    hits = answers.hits.orderBy("query_id", "rank").collect()
    first = [h for h in hits if h["query_id"] == 1]
    assert [h["id"] for h in first] == [1, 3] and first[0]["rerank_score"] == 1.0
    assert (first[0]["git_url"], first[0]["git_raw_url"]) == ("https://git", "https://raw/src/0.cs")
    assert [h["id"] for h in hits if h["query_id"] == 4][0] == 4 and len(hits) == 6
    assert {r["query_id"]: r["error_code"] for r in answers.rejected.collect()} == {2: "400-question-required", 3: "404-project-not-found"}


def test_without_reranking_the_search_order_stands(spark, world):
    embedder, documents, projects, models = world
    answers = code_search(ask(spark, (1, 1, "open a socket", None)), projects, documents, models, embedder)
    hits = answers.hits.orderBy("rank").collect()
    assert hits[0]["id"] == 2 and all(h["rerank_score"] is None for h in hits)
    assert [h["similarity"] for h in hits] == sorted((h["similarity"] for h in hits), reverse=True)


def test_another_model_finds_nothing(spark, world):
    embedder, documents, projects, models = world
    other = models.withColumn("model", F.lit("other"))
    assert code_search(ask(spark, (1, 1, "q", None)), projects, documents, other, embedder).hits.count() == 0


def many(spark):
    """So many questions that their candidates are joined with the documents and not listed."""
    words = [w for t in TEXTS for w in t.split()]
    return ask(spark, *[(i, 1, f"{words[i % len(words)]} {words[i * 7 % len(words)]}", i % 3 + 1) for i in range(300)])


def test_many_answers_are_those_of_the_steps_one_by_one(spark, world):
    embedder, documents, projects, models = world
    asked = search.with_pool_size(embed.embed_table(many(spark), "question", embedder, "query_vector"), rerank.Pointwise().pool_size)
    found = search.search_batch(documents, asked, 64).join(asked.select("query_id", "project_id", "question", "limit"), "query_id")
    expected = rerank.rerank_batch(found, rerank.Pointwise())
    columns = (*RANKED_COLUMNS, *search.HIT_COLUMNS)
    for reranker in (rerank.Pointwise(), rerank.Pointwise(tasks=3), rerank.Listwise()):
        hits = code_search(many(spark), projects, documents, models, embedder, reranker).hits.withColumn("project_id", F.lit(1).cast("long"))
        rows = tuples(hits.select(*columns).orderBy("query_id", "rank"))
        assert len(rows) == 600 and hits.filter("git_url != 'https://git'").isEmpty()
        if isinstance(reranker, rerank.Pointwise):
            assert rows == tuples(expected.select(*columns).orderBy("query_id", "rank"))


def test_texts_are_shuffled_once_and_not_with_the_candidates(spark, world, capsys):
    embedder, documents, projects, models = world
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = code_search(many(spark), projects, documents, models, embedder, rerank.Pointwise()).hits
        assert len(hits.collect()) == 600
        hits.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    final = re.findall(r"(?<!\w)Exchange \((\d+)\)", plan.split("== Initial Plan ==")[0])
    details = re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(([a-z_]+)#", plan)
    shuffles = [(columns, key) for number, columns, key in details if number in final]
    assert {"query_id", "id"} <= {key for _, key in shuffles}
    assert [key for columns, key in shuffles if "embedding_text#" in columns] == ["id"]

"""Reranking, replies of graders, and the provider registries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import replies
from sparkseek.operators import embed, rerank
from tests.conftest import tuples

HIT = "query_id long, id long, vector_rank int, question string, embedding_text string, limit int"


def hits(spark, *rows):
    return spark.createDataFrame([(1, i, n + 1, "find the parser", text, limit) for n, (i, text, limit) in enumerate(rows)], HIT)


def scores(spark, *pairs):
    return spark.createDataFrame([(1, i, s) for i, s in pairs], "query_id long, id long, rerank_score double")


def test_reorders_by_score(spark):
    candidates = hits(spark, (1, "a", 10), (2, "b", 10))
    joined = rerank.join_scores(candidates, scores(spark, (1, 0.1), (2, 0.95)))
    ranked = rerank.order_by_score(joined, before="vector_rank").orderBy("rank")
    assert tuples(ranked.select("id", "rerank_score")) == [(2, 0.95), (1, 0.1)]


def test_cuts_after_reranking(spark):
    joined = rerank.join_scores(hits(spark, (1, "a", 1), (2, "b", 1)), scores(spark, (1, 0.1), (2, 0.95)))
    assert [r["id"] for r in rerank.take_requested(rerank.order_by_score(joined, "vector_rank")).collect()] == [2]


def test_no_reranking_keeps_the_order(spark):
    out = rerank.rerank_batch(hits(spark, (5, "a", None), (2, "b", None)), rerank.resolve_reranker(None)).orderBy("rank")
    assert tuples(out.select("id", "rerank_score")) == [(5, None), (2, None)]


def test_unscored_candidates_are_dropped_and_unknown_ones_fail(spark):
    candidates = hits(spark, (1, "a", 10), (2, "b", 10))
    assert [r["id"] for r in rerank.join_scores(candidates, scores(spark, (2, 0.5))).collect()] == [2]
    strange = scores(spark, (2, 0.5), (9, 0.5))
    assert tuples(rerank.unknown_scores(candidates, strange).select("id")) == [(9,)]
    with pytest.raises(Exception, match="scored id 9"):
        rerank.join_scores(candidates, strange).collect()


def test_pointwise_sorts_by_grade_and_counts_missing_as_zero(spark):
    candidates = hits(spark, (1, "2", 10), (2, "9", 10), (3, "5", 10), (4, "", 10))
    grade = lambda question, text: text.try_cast("int") / 10.0
    out = rerank.rerank_pointwise(candidates, grade, tasks=3).orderBy("rerank_order")
    assert tuples(out.select("id", "rerank_score")) == [(2, 0.9), (3, 0.5), (1, 0.2), (4, None)]


def test_listwise_answers_by_position(spark):
    candidates = hits(spark, (10, "a", 10), (20, "b", 10))
    out = rerank.rerank_listwise(candidates, lambda question, texts: [(1, 0.9), (0, 0.2)]).orderBy("rerank_order")
    assert tuples(out.select("id", "rerank_score")) == [(20, 0.9), (10, 0.2)]
    partial = rerank.rerank_listwise(candidates, lambda question, texts: [(1, 0.9)])
    assert [r["id"] for r in partial.collect()] == [20]
    with pytest.raises(Exception, match="no candidate at position 7"):
        rerank.rerank_listwise(candidates, lambda question, texts: [(7, 0.9)]).collect()


def test_listwise_sees_candidates_in_search_order(spark):
    candidates = hits(spark, (30, "x", 10), (10, "y", 10), (20, "z", 10)).repartition(3)

    def scorer(question, texts):
        assert (question, texts) == ("find the parser", ["x", "y", "z"])
        return [(0, 1.0)]

    assert [r["id"] for r in rerank.rerank_listwise(candidates, scorer).collect()] == [30]


def test_ties_are_stable(spark):
    out = rerank.order_by_score(
        hits(spark, *[(i, "t", 10) for i in (4, 2, 9, 1)]).withColumn("rerank_score", F.when(F.col("id") != 2, 0.5)), "vector_rank"
    ).orderBy("rank")
    assert [r["id"] for r in out.collect()] == [4, 9, 1, 2]


def test_failing_scorer_fails_the_job(spark):
    def scorer(question, texts):
        raise RuntimeError("model down")

    with pytest.raises(Exception, match="model down"):
        rerank.rerank_listwise(hits(spark, (1, "a", 1)), scorer).collect()


def test_lexical_grades(spark):
    pairs = spark.createDataFrame(
        [("find the parser", "The parser: FIND it"), ("find the parser", "a lexer"), ("a a b c", "A"), ("?!", "x"), ("x", "")], "q string, t string"
    )
    assert [r[0] for r in pairs.select(rerank.lexical_grade(F.col("q"), F.col("t"))).collect()] == [10, 0, 3, 0, 0]


def test_native_and_listwise_words_agree(spark):
    text = "Straße, naïve_x2 — Ünïcode ÉÉ 12.5"
    from sparkseek.functions.scalars import tokens

    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] == rerank._words(text)


@pytest.mark.parametrize(
    "reply,score,error",
    [('{"score": 7}', 0.7, None), ('{"score": 12}', 1.0, None), ('{"score": -3}', 0.0, None), ("{}", 0.0, None),
     ("", None, "blank"), (" \n", None, "blank"), (None, None, "blank"), ("not json", None, "malformed"), ('{"score": "x"}', None, "malformed"),
     ('{"score": null}', None, "malformed"), ('[{"score": 7}]', None, "malformed"), ("null", None, "malformed"), ('{"score": 7} x', None, "malformed"),
     ('{"score": 7.5}', None, "malformed"), ('{"score": 3', None, "malformed"), (' {"other": [1], "score": 3}\n', 0.3, None)],
)
def test_grade_replies(spark, reply, score, error):
    row = spark.createDataFrame([(reply,)], "r string").select(replies.parse_grade(F.col("r")).alias("g")).first()["g"]
    assert (row["score"], row["error"]) == (score, error)


@pytest.mark.parametrize(
    "provider,reply,vector,error",
    [("OpenAI", '{"data":[{"embedding":[0.5,0.25]}]}', [0.5, 0.25], None), ("OpenAI", '{"data":[]}', None, "no-embedding"),
     ("OpenAI", "{}", None, "no-embedding"), ("Ollama", '{"embeddings":[[1.0],[2.0]]}', [1.0], None), ("Ollama", '{"embeddings":[]}', None, "no-embedding"),
     ("Ollama", "oops", None, "malformed")],
)
def test_embedding_replies(spark, provider, reply, vector, error):
    row = spark.createDataFrame([(reply,)], "r string").select(replies.parse_embedding(F.col("r"), provider).alias("e")).first()["e"]
    assert (row["vector"], row["error"]) == (vector, error)


def test_reranker_registry():
    for name in (None, "", "  ", "None", "NONE"):
        assert isinstance(rerank.resolve_reranker(name), rerank.NoOp)
    assert rerank.resolve_reranker("LEXICAL", pool_size=30).pool_size == 30
    with pytest.raises(LookupError, match="Foo.*Lexical"):
        rerank.resolve_reranker("Foo")


def test_embedder_registry():
    assert embed.resolve_embedder("LOCAL", dimensions=8).dimensions == 8
    for name in (None, " ", "Foo"):
        with pytest.raises(LookupError, match="Local"):
            embed.resolve_embedder(name)

"""Reading stored replies of model servers, and the prompt sent to a grader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions.scalars import grade_to_score, is_blank

BLANK, MALFORMED, NO_EMBEDDING = "blank", "malformed", "no-embedding"

# Where each provider's reply keeps the first embedding.
EMBEDDING_SHAPES = {
    "ollama": "embeddings ARRAY<ARRAY<FLOAT>>",
    "openai": "data ARRAY<STRUCT<embedding: ARRAY<FLOAT>>>",
}


def _parse(reply: Column, shape: str) -> tuple[Column, Column]:
    """The parsed struct, and whether the text was not one JSON object of that shape."""
    parsed = F.from_json(
        reply, f"{shape}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    one_object = reply.rlike(r"(?s)^\s*\{.*\}\s*$")
    return parsed, parsed.isNull() | parsed["_bad"].isNotNull() | ~one_object


def parse_grade(reply: Column) -> Column:
    """Struct (score, error) from a grader's ``{"score": n}``.

    A reply without the property grades 0, one with a null does not parse. Blank or
    malformed text has no score and names the error; callers decide whether that
    fails the job.
    """
    parsed, bad = _parse(reply, "score INT")
    bad = bad | (parsed["score"].isNull() & F.array_contains(F.json_object_keys(reply), "score"))
    error = F.when(is_blank(reply), F.lit(BLANK)).when(bad, F.lit(MALFORMED))
    score = F.when(error.isNull(), grade_to_score(F.coalesce(parsed["score"], F.lit(0))))
    return F.struct(score.alias("score"), error.alias("error"))


def parse_grader_reply(reply: Column) -> Column:
    """Struct (score, error) from a grader server's reply, whose ``response`` holds the grade's JSON as text.

    Blank or malformed outer text, or one without that text, names the error as ``parse_grade`` does.
    """
    parsed, bad = _parse(reply, "response STRING")
    inner = parse_grade(parsed["response"])
    error = F.when(is_blank(reply), F.lit(BLANK)).when(bad, F.lit(MALFORMED)).otherwise(inner["error"])
    return F.struct(F.when(error.isNull(), inner["score"]).alias("score"), error.alias("error"))


def parse_ranking(reply: Column) -> Column:
    """Struct (ranking, error) from a listwise server's ``{"results": [{"index": i, "relevance_score": s}]}``.

    ``ranking`` is an array of (rerank_order from 1, index, rerank_score) in the reply's order. A reply without results, or
    with a result that lacks its index or score, does not parse; an empty list is an empty ranking.
    """
    parsed, bad = _parse(reply, "results ARRAY<STRUCT<index: INT, relevance_score: DOUBLE>>")
    results = parsed["results"]
    incomplete = F.exists(results, lambda r: r["index"].isNull() | r["relevance_score"].isNull())
    bad = bad | results.isNull() | F.coalesce(incomplete, F.lit(False))
    error = F.when(is_blank(reply), F.lit(BLANK)).when(bad, F.lit(MALFORMED))
    ranking = F.transform(
        results,
        lambda r, i: F.struct(
            (i + 1).alias("rerank_order"), r["index"].alias("index"), r["relevance_score"].alias("rerank_score")
        ),
    )
    return F.struct(F.when(error.isNull(), ranking).alias("ranking"), error.alias("error"))


def parse_embedding(reply: Column, provider: str) -> Column:
    """Struct (vector, error) with the first embedding of a provider's reply."""
    name = provider.lower()
    parsed, bad = _parse(reply, EMBEDDING_SHAPES[name])
    if name == "ollama":
        vector = F.try_element_at(parsed["embeddings"], F.lit(1))
    else:
        vector = F.try_element_at(parsed["data"], F.lit(1))["embedding"]
    error = F.when(is_blank(reply), F.lit(BLANK)).when(bad, F.lit(MALFORMED)).when(vector.isNull(), F.lit(NO_EMBEDDING))
    return F.struct(F.when(error.isNull(), vector).alias("vector"), error.alias("error"))


def build_prompt(question: Column, text: Column) -> Column:
    """Text asking a grader for one whole number from 0 to 10."""
    return F.concat(
        F.lit(
            "Judge how well a piece of code answers a question about a code base. "
            "Reply with JSON holding one whole number, score, between 0 (unrelated) and 10 (a full answer)."
            "\n\nQuestion: "
        ),
        question,
        F.lit("\n\nCode:\n"),
        text,
    )

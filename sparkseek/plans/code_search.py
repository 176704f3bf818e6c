"""Code search end to end over a table of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.operators.embed import Embedder, embed_table
from sparkseek.operators.rerank import NoOp, Reranker, in_place, rerank_batch
from sparkseek.operators.search import search_batch, with_embedding_space, with_links_and_texts, with_pool_size
from sparkseek.operators.validate import split, validate_search_requests, with_messages

REQUEST_COLUMNS = {
    "query_id": "long",
    "project_id": "long",
    "question": "string",
    "limit": "int",
    "min_similarity": "double",
    "kind_operator": "string",
    "kind_value": "string",
    "namespace_operator": "string",
    "namespace_value": "string",
    "type_name_operator": "string",
    "type_name_value": "string",
}
ANSWER_COLUMNS = (
    "query_id",
    "rank",
    "id",
    "source_file",
    "kind",
    "type_name",
    "member",
    "embedding_text",
    "similarity",
    "git_url",
    "git_raw_url",
    "rerank_score",
)
RANKED_COLUMNS = ("query_id", "project_id", "rank", "id", "similarity", "rerank_score")


@dataclass
class Answers:
    """Ranked hits of the accepted requests, and the rejected requests with their errors.

    The hits are planned, which looks at the requests, when they are first asked for.
    """

    rejected: DataFrame
    plan_hits: Callable[[], DataFrame]

    @cached_property
    def hits(self) -> DataFrame:
        return self.plan_hits()


def complete_requests(requests: DataFrame) -> DataFrame:
    """Requests with every optional column, null where it was left out."""
    return requests.select(
        *[
            (F.col(c) if c in requests.columns else F.lit(None)).cast(kind).alias(c)
            for c, kind in REQUEST_COLUMNS.items()
        ]
    )


def code_search(
    requests: DataFrame,
    projects: DataFrame,
    documents: DataFrame,
    models: DataFrame,
    embedder: Embedder,
    reranker: Reranker | None = None,
    blocks: bool | None = None,
) -> Answers:
    """Validate, embed, search, rerank, cut and link.

    Requests need query_id (unique), project_id and question; limit,
    min_similarity and the filter columns are optional. ``blocks``: see ``nearest_pairs``.

    There are many candidates to a document, so texts are not moved with them: each question goes to its candidates'
    texts, which are scored where they lie, and those that remain meet their texts once more.
    """
    reranker = reranker or NoOp()
    accepted, rejected = split(validate_search_requests(complete_requests(requests), projects))

    def hits() -> DataFrame:
        asked = with_pool_size(embed_table(accepted, "question", embedder, "query_vector"), reranker.pool_size)
        space = with_embedding_space(documents, models, embedder.provider, embedder.model, embedder.dimensions)
        candidates = search_batch(space, asked, embedder.dimensions, blocks, carry=("project_id", "question", "limit"))
        ranked = rerank_batch(candidates, in_place(reranker)).select(*RANKED_COLUMNS)
        return with_links_and_texts(ranked, space, asked, projects).select(*ANSWER_COLUMNS)

    return Answers(with_messages(rejected, "project_id"), hits)

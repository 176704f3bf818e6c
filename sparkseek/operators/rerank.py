"""Re-ordering of search candidates by a second relevance score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.functions import rules
from sparkseek.functions.scalars import grade_to_score, tokens
from sparkseek.operators.registry import Registry

# (question, candidate texts) -> (position, score), best first
ListwiseScorer = Callable[[str, Sequence[str]], Iterable[tuple[int, float]]]
# (question column, text column) -> score column
PointwiseScorer = Callable[[Column, Column], Column]


#: Bytes of candidate texts whose word sets are held at once.
PIECE_BYTES = 4 << 20


class Reranker(Protocol):
    """``rerank`` takes candidates (query_id, id, vector_rank, question,
    embedding_text, ...) and adds ``rerank_score`` and ``rerank_order``."""

    pool_size: int

    def rerank(self, hits: DataFrame) -> DataFrame: ...


def parallel_tasks(spark: SparkSession) -> int:
    """Tasks for dear work on rows that lie in few pieces: all cores, and no fewer than a shuffle has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rerank_none(hits: DataFrame) -> DataFrame:
    """Every candidate, in search order, without a score."""
    return hits.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_order": F.col("vector_rank")})


def rerank_pointwise(hits: DataFrame, scorer: PointwiseScorer, tasks: int | None = None, spread: bool = True) -> DataFrame:
    """Scores each (question, text) on its own. A missing score counts as 0 here.

    The candidates are spread by query over ``tasks``, by default as many as the cluster works on at once, because they often lie in few
    pieces and a scorer is dear. The scores are ranked where they are made: that spread is the one of the windows too. Of the
    other columns only those go through the windows that the caller keeps. Without ``spread`` they are scored where they lie, so that
    the texts are not moved unless the caller keeps them.
    """
    if spread:
        hits = hits.repartition(tasks or parallel_tasks(hits.sparkSession), "query_id")
    scored = hits.withColumn("rerank_score", scorer(F.col("question"), F.col("embedding_text")).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rerank_score", F.lit(0.0)).desc(), "vector_rank")
    return scored.withColumn("rerank_order", F.row_number().over(order))


def listwise_scores(hits: DataFrame, scorer: ListwiseScorer, tasks: int | None = None) -> DataFrame:
    """(query_id, id, rerank_order, rerank_score): one scorer call per query.

    A group is one query's candidates, never more than the candidate pool. The candidates' ids go with them
    and come back, so positions need no join. A position that is no candidate's fails the job.
    """
    tasks = tasks or int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def score(candidates: pa.Table) -> pa.Table:
        ordered = candidates.sort_by("vector_rank")
        answer = list(scorer(ordered["question"][0].as_py(), ordered["embedding_text"].to_pylist()))
        beyond = [index for index, _ in answer if not 0 <= index < ordered.num_rows]
        if beyond:
            raise IndexError(f"no candidate at position {beyond[0]}")
        return pa.table(
            {
                "query_id": pa.array([ordered["query_id"][0].as_py()] * len(answer), pa.int64()),
                "id": pa.array([ordered["id"][index].as_py() for index, _ in answer], pa.int64()),
                "rerank_order": pa.array(range(1, len(answer) + 1), pa.int32()),
                "rerank_score": pa.array([score for _, score in answer], pa.float64()),
            }
        )

    columns = ("query_id", "id", "vector_rank", "question", "embedding_text")
    candidates = hits.select(*columns).repartition(tasks, "query_id")
    return candidates.groupBy("query_id").applyInArrow(
        score, "query_id long, id long, rerank_order int, rerank_score double"
    )


def listwise_to_ids(hits: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, id, rerank_score, rerank_order): positions turned into candidate ids.

    A position that is no candidate's fails the job, whichever columns are read.
    """
    positions = hits.select("query_id", "id", (F.col("vector_rank") - 1).alias("index"))
    found = results.join(positions, ["query_id", "index"], "left")
    text = F.format_string("no candidate at position %d", F.col("index"))
    return _all_must(found, F.col("id").isNotNull(), text).select("query_id", "id", "rerank_score", "rerank_order")


def join_scores(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with their scores. One without a score row is dropped; a score
    for something that was no candidate fails the job, whichever columns are read."""
    marked = hits.withColumn("_candidate", F.lit(True))
    joined = scores.join(marked, ["query_id", "id"], "left")
    text = F.format_string("scored id %d was not a candidate", F.col("id"))
    return _all_must(joined, F.coalesce("_candidate", F.lit(False)), text).drop("_candidate")


def _all_must(rows: DataFrame, holds: Column, text: Column) -> DataFrame:
    """The rows; one for which the condition does not hold fails the job."""
    return rows.filter(F.when(holds, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def unknown_scores(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Score rows that belong to no candidate."""
    return scores.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")


def rerank_listwise(hits: DataFrame, scorer: ListwiseScorer) -> DataFrame:
    """Candidates in the scorer's order; one that it left out is dropped. Ids are the candidates' own, so an
    inner join loses none."""
    return hits.join(listwise_scores(hits, scorer), ["query_id", "id"])


def order_by_score(hits: DataFrame, before: str = "rerank_order", output: str = "rank") -> DataFrame:
    """Numbers each query's candidates by descending score, unscored last; ties keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), before)
    return hits.withColumn(output, F.row_number().over(order))


def take_requested(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Only as many as each request asked for."""
    limit = F.coalesce("limit", F.lit(rules.DEFAULT_RESULTS))
    return hits.filter(F.col(rank) <= limit)


def rerank_batch(hits: DataFrame, reranker: Reranker) -> DataFrame:
    """Rerank, order and cut the candidates of every query."""
    return take_requested(order_by_score(reranker.rerank(hits)))


def lexical_grade(question: Column, text: Column) -> Column:
    """Whole grade 0..10: the share of the question's distinct words found in the text.

    No branch stands around the words, so that Spark splits the question only once.
    """
    asked = F.array_distinct(tokens(question))
    shared = F.size(F.array_intersect(asked, tokens(text)))
    return F.coalesce(F.floor(shared * 10 / F.nullif(F.size(asked), F.lit(0))).cast("int"), F.lit(0))


def lexical_score(question: Column, text: Column) -> Column:
    return grade_to_score(lexical_grade(question, text))


def _grades_of_piece(questions: pa.Array, texts: pa.Array) -> list[int]:
    """``lexical_grade`` of each pair; every different question and text of the piece is split once."""
    asked, given = (x.fill_null("").dictionary_encode() for x in (questions, texts))
    words = [[frozenset(_words(x)) for x in side.dictionary.to_pylist()] for side in (asked, given)]
    pairs = zip(asked.indices.to_pylist(), given.indices.to_pylist(), strict=True)
    sets = ((words[0][q], words[1][t]) for q, t in pairs)
    return [len(q & t) * 10 // len(q) if q else 0 for q, t in sets]


def _grades_of_batch(questions: pa.Array, texts: pa.Array) -> pa.Array:
    """``lexical_grade`` of each pair, by pieces of about `PIECE_BYTES` of text: word sets take many times the bytes of their text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    grades: list[int] = []
    while (first := len(grades)) < len(texts):
        bound = (sizes[first - 1] if first else 0) + PIECE_BYTES
        size = max(1, int(np.searchsorted(sizes, bound, side="right")) - first)
        grades += _grades_of_piece(questions.slice(first, size), texts.slice(first, size))
    return pa.array(grades, pa.int32())


def lexical_score_by_sets(question: Column, text: Column) -> Column:
    """``lexical_score`` for candidates that share questions or texts: word sets are prepared once and meet for each pair."""
    return grade_to_score(F.arrow_udf(_grades_of_batch, "int")(question, text))


def lexical_ranking(question: str, texts: Sequence[str]) -> list[tuple[int, float]]:
    """Listwise form: positions with the share of shared words, best first."""
    asked = set(_words(question))
    shares = [len(asked.intersection(_words(t))) / len(asked) if asked else 0.0 for t in texts]
    return sorted(enumerate(shares), key=lambda pair: -pair[1])


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


@dataclass(frozen=True)
class NoOp:
    pool_size: int = 0

    def rerank(self, hits: DataFrame) -> DataFrame:
        return rerank_none(hits)


@dataclass(frozen=True)
class Pointwise:
    scorer: PointwiseScorer = lexical_score_by_sets
    pool_size: int = rules.DEFAULT_POOL
    tasks: int | None = None
    spread: bool = True

    def rerank(self, hits: DataFrame) -> DataFrame:
        return rerank_pointwise(hits, self.scorer, self.tasks, self.spread)


@dataclass(frozen=True)
class Listwise:
    scorer: ListwiseScorer = lexical_ranking
    pool_size: int = rules.DEFAULT_POOL

    def rerank(self, hits: DataFrame) -> DataFrame:
        return rerank_listwise(hits, self.scorer)


def in_place(reranker: Reranker) -> Reranker:
    """The reranker for candidates that lie in many pieces: a pointwise one scores them there, unless it was told its tasks."""
    return replace(reranker, spread=False) if isinstance(reranker, Pointwise) and reranker.tasks is None else reranker


RERANKERS = Registry("reranking provider")


def register_reranker(name: str, factory: Callable[..., Reranker]) -> None:
    RERANKERS.register(name, factory)


def resolve_reranker(name: str | None, **options) -> Reranker:
    """Blank or "None" means no reranking; an unknown name fails at once."""
    if not name or not name.strip() or name.casefold() == "none":
        return NoOp()
    return RERANKERS.resolve(name, **options)


register_reranker("Lexical", Pointwise)
register_reranker("LexicalList", Listwise)

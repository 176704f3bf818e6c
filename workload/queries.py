"""One registered query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.functions import filters, replies, scalars, vectors
from sparkseek.operators import constraints, embed, feedback, maintained, patterns, projects, pruned, rerank, search, validate
from sparkseek.plans import code_search as plan
from sparkseek.sources import sinks, tables
from sparkseek.streaming import feedback_intake as intake
from workload.scratch import scratch_dir
from workload.views import DIMENSIONS, FILES, MODEL, PROVIDER, WINDOW_END, WINDOW_START, Views

NOW = datetime(2024, 2, 1, 8, 30)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    return named(function.__name__)(function)


def named(name: str) -> Callable:
    def register(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, folder: function(Views(spark, folder))
        return function

    return register


def micros(column: str) -> F.Column:
    return F.unix_micros(column).alias(f"{column}_us")


# --- sources and sinks


@query
def read_projects(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "projects")
    v.projects.write.parquet(path)
    return tables.read_projects(v.spark, path).select("id", "name", "git_url", "git_raw_url", micros("created_at"))


@query
def read_embedding_models(v: Views) -> DataFrame:
    """Models with the number of vectors each produced."""
    path = scratch_dir(v.spark, "models")
    v.models.write.parquet(path)
    used = v.documents.groupBy(F.col("embedding_model_id").alias("id")).agg(F.count("*").alias("n_documents"))
    models = tables.read_embedding_models(v.spark, path).join(used, "id", "left")
    return models.select("id", "provider", "model", "dimensions", "normalized", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query
def read_code_documents(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "documents")
    tables.write_code_documents(v.stored_documents, path)
    return tables.read_code_documents(v.spark, path).select(
        "id", "project_id", "kind", "namespace", "type_name", "source_file",
        F.md5("embedding_text").alias("text_digest"), F.size("embedding").cast("long").alias("n_dimensions"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double")), 9).alias("embedding_sum"),
    )


def _stored_feedback(v: Views) -> str:
    path = scratch_dir(v.spark, "feedback")
    tables.write_feedback(v.feedback, path)
    return path


FEEDBACK_SHOWN = ("id", "project_id", "question", "useful", "reason", "username")


@query
def read_feedback(v: Views) -> DataFrame:
    """The whole stored table, with the day each row is stored by."""
    rows = tables.read_feedback(v.spark, _stored_feedback(v))
    similarities = F.round(F.aggregate("similarities", F.lit(0.0), lambda total, x: total + x), 6).alias("similarity_sum")
    return rows.select(*FEEDBACK_SHOWN, similarities, micros("created_at"), "created_on")


@query
def read_feedback_window(v: Views) -> DataFrame:
    """The days of a window, by folder."""
    rows = tables.read_feedback(v.spark, _stored_feedback(v), WINDOW_START, WINDOW_END)
    return rows.select(*FEEDBACK_SHOWN, micros("created_at"))


@query
def weekly_feedback_stats_stored(v: Views) -> DataFrame:
    """The report over the table stored by day: its window prunes the folders."""
    stored = tables.read_feedback(v.spark, _stored_feedback(v))
    return feedback.weekly_feedback_stats(stored, v.projects, WINDOW_START, WINDOW_END)


@query
def check_constraints(v: Views) -> DataFrame:
    """All rows, some flawed: documents named by their text (copies repeat a name), feedback without a user name, and
    projects and models that have moved to other ids."""
    moved = v.projects.withColumn("id", F.when(F.col("git_url").isNull(), F.col("id") + 1000).otherwise(F.col("id")))
    other = v.models.withColumn("id", F.when(F.col("provider") != PROVIDER, F.col("id") + 10).otherwise(F.col("id")))
    named = v.documents.withColumn("document_id", F.md5("embedding_text"))
    flawed = v.feedback.withColumn("username", F.when(F.col("reason").isNull(), F.col("username")))
    return constraints.check_constraints(
        {"projects": moved, "embedding_models": other, "code_documents": named, "code_query_feedback": flawed}
    )


@query
def check_new_rows(v: Views) -> DataFrame:
    """The tables' keys kept but for those of Spanish documents and error reports, which come as a batch with flaws: some documents have
    names of stored ones or moved to projects and models that do not exist, some feedback has ids of stored rows."""
    path = scratch_dir(v.spark, "keys")
    documents, rows = v.documents, v.feedback
    new_document, new_row = F.col("kind") == "es", F.col("question") == "about error"
    constraints.store_keys(
        {"projects": v.projects, "embedding_models": v.models, "code_documents": documents.filter(~new_document), "code_query_feedback": rows.filter(~new_row)},
        path,
    )
    batch = documents.filter(new_document).withColumns(
        {
            "document_id": F.when(F.col("namespace").isNull(), F.concat(F.lit("doc-"), F.col("id").cast("string"))).otherwise(F.col("document_id")),
            "project_id": F.when(F.col("source_file").isNull(), F.col("project_id") + 1000).otherwise(F.col("project_id")),
        }
    )
    later = rows.filter(new_row).withColumn("id", F.when(F.col("useful"), F.col("id")).otherwise(F.col("id") + 1))
    return constraints.check_new_rows({"code_documents": batch, "code_query_feedback": later}, path)


@query
def append_feedback(v: Views) -> DataFrame:
    """Accepted submissions appended to all stored feedback."""
    existing = v.feedback
    checked = validate.validate_feedback(v.submissions, v.projects)
    accepted, _ = validate.split(checked)
    rows = feedback.append_feedback(existing, accepted, NOW)
    return rows.select(
        "id", "project_id", "question", "useful", F.size("similarities").cast("long").alias("n_similarities"),
        "reason", "username", micros("created_at"),
    )


EXPORT_TEXT_SCHEMA = (
    "id long, project_id long, project_name string, question string, useful string, similarities string, "
    "reason string, username string, created_at string"
)


@query
def export_feedback_csv(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "export")
    rows = feedback.export_rows(v.feedback, v.projects, WINDOW_START, WINDOW_END)
    sinks.export_feedback_csv(feedback.export_text(rows, "America/Sao_Paulo"), path)
    return sinks.read_feedback_csv(v.spark, path, EXPORT_TEXT_SCHEMA)


@query
def export_feedback_parts(v: Views) -> DataFrame:
    """Every line of the export in parts, numbered through in the manifest's order."""
    path = scratch_dir(v.spark, "export")
    rows = feedback.export_rows(v.feedback, v.projects, WINDOW_START, WINDOW_END)
    sinks.export_feedback_parts(rows, path, feedback.text_columns("America/Sao_Paulo"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = sinks.read_manifest(v.spark, path).select("part", (F.col("rows") + F.when(F.col("part") == 0, 1).otherwise(0)).alias("lines"))
    texts = v.spark.read.schema("value string, part int").text(f"{path}/parts", wholetext=True)
    lines = texts.select("part", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line"))
    return lines.join(manifest.withColumn("before", before), "part").select((F.col("before") + F.col("place")).alias("place"), "line")


@query
def write_weekly_json(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "weekly")
    sinks.write_weekly_json(feedback.nest_weeks(_stats(v)), path)
    entry = (
        "project_id: long, project_name: string, total_count: long, useful_count: long, not_useful_count: long, "
        "useful_percentage: double, not_useful_percentage: double"
    )
    weeks = v.spark.read.schema(f"week_start date, week_end date, projects array<struct<{entry}>>").json(path)
    return weeks.select(
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        F.date_format("week_end", "yyyy-MM-dd").alias("week_end"),
        F.inline("projects"),
    )


@query
def export_file_stem(v: Views) -> DataFrame:
    """Name of the export covering each project's own feedback."""
    span = v.feedback.groupBy("project_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return span.select(
        "project_id",
        scalars.export_file_stem(F.col("first"), F.col("last"), F.col("project_id")).alias("one_project"),
        scalars.export_file_stem(F.col("first"), F.col("last")).alias("all_projects"),
    )


# --- predicates


def _documents_where(v: Views, *conditions) -> DataFrame:
    return v.documents.filter(filters.all_of(*conditions)).select("id", "project_id", "kind", "namespace", "type_name")


def _predicate(name: str, condition: Callable[[], F.Column]) -> None:
    QUERIES[name] = lambda spark, folder: _documents_where(Views(spark, folder), condition())


_predicate("in_project", lambda: filters.in_project(7))
_predicate("kind_filter_contains", lambda: filters.kind_filter("contains", "*E*"))
_predicate("kind_filter_equals", lambda: filters.kind_filter("equals", "en"))
_predicate("kind_filter_not_equals", lambda: filters.kind_filter("not_equals", "en"))
_predicate("namespace_filter_contains", lambda: filters.namespace_filter("contains", "SRC1*"))
_predicate("namespace_filter_not_contains", lambda: filters.namespace_filter("not_contains", "SRC1_"))
_predicate("namespace_filter_equals", lambda: filters.namespace_filter("equals", "src3"))
_predicate("namespace_filter_not_equals", lambda: filters.namespace_filter("not_equals", "src3"))
_predicate("type_name_filter_contains", lambda: filters.type_name_filter("contains", "good*"))
_predicate("type_name_filter_not_contains", lambda: filters.type_name_filter("not_contains", "*OR*"))
_predicate("type_name_filter_equals", lambda: filters.type_name_filter("equals", "GoodText"))
_predicate(
    "all_of",
    lambda: filters.all_of(
        filters.kind_filter("not_equals", "de"), None, filters.namespace_filter("contains", "*1*"), filters.type_name_filter("not_contains", "Poor*")
    ),
)


@query
def wildcard(v: Views) -> DataFrame:
    """Each document's kind and source tried against a pattern taken from its own text."""
    value = F.concat(F.lit("S*"), F.substring("source", 4, 1), F.lit("*"))
    odd = F.concat(F.lit("\\s_c"), F.substring("source", -1, 1))
    return v.raw("documents").select(
        "doc_id",
        scalars.default_to(filters.wildcard_column(value), "").alias("pattern"),
        filters.wildcard_column(odd).alias("tidied"),
        F.ilike("source", filters.wildcard_column(value)).alias("matched"),
        F.ilike("source", filters.wildcard_column(odd)).alias("matched_tidied"),
    )


@query
def match_patterns(v: Views) -> DataFrame:
    """Patterns out of benchmark items, of many, few and no letters, against all texts."""
    word = lambda i: F.split("text", " ")[i]
    items = v.spark.read.parquet(f"{v.folder}/benchmark.parquet")
    kinds = {
        0: F.concat(F.lit("*"), F.substring(word(1), 1, 4), F.lit("*")),
        1: F.concat(F.lit("*"), F.upper(word(2)), F.lit(" "), word(3), F.lit("*")),
        2: F.concat(F.lit("*"), F.substring(word(2), 1, 2), F.lit("_"), F.substring(word(4), 1, 1), F.lit("*")),
        3: F.concat(F.substring(word(0), 1, 1), F.lit("*")),
        4: F.when(F.col("item_id") % 4 == 0, F.lit("*")).when(F.col("item_id") % 4 == 1, F.lit("*\\%*")),
    }
    every = F.explode(F.array(*[F.struct((F.col("item_id") * 10 + k).alias("pattern_id"), p.alias("pattern")) for k, p in kinds.items()]))
    table = items.select(every.alias("p")).select("p.*")
    return patterns.match_patterns(v.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value")), table)


@query
def min_similarity(v: Views) -> DataFrame:
    pairs = _neighbours(v).select("vec_id", vectors.cosine_similarity(F.col("a"), F.col("b")).alias("similarity"))
    return pairs.filter(filters.min_similarity(0.05)).select("vec_id", vectors.round10(F.col("similarity")).alias("similarity"))


@query
def in_window(v: Views) -> DataFrame:
    return v.feedback.filter(filters.in_window(WINDOW_START, WINDOW_END)).select("id", micros("created_at"))


@query
def project_name_contains(v: Views) -> DataFrame:
    """Customers whose name contains their key's last digits, and projects named after a nation."""
    named = v.raw("customer").select("c_custkey", F.col("c_name").alias("name"), "c_nationkey")
    part = F.concat(F.lit("_0"), F.col("c_nationkey").cast("string"))
    return named.filter(filters.project_name_contains("CUSTOMER#%1") | filters.project_name_contains(part)).select("c_custkey", "name")


@query
def project_name_is(v: Views) -> DataFrame:
    """Rows named like a project but with another id."""
    named = v.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return named.filter(filters.project_name_is("BUILDING", excluding=7) | filters.project_name_is("building")).select("id", "name")


@query
def hit_columns(v: Views) -> DataFrame:
    return search.hit_columns(v.documents).withColumn("embedding_text", F.md5("embedding_text"))


@query
def with_git_links(v: Views) -> DataFrame:
    links = v.projects.select(F.col("id").alias("project_id"), "git_url", F.col("git_raw_url").alias("_raw"))
    return search.with_git_links(v.documents.select("id", "project_id", "source_file").join(links, "project_id"))


# --- joins


def _space(v: Views) -> DataFrame:
    """The documents with a given vector of the model."""
    embedded = v.documents.filter(F.col("embedding").isNotNull())
    return search.with_embedding_space(embedded, v.models, PROVIDER, MODEL, DIMENSIONS)


@query
def with_embedding_space(v: Views) -> DataFrame:
    return _space(v).select("id", "project_id", "embedding_model_id")


@query
def feedback_with_project(v: Views) -> DataFrame:
    return feedback.feedback_with_project(v.feedback, v.projects).select("id", "project_id", "project_name", "useful")


@query
def week_project_grid(v: Views) -> DataFrame:
    """Weeks spanned by the stored feedback, for every project."""
    ends = v.feedback.agg(F.unix_seconds(F.min("created_at")), F.unix_seconds(F.max("created_at"))).first()
    first, last = (datetime.fromtimestamp(seconds, timezone.utc) for seconds in ends)
    return feedback.week_project_grid(v.projects, first, last)


@query
def grid_with_feedback(v: Views) -> DataFrame:
    grid = feedback.week_project_grid(v.projects, WINDOW_START, WINDOW_END)
    return feedback.grid_with_feedback(grid, feedback.weekly_counts(v.feedback, WINDOW_START, WINDOW_END))


def _asked_projects(v: Views) -> DataFrame:
    return v.raw("events").select((F.col("user_id") % 30 + 1).alias("project_id")).distinct()


@query
def projects_exist(v: Views) -> DataFrame:
    return projects.projects_exist(_asked_projects(v), v.projects)


@query
def project_by_id(v: Views) -> DataFrame:
    return projects.project_by_id(v.projects, _asked_projects(v)).select("id", "name", "git_url", "git_raw_url")


@query
def has_documents(v: Views) -> DataFrame:
    return projects.has_documents(v.projects.select("id", "name"), v.documents)


@query
def has_feedback(v: Views) -> DataFrame:
    return projects.has_feedback(v.projects.select("id", "name"), v.feedback)


@query
def name_exists(v: Views) -> DataFrame:
    """Suppliers asking for their nation's name, or for one no project has."""
    key = F.col("s_nationkey")
    names = v.raw("supplier").select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("nation_"), key.cast("string")))
        .otherwise(F.concat(F.lit("NATION_"), key.cast("string"))).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, (key + 1).cast("long")).alias("excluding"),
    )
    return projects.name_exists(names, v.projects)


def _candidates(v: Views) -> DataFrame:
    """Search candidates of every request with a question (its own document's text) and a limit."""
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS)
    asked = v.requests.join(
        v.raw("documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")),
        "query_id",
    ).select("query_id", "project_id", "question", (F.col("query_id") % 5 + 1).cast("int").alias("limit"))
    return hits.join(asked, "query_id")


def _scores(hits: DataFrame) -> DataFrame:
    """Scores as from a scorer that answers for English text only."""
    return hits.filter(F.col("kind") == "en").select("query_id", "id", ((F.col("id") * 7) % 10 / 10.0).alias("rerank_score"))


@query
def join_scores(v: Views) -> DataFrame:
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS).select("query_id", "id", "vector_rank", "kind")
    return rerank.join_scores(hits, _scores(hits))


@query
def unknown_scores(v: Views) -> DataFrame:
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS).select("query_id", "id", "vector_rank", "kind")
    return rerank.unknown_scores(hits.filter(F.col("vector_rank") <= 5), _scores(hits))


@query
def listwise_to_ids(v: Views) -> DataFrame:
    """Answers that list every candidate in reverse."""
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS).select("query_id", "id", "vector_rank")
    last = Window.partitionBy("query_id")
    results = hits.select(
        "query_id",
        (F.col("vector_rank") - 1).alias("index"),
        (F.max("vector_rank").over(last) - F.col("vector_rank") + 1).alias("rerank_order"),
        (F.col("vector_rank") / 10.0).alias("rerank_score"),
    )
    return rerank.listwise_to_ids(hits, results)


@query
def hits_with_project(v: Views) -> DataFrame:
    hits = _candidates(v).select("query_id", "id", "vector_rank", "project_id", "source_file")
    return search.hits_with_project(hits, v.projects)


# --- aggregations


def _stats(v: Views) -> DataFrame:
    return feedback.weekly_feedback_stats(v.feedback, v.projects, WINDOW_START, WINDOW_END)


@query
def weekly_counts(v: Views) -> DataFrame:
    return feedback.weekly_counts(v.feedback, WINDOW_START, WINDOW_END)


def _count_query(name: str, column: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        v = Views(spark, folder)
        grid = feedback.week_project_grid(v.projects, WINDOW_START, WINDOW_END)
        counts = feedback.weekly_counts(v.feedback, WINDOW_START, WINDOW_END)
        return feedback.grid_with_feedback(grid, counts).select("week_start", "project_id", column)

    QUERIES[name] = run


_count_query("total_count", "total_count")
_count_query("useful_count", "useful_count")
_count_query("not_useful_count", "not_useful_count")


@query
def useful_pct(v: Views) -> DataFrame:
    """Shares of useful feedback by user, where odd counts make every kind of fraction."""
    per_user = v.feedback.groupBy("username").agg(
        F.count("id").alias("total_count"), F.count_if("useful").alias("useful_count"), F.count_if(~F.col("useful")).alias("not_useful_count")
    )
    return feedback.with_percentages(per_user)


@query
def weekly_feedback_stats(v: Views) -> DataFrame:
    return _stats(v)


@query
def weekly_feedback_stats_one_project(v: Views) -> DataFrame:
    return feedback.weekly_feedback_stats(v.feedback, v.projects, WINDOW_START, WINDOW_END, project_id=3)


@query
def nest_weeks(v: Views) -> DataFrame:
    """Nested weeks with every nested field and its place."""
    weeks = feedback.nest_weeks(_stats(v))
    return weeks.select("week_start", "week_end", F.posexplode("projects").alias("place", "p")).select(
        "week_start", "week_end", "place", "p.*"
    )


@query
def nest_weeks_in_parts(v: Views) -> DataFrame:
    """Weeks in rows of ten project ids each."""
    weeks = feedback.nest_weeks(_stats(v), projects_per_row=10)
    return weeks.select("week_start", "part", F.posexplode("projects").alias("place", "p")).select(
        "week_start", "part", "place", "p.project_id", "p.total_count"
    )


@query
def mean_pool(v: Views) -> DataFrame:
    """Mean vector of each label, one row per dimension."""
    pooled = vectors.mean_pool(v.raw("embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return pooled.select("label", "token_count", F.posexplode("pooled").alias("dim", "x")).select(
        "label", "token_count", "dim", F.round("x", 9).alias("mean")
    )


# --- search and order


@named("search")
def search_one(v: Views) -> DataFrame:
    """The vector of document 3 searched in its own project, threshold and filters on."""
    vector = v.raw("embeddings").filter("vec_id = 3").first()["embedding"]
    hits = search.search(
        _space(v), vector, 10, 4, [filters.type_name_filter("not_contains", "poor*"), filters.kind_filter("contains", "*E*")], -0.2
    )
    return hits.withColumn("embedding_text", F.md5("embedding_text"))


@query
def search_by_expression(v: Views) -> DataFrame:
    vector = v.raw("embeddings").filter("vec_id = 3").first()["embedding"]
    hits = search.search_by_expression(_space(v), vector, 10, 4, [filters.type_name_filter("not_contains", "good*")], -0.1)
    return hits.withColumn("embedding_text", F.md5("embedding_text"))


@query
def search_batch(v: Views) -> DataFrame:
    """All requests, sent to every task while they are few enough, else met in blocks."""
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS)
    return hits.withColumn("embedding_text", F.md5("embedding_text"))


@query
def search_batch_filtered(v: Views) -> DataFrame:
    """Limits, thresholds and text filters that differ from request to request."""
    hits = search.search_batch(_space(v), v.filtered_requests, DIMENSIONS)
    return hits.select("query_id", "vector_rank", "id", "similarity")


@query
def search_batch_blocks(v: Views) -> DataFrame:
    """The same requests as search_batch, met with the documents in blocks."""
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS, blocks=True)
    return hits.withColumn("embedding_text", F.md5("embedding_text"))


@query
def search_batch_blocks_filtered(v: Views) -> DataFrame:
    hits = search.search_batch(_space(v), v.filtered_requests, DIMENSIONS, blocks=True)
    return hits.select("query_id", "vector_rank", "id", "similarity")


def _pruned(v: Views, requests: DataFrame) -> DataFrame:
    path, levels, work = (scratch_dir(v.spark, n) for n in ("blocks", "levels", "search"))
    space = _space(v)
    pruned.write_vector_blocks(space, path, levels, block_rows=64)
    return pruned.search_pruned(space, pruned.VectorBlocks(v.spark, path), requests, DIMENSIONS, work)


@query
def search_pruned(v: Views) -> DataFrame:
    """The requests of search_batch over stored blocks, of which those out of reach are left out."""
    return _pruned(v, v.requests).withColumn("embedding_text", F.md5("embedding_text"))


@query
def search_pruned_filtered(v: Views) -> DataFrame:
    return _pruned(v, v.filtered_requests).select("query_id", "vector_rank", "id", "similarity")


@query
def search_stored(v: Views) -> DataFrame:
    """One search over the stored table: one project's folder, then the row groups that hold the winners."""
    path = scratch_dir(v.spark, "documents")
    embedded = v.stored_documents.join(v.raw("embeddings").select((F.col("vec_id") + 1).alias("id")), "id", "left_semi")
    tables.write_code_documents(embedded, path)
    space = search.with_embedding_space(tables.read_code_documents(v.spark, path), v.models, PROVIDER, MODEL, DIMENSIONS)
    vector = v.raw("embeddings").filter("vec_id = 3").first()["embedding"]
    hits = search.search(space, vector, 10, 4)
    return hits.withColumn("embedding_text", F.md5("embedding_text"))


@query
def best_per_query(v: Views) -> DataFrame:
    """The ten dearest lines of every supplier."""
    lines = v.raw("lineitem").select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (-F.col("l_extendedprice")).alias("distance"), F.lit(10).alias("k"),
    )
    return search.best_per_query(lines, 10)


@named("pool_size")
def with_pool_size(v: Views) -> DataFrame:
    return search.with_pool_size(v.questions.select("query_id", F.when(F.col("limit") > 0, F.col("limit") * 5).alias("limit")), 25)


def _scored(v: Views) -> DataFrame:
    hits = search.search_batch(_space(v), v.requests, DIMENSIONS).select("query_id", "id", "vector_rank")
    return hits.withColumn("rerank_score", F.when(F.col("id") % 4 != 0, F.col("id") % 3 / 10.0))


@query
def order_by_score(v: Views) -> DataFrame:
    """Few distinct scores and some missing: ties keep the search order."""
    return rerank.order_by_score(_scored(v), before="vector_rank")


@query
def take_requested(v: Views) -> DataFrame:
    ranked = rerank.order_by_score(_scored(v), before="vector_rank")
    return rerank.take_requested(ranked.withColumn("limit", F.when(F.col("query_id") % 2 == 0, 3)))


@query
def list_projects(v: Views) -> DataFrame:
    ordered = projects.list_projects(v.projects, "ATION_1")
    return ordered.select("id", "name", "git_url", "git_raw_url")


@query
def export_rows(v: Views) -> DataFrame:
    rows = feedback.export_rows(v.feedback, v.projects, WINDOW_START, WINDOW_END)
    return rows.select("id", "project_id", "project_name", "question", "useful", "reason", "username", micros("created_at"))


@query
def in_grid_order(v: Views) -> DataFrame:
    return feedback.in_grid_order(_stats(v)).select("week_start", "project_id", "total_count")


# --- scalar functions


def _neighbours(v: Views) -> DataFrame:
    e = v.raw("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", F.col("embedding").alias("a")).join(after, "vec_id")


@query
def cosine_distance(v: Views) -> DataFrame:
    return _neighbours(v).select("vec_id", vectors.round10(vectors.cosine_distance(F.col("a"), F.col("b"))).alias("distance"))


@query
def similarity(v: Views) -> DataFrame:
    distance = vectors.cosine_distance(F.col("a"), F.transform("a", lambda x: x * x))
    return v.raw("embeddings").select("vec_id", F.col("embedding").alias("a")).select(
        "vec_id", vectors.round10(vectors.similarity(distance)).alias("similarity")
    )


@query
def round10(v: Views) -> DataFrame:
    return v.raw("events").select("event_id", vectors.round10(F.col("value") / 7).alias("rounded"))


@query
def l2_normalize(v: Views) -> DataFrame:
    scaled = F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float"))
    unit = v.raw("embeddings").select("vec_id", vectors.l2_normalize(scaled).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("dim", "x")).select("vec_id", "dim", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


@query
def dimension_guard(v: Views) -> DataFrame:
    """Vectors cut to differing lengths, split by whether they fit."""
    cut = v.raw("embeddings").select("vec_id", F.slice("embedding", 1, (F.col("label") + 56).cast("int")).alias("e"))
    fits, rest = vectors.split_by_dimensions(cut, "e", 64)
    strict = v.raw("embeddings").select("vec_id", F.size(vectors.dimension_guard(F.col("embedding"), 64)).alias("size"))
    both = fits.select("vec_id", F.lit(True).alias("fits")).unionByName(rest.select("vec_id", F.lit(False).alias("fits")))
    return both.join(strict, "vec_id")


@query
def week_start(v: Views) -> DataFrame:
    return v.feedback.select("id", scalars.week_start(F.col("created_at")).alias("week_start"))


@query
def weeks_between(v: Views) -> DataFrame:
    span = v.feedback.groupBy("project_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return span.select("project_id", F.explode(scalars.weeks_between(F.col("first"), F.col("last"))).alias("week_start"))


@query
def week_end(v: Views) -> DataFrame:
    return v.feedback.select("id", scalars.week_end(scalars.week_start(F.col("created_at"))).alias("week_end"))


@query
def is_blank(v: Views) -> DataFrame:
    """Whole texts, texts without their words, and missing type names."""
    rest = F.regexp_replace("embedding_text", r"[\p{L}\p{N}.,]+", "")
    return v.documents.select("id", scalars.is_blank(rest).alias("blank_rest"), scalars.is_blank(F.col("type_name")).alias("blank_type"), scalars.is_blank(F.col("embedding_text")).alias("blank_text"))


@query
def too_long(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", scalars.too_long(F.col("text"), 1000).alias("too_long"))


@query
def default_to(v: Views) -> DataFrame:
    return v.documents.select("id", scalars.default_to(F.col("type_name"), "untyped").alias("type_name"), scalars.default_to(F.col("namespace"), F.col("kind")).alias("namespace"))


@query
def grade_to_score(v: Views) -> DataFrame:
    return v.raw("events").select("event_id", scalars.grade_to_score((F.col("value") / 10).cast("int") - 3).alias("score"))


def _replies(v: Views) -> DataFrame:
    """Stored grader replies: JSON of several shapes, broken text and blanks."""
    n = F.col("event_id")
    kind = F.col("event_type")
    grade = (F.col("user_id") % 14 - 2).cast("string")
    return v.raw("events").select(
        "event_id",
        F.when(kind == "view", F.concat(F.lit('{"score": '), grade, F.lit("}")))
        .when(kind == "click", F.concat(F.lit('{"note": "x", "score":'), grade, F.lit("}")))
        .when(kind == "error", F.col("props"))
        .when(kind == "signup", F.lit("not json"))
        .otherwise(F.lit("  ")).alias("reply"),
    )


@query
def parse_grade(v: Views) -> DataFrame:
    return _replies(v).select("event_id", replies.parse_grade(F.col("reply")).alias("g")).select("event_id", "g.score", "g.error")


@query
def parse_embedding(v: Views) -> DataFrame:
    """Replies wrapped around every stored vector, some empty, read by both providers' shapes."""
    listed = F.to_json("embedding")
    empty = F.col("label") == 0
    wrapped = v.raw("embeddings").select(
        "vec_id",
        F.when(empty, F.lit('{"embeddings": []}')).otherwise(F.concat(F.lit('{"embeddings": ['), listed, F.lit("]}"))).alias("first"),
        F.when(empty, F.lit('{"data": []}')).when(F.col("label") == 1, F.lit("[oops")).otherwise(F.concat(F.lit('{"data": [{"embedding": '), listed, F.lit("}]}"))).alias("second"),
    )
    parsed = wrapped.select(
        "vec_id", replies.parse_embedding(F.col("first"), "Ollama").alias("a"), replies.parse_embedding(F.col("second"), "OpenAI").alias("b")
    )
    x, y = (F.coalesce(F.col(c), F.array().cast("array<float>")) for c in ("a.vector", "b.vector"))
    both = F.arrays_zip(x.alias("x"), y.alias("y"))
    cells = parsed.select("vec_id", F.col("a.error").alias("first_error"), F.col("b.error").alias("second_error"), F.posexplode_outer(both).alias("dim", "c"))
    return cells.select(
        "vec_id", "first_error", "second_error", "dim",
        F.round(F.col("c.x").cast("double"), 6).alias("first"), F.round(F.col("c.y").cast("double"), 6).alias("second"),
    )


def _server_replies(v: Views) -> DataFrame:
    """Whole replies of both kinds of servers made from each event, some broken, blank or without their content."""
    kind, user = F.col("event_type"), F.col("user_id")
    grade = F.concat(F.lit('{\\"score\\": '), (user % 14 - 2).cast("string"), F.lit("}"))
    scored = F.concat(
        F.lit('{"results": [{"index": 1, "relevance_score": '), (user % 8 / 8.0).cast("string"),
        F.lit('}, {"index": 0, "relevance_score": 0.125, "document": "x"}]}'),
    )
    return v.raw("events").select(
        "event_id",
        F.when(kind == "view", F.concat(F.lit('{"model": "m", "response": "'), grade, F.lit('"}')))
        .when(kind == "click", F.lit('{"response": ""}'))
        .when(kind == "error", F.lit('{"model": "m"}'))
        .when(kind == "signup", F.lit('{"response": "not json"}'))
        .otherwise(F.lit(" ")).alias("grader"),
        F.when(kind == "view", scored)
        .when(kind == "click", F.lit('{"results": []}'))
        .when(kind == "error", F.lit('{"results": [{"index": 0}]}'))
        .when(kind == "signup", F.lit("[oops"))
        .otherwise(F.lit("")).alias("lister"),
    )


@query
def parse_grader_reply(v: Views) -> DataFrame:
    return _server_replies(v).select("event_id", replies.parse_grader_reply(F.col("grader")).alias("g")).select("event_id", "g.score", "g.error")


@query
def parse_ranking(v: Views) -> DataFrame:
    parsed = _server_replies(v).select("event_id", replies.parse_ranking(F.col("lister")).alias("r"))
    return parsed.select("event_id", F.col("r.error").alias("error"), F.explode_outer("r.ranking").alias("x")).select("event_id", "error", "x.*")


@query
def json_numbers(v: Views) -> DataFrame:
    value = F.col("value")
    numbers = F.array(F.floor(value * 8) / 8, value / 1048576, value * F.lit(1099511627776), F.floor(value).cast("double"))
    return v.raw("events").select("event_id", scalars.json_numbers(numbers).alias("text"))


@query
def bool_text(v: Views) -> DataFrame:
    return v.feedback.select("id", scalars.bool_text(F.col("useful")).alias("useful"))


@query
def created_at_text(v: Views) -> DataFrame:
    """In UTC, west and east of it, with a half-hour zone, across a clock change."""
    moved = F.col("created_at") + F.expr("make_dt_interval(cast(id % 300 as int))")
    return v.feedback.select("id", moved.alias("t")).select(
        "id",
        scalars.created_at_text(F.col("t")).alias("utc"),
        scalars.created_at_text(F.col("t"), "America/New_York").alias("new_york"),
        scalars.created_at_text(F.col("t"), "Asia/Kolkata").alias("kolkata"),
    )


@query
def known_timezone(v: Views) -> DataFrame:
    zone = F.when(F.col("label") < 3, F.lit("Europe/Paris")).when(F.col("label") < 6, F.concat(F.lit("Mars/Base"), F.col("label").cast("string"))).when(F.col("label") < 8, F.lit(""))
    return v.raw("embeddings").select("vec_id", scalars.is_known_timezone(zone).alias("known"))


@query
def build_prompt(v: Views) -> DataFrame:
    prompt = replies.build_prompt(F.concat(F.lit("what is "), "document_id"), F.col("embedding_text"))
    return v.documents.select("id", F.md5(prompt).alias("digest"), F.length(prompt).cast("long").alias("length"))


@query
def positive_id(v: Views) -> DataFrame:
    number = (F.col("event_id") - 50).cast("string")
    text = F.when(F.col("event_type") == "view", F.concat(number, F.lit(".0"))).when(F.col("event_type") == "error", F.col("props")).otherwise(F.concat(F.lit(" "), number))
    return v.raw("events").select("event_id", scalars.positive_id(text).alias("parsed"))


# --- validation and maintenance


def _filtered_questions(v: Views) -> DataFrame:
    q, n = v.questions, F.col("query_id")
    return plan.complete_requests(
        q.withColumns(
            {
                "question": F.when(n % 10 != 3, F.col("question")).otherwise(F.lit("  ")),
                "min_similarity": F.when(n % 7 == 1, n % 3 * 0.75),
                "kind_operator": F.when(n % 35 == 0, "not_contains").when(n % 5 == 0, "equals"),
                "kind_value": F.when(n % 3 == 0, "en").otherwise(F.lit("")),
                "namespace_operator": F.when(n % 4 == 0, "contains"),
                "namespace_value": F.when(n % 8 == 0, F.repeat(F.lit("x"), 201)).otherwise(F.lit("src1*")),
            }
        )
    )


@query
def validate_search_requests(v: Views) -> DataFrame:
    checked = validate.validate_search_requests(_filtered_questions(v), v.projects)
    return validate.with_messages(checked, "project_id").select("query_id", "project_id", "error_code", "error_message")


@query
def validate_feedback(v: Views) -> DataFrame:
    checked = validate.validate_feedback(v.submissions, v.projects)
    return checked.select("submission_id", "project_id", "error_code")


def _project_changes(v: Views) -> DataFrame:
    """Every customer asks for a project named after its market segment, nation or itself."""
    key = F.col("c_custkey")
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return v.raw("customer").select(
        key.alias("change_id"),
        (F.col("c_nationkey") + 1 + key % 2).cast("long").alias("id"),
        F.when(key % 5 == 0, F.col("c_mktsegment")).when(key % 5 == 1, nation).when(key % 37 == 2, F.lit("  ")).when(key % 41 == 3, F.repeat(F.col("c_name"), 20)).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 11 == 0, F.lit("")).when(key % 3 == 0, F.concat(F.lit("https://git/"), "c_name")).alias("git_url"),
        F.when(key % 13 == 0, F.repeat(F.lit("u"), 2001)).when(key % 4 == 0, F.concat(F.lit("https://raw/"), "c_name")).alias("git_raw_url"),
    )


@query
def validate_project_changes(v: Views) -> DataFrame:
    return validate.validate_project_changes(_project_changes(v)).select("change_id", "error_code")


def _windows(v: Views) -> DataFrame:
    """A report window asked for by each user: one end, both, none, or both swapped."""
    user = F.col("user_id")
    first, last = F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")
    span = v.raw("events").groupBy("user_id").agg(first.alias("first"), last.alias("last"))
    early = F.col("first") - F.expr("make_dt_interval(cast(user_id * 4 as int))")
    return span.select(
        "user_id",
        F.when(user % 5 == 0, F.col("last")).when(user % 5 != 1, early).alias("start_date"),
        F.when(user % 5 == 0, F.col("first")).when(user % 5 != 2, F.col("last")).alias("end_date"),
    )


@query
def stats_window(v: Views) -> DataFrame:
    return validate.with_stats_window(_windows(v), NOW).select("user_id", micros("window_start"), micros("window_end"), "error_code")


@query
def export_window(v: Views) -> DataFrame:
    return validate.with_export_window(_windows(v), NOW).select("user_id", micros("window_start"), micros("window_end"), "error_code")


@query
def validate_project_filter(v: Views) -> DataFrame:
    """Sources and whole texts used as name filters."""
    name = F.when(F.col("doc_id") % 9 == 0, F.lit("")).when(F.col("doc_id") % 9 == 1, F.lit("  ")).when(F.col("doc_id") % 9 == 2, F.col("source")).otherwise(F.col("text"))
    lookups = v.raw("documents").select("doc_id", name.alias("name_filter"))
    return validate.with_project_filter_check(lookups).select("doc_id", "error_code")


@query
def window_project_filter(v: Views) -> DataFrame:
    """Report requests by user for a project that may not exist."""
    asked = v.raw("events").select("user_id", (F.col("user_id") % 30 + 1).alias("project_id")).distinct()
    checked = validate.with_project_check(asked, v.projects)
    return validate.with_messages(checked, "project_id").select("user_id", "project_id", "error_code", "error_message")


@query
def create_projects(v: Views) -> DataFrame:
    after = projects.create_projects(v.projects, _project_changes(v).drop("id"), NOW).projects
    return after.select("id", "name", "git_url", "git_raw_url", micros("created_at"))


@query
def create_projects_outcomes(v: Views) -> DataFrame:
    done = projects.create_projects(v.projects, _project_changes(v).drop("id"), NOW).outcomes
    return validate.with_messages(done, "name").select("change_id", "error_code", "error_message")


@query
def replace_projects(v: Views) -> DataFrame:
    after = projects.replace_projects(v.projects, _project_changes(v)).projects
    return after.select("id", "name", "git_url", "git_raw_url", micros("created_at"))


@query
def replace_projects_outcomes(v: Views) -> DataFrame:
    return projects.replace_projects(v.projects, _project_changes(v)).outcomes.select("change_id", "id", "error_code")


def _deletion(v: Views, now: DataFrame | None = None) -> projects.Maintenance:
    """All documents but poor Spanish texts have moved to one project, so that most projects have none."""
    ids = v.raw("customer").select((F.col("c_nationkey") + 1 + F.col("c_custkey") % 4).cast("long").alias("project_id"))
    poor = (F.col("kind") == "es") & F.coalesce(F.col("type_name") == "PoorText", F.lit(False))
    moved = v.documents.withColumn("project_id", F.when(poor, F.col("project_id")).otherwise(F.lit(25).cast("long")))
    return projects.delete_projects(v.projects if now is None else now, ids, moved, v.feedback)


@query
def delete_projects(v: Views) -> DataFrame:
    return _deletion(v).projects.select("id", "name")


@query
def delete_projects_outcomes(v: Views) -> DataFrame:
    return _deletion(v).outcomes


def _stored_after(v: Views, change: Callable[[DataFrame], projects.Maintenance]) -> DataFrame:
    """The stored projects after a batch of changes, read back."""
    path = scratch_dir(v.spark, "projects")
    tables.write_projects(v.projects, path)
    before = tables.read_stored_projects(v.spark, path)
    tables.store_project_changes(before, change(before).projects, path, scratch_dir(v.spark, "changes"))
    return tables.read_stored_projects(v.spark, path)


@query
def store_new_projects(v: Views) -> DataFrame:
    after = _stored_after(v, lambda now: projects.create_projects(now, _project_changes(v).drop("id"), NOW))
    return after.select("id", "name", "git_url", "git_raw_url", micros("created_at"))


@query
def store_replaced_projects(v: Views) -> DataFrame:
    after = _stored_after(v, lambda now: projects.replace_projects(now, _project_changes(v)))
    return after.select("id", "name", "git_url", "git_raw_url", micros("created_at"))


@query
def store_without_deleted_projects(v: Views) -> DataFrame:
    return _stored_after(v, lambda now: _deletion(v, now)).select("id", "name")


@query
def failure_status(v: Views) -> DataFrame:
    checked = validate.validate_feedback(v.submissions, v.projects).select("submission_id", F.coalesce("error_code", "question").alias("code"))
    return checked.select("submission_id", "code", scalars.failure_status(F.col("code")).alias("status"))


# --- streams


class _Streamed(Views):
    """The derived tables with events read as a stream."""

    def raw(self, name: str) -> DataFrame:
        if name != "events":
            return super().raw(name)
        return self.spark.readStream.schema(FILES[name]).option("pathGlobFilter", "events.parquet").parquet(self.folder)


def _taken_in(v: Views) -> tuple[str, str]:
    """A feedback table with stored rows, after the stream of submissions has run dry; and the rejected rows."""
    rejected, checkpoint = (scratch_dir(v.spark, n) for n in ("rejected", "intake"))
    table = _stored_feedback(v)
    submissions = _Streamed(v.spark, v.folder).submissions
    intake.stream_feedback_intake(submissions, v.projects, table, rejected, checkpoint).awaitTermination()
    return table, rejected


@query
def stream_feedback_intake(v: Views) -> DataFrame:
    """Stored, accepted and rejected rows."""
    table, rejected = _taken_in(v)
    columns = ("project_id", "question", "username", micros("created_at"))
    stored = tables.read_feedback(v.spark, table).select("id", *columns, F.lit(None).cast("string").alias("error_code"))
    refused = v.spark.read.parquet(rejected).select(F.col("submission_id").alias("id"), *columns, "error_code")
    return stored.unionByName(refused)


@query
def weekly_feedback_stats_streamed(v: Views) -> DataFrame:
    """The report over stored and streamed rows."""
    table, _ = _taken_in(v)
    return feedback.weekly_feedback_stats(tables.read_feedback(v.spark, table), v.projects, WINDOW_START, WINDOW_END)


@query
def stream_weekly_counts(v: Views) -> DataFrame:
    """The feedback in four shares, the newest first, a run of the stream each."""
    source, path, checkpoint = (scratch_dir(v.spark, n) for n in ("feedback", "weekly", "weekly-checkpoint"))
    part = F.floor(F.datediff(F.lit(NOW.date()), F.to_date("created_at")) / 8).cast("int")
    for i in range(4):  # days are dealt out by their age
        v.feedback.filter(part.between(i, i) if i < 3 else part >= 3).write.parquet(f"{source}/{i}")
        stream = v.spark.readStream.schema(v.feedback.schema).option("recursiveFileLookup", True).parquet(source)
        intake.write_weekly_counts(intake.stream_weekly_counts(stream), path, checkpoint).awaitTermination()
    return intake.read_weekly_counts(v.spark, path)


@query
def stream_feedback_repeats(v: Views) -> DataFrame:
    """Accepted submissions beside the stored rows, after all have been sent a second time to a stream that was started again."""
    source, rejected, checkpoint = (scratch_dir(v.spark, n) for n in ("submissions", "rejected", "intake"))
    table = _stored_feedback(v)
    for time in ("first", "second"):
        v.submissions.write.parquet(f"{source}/{time}")
        stream = v.spark.readStream.schema(v.submissions.schema).option("recursiveFileLookup", True).parquet(source)
        intake.stream_feedback_intake(stream, v.projects, table, rejected, checkpoint, repeats=True).awaitTermination()
    return tables.read_feedback(v.spark, table).select("id", "project_id", "question", "username", micros("created_at"))


@query
def weekly_feedback_stats_maintained(v: Views) -> DataFrame:
    """The report from kept counts, after late rows, a replay of them, and a day that was stored twice and taken out again."""
    path, counts = (scratch_dir(v.spark, n) for n in ("feedback", "counts"))
    late = F.col("question") == "about error"
    tables.write_feedback(v.feedback.filter(~late), path, intake="first")
    wrong = v.feedback.filter(F.col("created_at").cast("date") == F.lit(datetime(2024, 1, 10).date()))
    tables.write_feedback(wrong, path, intake="wrong")
    maintained.update_counts(v.spark, path, counts)
    for _ in range(2):
        tables.write_feedback(v.feedback.filter(late), path, "overwrite", "late")
        maintained.update_counts(v.spark, path, counts)
    folder = v.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{tables.DAY}=2024-01-10/{tables.INTAKE}=wrong")
    folder.getFileSystem(v.spark._jsc.hadoopConfiguration()).delete(folder, True)
    maintained.update_counts(v.spark, path, counts)
    stored = tables.read_feedback(v.spark, path)
    return maintained.weekly_feedback_stats_maintained(stored, maintained.read_counts(v.spark, counts), v.projects, WINDOW_START, WINDOW_END)


# --- embedding, reranking, end to end


def _embedded(v: Views, embedder: embed.Embedder) -> DataFrame:
    return embed.embed_table(v.raw("documents").select("doc_id", "text"), "text", embedder, tasks=rerank.parallel_tasks(v.spark))


def _cells(vectors_: DataFrame, key: str, column: str) -> DataFrame:
    """One row per number. The outer form keeps Spark from adding a filter on the
    vector below it, for which every text would be embedded a second time."""
    return vectors_.select(key, F.posexplode_outer(column).alias("dim", "x")).select(key, "dim", F.round(F.col("x").cast("double"), 9).alias("x"))


@query
def embed_table(v: Views) -> DataFrame:
    return _cells(_embedded(v, embed.HashedTokens(DIMENSIONS)), "doc_id", "embedding")


@query
def embed_changed(v: Views) -> DataFrame:
    """The English texts were embedded and stored before; the others, and of copies one, are embedded now."""
    path = scratch_dir(v.spark, "embedded")
    embedder, tasks = embed.HashedTokens(DIMENSIONS), rerank.parallel_tasks(v.spark)
    rows = v.raw("documents").select("doc_id", "lang", "text", F.md5("text").alias("embedding_text_hash"))
    embed.embed_table(rows.filter("lang = 'en'"), "text", embedder, tasks=tasks).write.parquet(path)
    done = embed.embed_changed(rows, "text", embedder, v.spark.read.parquet(path), tasks=tasks)
    return done.select("doc_id", "reused", F.posexplode_outer("embedding").alias("dim", "x")).select(
        "doc_id", "reused", "dim", F.round(F.col("x").cast("double"), 9).alias("x")
    )


@query
def resolve_embedder(v: Views) -> DataFrame:
    """The embedder found under another spelling of its name, not normalised, on every question."""
    embedder = embed.resolve_embedder("LOCAL", dimensions=16, normalized=False)
    rows = embed.embed_table(v.questions, "question", embedder, "query_vector")
    return rows.select("query_id", F.posexplode_outer("query_vector").alias("dim", "x"), "embedding_provider", "embedding_dimensions").select(
        "query_id", "dim", F.round(F.col("x").cast("double"), 9).alias("x"), "embedding_provider", "embedding_dimensions"
    )


@query
def hashed_tokens(v: Views) -> DataFrame:
    """Whole texts of any length as one digest per word: counts and lengths."""
    embedder = embed.HashedTokens(200)
    return v.raw("documents").select(
        "doc_id", (F.octet_length(embedder.prepare(F.col("text"))) / 32).cast("long").alias("n_tokens"),
        F.md5(F.array_join(scalars.tokens(F.col("text")), " ")).alias("digest"),
    )


@query
def resolve_reranker(v: Views) -> DataFrame:
    """A reranker looked up by name, applied to every candidate."""
    ranked = rerank.order_by_score(rerank.resolve_reranker("LEXICAL").rerank(_candidates(v)))
    return ranked.select("query_id", "id", "rank", "rerank_score")


@query
def rerank_none(v: Views) -> DataFrame:
    ranked = rerank.order_by_score(rerank.resolve_reranker("None").rerank(_candidates(v)))
    return ranked.select("query_id", "id", "vector_rank", "rank", "rerank_score")


@query
def rerank_pointwise(v: Views) -> DataFrame:
    """Scores of which some are missing; a missing one counts as 0."""
    def scorer(question: F.Column, text: F.Column) -> F.Column:
        return F.when(F.length(text) % 3 != 0, rerank.lexical_score(question, text))

    return rerank.rerank_pointwise(_candidates(v), scorer).select("query_id", "id", "vector_rank", "rerank_score", "rerank_order")


@query
def rerank_listwise(v: Views) -> DataFrame:
    ranked = rerank.rerank_listwise(_candidates(v), rerank.lexical_ranking)
    return ranked.select("query_id", "id", "rerank_order", F.round("rerank_score", 9).alias("rerank_score"))


@query
def lexical_grade(v: Views) -> DataFrame:
    """Every document against the questions that share its id, if any."""
    documents = v.raw("documents").select("doc_id", F.col("text").alias("document"))
    pairs = documents.join(v.raw("conversations"), F.col("conv_id") == F.col("doc_id"), "left")
    return pairs.select("doc_id", "turn", rerank.lexical_grade(F.col("text"), F.col("document")).alias("grade"))


@query
def rerank_batch(v: Views) -> DataFrame:
    ranked = rerank.rerank_batch(_candidates(v), rerank.Pointwise())
    return ranked.select("query_id", "rank", "id", "rerank_score", "similarity")


def _answers(v: Views) -> plan.Answers:
    """Every document's whole text is embedded; the given vectors play no part."""
    embedder = embed.HashedTokens(DIMENSIONS)
    texts = v.raw("documents")
    tasks = None if embed.in_pieces(texts) else rerank.parallel_tasks(v.spark)
    documents = v.documents_of(embed.embed_table(texts, "text", embedder, tasks=tasks), v.raw("embeddings").drop("embedding"))
    return plan.code_search(_filtered_questions(v), v.projects, documents, v.models, embedder, rerank.Pointwise())


@query
def code_search(v: Views) -> DataFrame:
    return _answers(v).hits.withColumn("embedding_text", F.md5("embedding_text"))


@query
def code_search_rejected(v: Views) -> DataFrame:
    return _answers(v).rejected.select("query_id", "error_code", "error_message")

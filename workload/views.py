"""The stored tables, derived from the given Parquet files, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.scalars import instant
from sparkseek.session import configure
from workload.scratch import workers_find_package

# Both ends cut through a week.
WINDOW_START = datetime(2024, 1, 3)
WINDOW_END = datetime(2024, 1, 24, 12)
PROVIDER, MODEL, DIMENSIONS = "Local", "hash-64", 64


# Schemas of the given files; stating them saves a job per read that infers them.
FILES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(FILES[name]).parquet(f"{folder}/{name}.parquet")


class Views:
    """Derived tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder
        workers_find_package(spark)

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.folder, name)

    @property
    def projects(self) -> DataFrame:
        has_url = F.col("n_regionkey") != 0
        return self.raw("nation").select(
            (F.col("n_nationkey") + 1).cast("long").alias("id"),
            F.col("n_name").alias("name"),
            F.when(has_url, F.concat(F.lit("https://git.example.com/"), "n_name")).alias("git_url"),
            F.when(has_url, F.concat(F.lit("https://raw.example.com/"), "n_name")).alias("git_raw_url"),
            instant(datetime(2024, 1, 1)).alias("created_at"),
        )

    @property
    def models(self) -> DataFrame:
        local = F.col("id") == 1
        return self.spark.range(1, 3, numPartitions=1).select(
            "id",
            F.when(local, PROVIDER).otherwise("OpenAI").alias("provider"),
            F.when(local, MODEL).otherwise("other-64").alias("model"),
            F.lit(DIMENSIONS).alias("dimensions"),
            F.lit(True).alias("normalized"),
            F.lit(None).cast("string").alias("configuration"),
            instant(datetime(2024, 1, 1)).alias("created_at"),
        )

    @property
    def documents(self) -> DataFrame:
        """All documents; one without a given vector has none."""
        return self.documents_of(self.raw("documents"), self.raw("embeddings"))

    def documents_of(self, texts: DataFrame, vectors: DataFrame) -> DataFrame:
        """Documents out of their texts and given vectors; one of both has ``embedding``.

        They are joined by ``id``, so that a later join by it does not move the texts again.
        """
        vec = F.col("doc_id")
        d = texts.withColumn("id", vec + 1)
        e = vectors.withColumn("id", F.col("vec_id") + 1)
        l = self.raw("labels").select((vec + 1).alias("id"), "quality")
        return d.join(e, "id", "left").join(l, "id", "left").select(
            "id",
            F.concat(F.lit("doc-"), vec.cast("string")).alias("document_id"),
            F.when(F.col("label") < 2, 2).otherwise(1).cast("long").alias("embedding_model_id"),
            (vec % 20 + 1).alias("project_id"),
            F.col("lang").alias("kind"),
            F.when(vec % 7 != 0, F.col("source")).alias("namespace"),
            F.when(F.col("quality") == 1, "GoodText").when(F.col("quality") == 0, "PoorText").alias("type_name"),
            F.when(vec % 11 != 0, F.concat(F.lit("src/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("source_file"),
            F.col("text").alias("embedding_text"),
            "embedding",
            F.lit(DIMENSIONS).alias("embedding_dimensions"),
        )

    @property
    def stored_documents(self) -> DataFrame:
        """Documents with all stored columns."""
        return self.documents.select(
            "id",
            "document_id",
            "embedding_model_id",
            "project_id",
            F.lit(None).cast("string").alias("schema_version"),
            "kind",
            F.col("kind").alias("language"),
            "namespace",
            "type_name",
            F.lit(None).cast("string").alias("member"),
            "source_file",
            F.lit(None).cast("string").alias("source_hash"),
            F.lit(None).cast("timestamp").alias("analyzed_at"),
            "embedding_text",
            F.md5("embedding_text").alias("embedding_text_hash"),
            F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), DIMENSIONS)).alias("embedding"),
            F.lit(PROVIDER).alias("embedding_provider"),
            "embedding_dimensions",
            F.lit("{}").alias("metadata"),
            instant(datetime(2024, 1, 1)).alias("indexed_at"),
        )

    @property
    def feedback(self) -> DataFrame:
        return feedback_of(self.raw("events"))

    @property
    def requests(self) -> DataFrame:
        """One search request per vector."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("query_id"),
            F.col("embedding").alias("query_vector"),
            (F.col("vec_id") % 20 + 1).alias("project_id"),
            F.lit(10).alias("k"),
        )

    @property
    def filtered_requests(self) -> DataFrame:
        """The same with thresholds and text filters that differ from row to row."""
        vec, label = F.col("query_id"), F.col("label")
        base = self.requests.join(self.raw("embeddings").select(F.col("vec_id").alias("query_id"), "label"), "query_id")
        return base.select(
            "query_id",
            "query_vector",
            "project_id",
            (vec % 7 + 1).alias("k"),
            F.when(label >= 5, label / 100.0).alias("min_similarity"),
            F.when(label == 1, "equals").when(label == 2, "not_equals").when(label == 3, "contains").alias("kind_operator"),
            F.when(label == 1, "en").when(label == 2, "en").when(label == 3, "*E*").alias("kind_value"),
            F.when(label == 4, "not_contains").when(label == 5, "contains").when(label == 6, "not_equals").alias("namespace_operator"),
            F.when(label == 4, "SRC1*").when(label == 5, "*1").when(label == 6, "src2").alias("namespace_value"),
            F.when(label == 7, "not_contains").when(label == 8, "equals").when(label == 3, "contains").alias("type_name_operator"),
            F.when(label == 7, "good*").when(label == 8, "PoorText").when(label == 3, "*text").alias("type_name_value"),
        )

    @property
    def questions(self) -> DataFrame:
        """Natural-language requests: every conversation turn asks one project.

        Some ask a project that does not exist, some are too long.
        """
        conv = F.col("conv_id")
        return self.raw("conversations").select(
            (conv * 100 + F.col("turn")).alias("query_id"),
            (conv % 27 + 1).alias("project_id"),
            F.col("text").alias("question"),
            (F.col("turn") % 4 * 20).cast("int").alias("limit"),
        )

    @property
    def submissions(self) -> DataFrame:
        """Feedback as sent, before any rule is applied: some rows break one."""
        kind, user = F.col("event_type"), F.col("user_id")
        return self.raw("events").select(
            F.col("event_id").alias("submission_id"),
            (user % 27 + 1).alias("project_id"),
            F.when(kind != "view", F.concat(F.lit("about "), kind)).otherwise(F.when(user % 3 == 0, F.lit(" \t")).otherwise(F.lit("looking"))).alias("question"),
            F.when(user % 11 != 0, kind.isin("purchase", "click")).alias("useful"),
            F.when(user % 13 != 0, F.array_repeat(F.round(F.col("value") / 500, 4), (F.col("event_id") % 53).cast("int"))).alias("similarities"),
            F.when(kind == "error", F.col("props")).alias("reason"),
            F.when(user % 17 != 0, F.concat(F.lit("user-"), user.cast("string"))).alias("username"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )


def feedback_of(events: DataFrame) -> DataFrame:
    """Feedback rows out of event rows, batch or streamed."""
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        (F.col("user_id") % 20 + 1).alias("project_id"),
        F.concat(F.lit("about "), kind).alias("question"),
        kind.isin("purchase", "click").alias("useful"),
        F.array(value / 500, value / 1000).alias("similarities"),
        F.when(kind == "error", F.col("props")).alias("reason"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


# The same tables in DuckDB's SQL, for comparison.
SQL = {
    "projects": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name,
               CASE WHEN n_regionkey <> 0 THEN 'https://git.example.com/' || n_name END AS git_url,
               CASE WHEN n_regionkey <> 0 THEN 'https://raw.example.com/' || n_name END AS git_raw_url,
               TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM nation""",
    "models": """
        SELECT CAST(1 AS BIGINT) AS id, 'Local' AS provider, 'hash-64' AS model, 64 AS dimensions, TRUE AS normalized
        UNION ALL SELECT CAST(2 AS BIGINT), 'OpenAI', 'other-64', 64, TRUE""",
    "docs": """
        SELECT d.doc_id + 1 AS id, 'doc-' || CAST(d.doc_id AS VARCHAR) AS document_id,
               CAST(CASE WHEN e.label < 2 THEN 2 ELSE 1 END AS BIGINT) AS embedding_model_id,
               1 + d.doc_id % 20 AS project_id, d.lang AS kind,
               CASE WHEN d.doc_id % 7 <> 0 THEN d.source END AS namespace,
               CASE l.quality WHEN 1 THEN 'GoodText' WHEN 0 THEN 'PoorText' END AS type_name,
               CASE WHEN d.doc_id % 11 <> 0 THEN 'src/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) END AS source_file,
               CAST(NULL AS VARCHAR) AS member,
               d.text AS embedding_text, e.embedding, 64 AS embedding_dimensions
        FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "text_space": """
        SELECT docs.* FROM docs JOIN models m ON m.id = docs.embedding_model_id
        WHERE m.provider = 'Local' AND m.model = 'hash-64' AND m.dimensions = 64""",
    "space": "SELECT * FROM text_space WHERE embedding IS NOT NULL",
    "feedback": """
        SELECT event_id + 1 AS id, 1 + user_id % 20 AS project_id, 'about ' || event_type AS question,
               event_type IN ('purchase', 'click') AS useful, [value / 500, value / 1000] AS similarities,
               CASE WHEN event_type = 'error' THEN props END AS reason,
               'user-' || CAST(user_id AS VARCHAR) AS username, ts AS created_at
        FROM events""",
    "requests": """
        SELECT vec_id AS query_id, embedding AS query_vector, 1 + vec_id % 20 AS project_id, 10 AS k
        FROM embeddings""",
    "filtered_requests": """
        SELECT vec_id AS query_id, embedding AS query_vector, 1 + vec_id % 20 AS project_id, vec_id % 7 + 1 AS k, label,
               CASE WHEN label >= 5 THEN label / 100.0::DOUBLE END AS min_similarity
        FROM embeddings""",
    "pairs": """
        SELECT r.query_id, r.k, d.id,
               list_cosine_similarity(d.embedding::DOUBLE[], r.query_vector::DOUBLE[]) AS sim
        FROM requests r JOIN space d ON d.project_id = r.project_id""",
    "ranked": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS vector_rank FROM pairs)
        WHERE vector_rank <= k""",
    "questions": """
        SELECT conv_id * 100 + turn AS query_id, conv_id % 27 + 1 AS project_id, text AS question,
               CAST(turn % 4 * 20 AS INTEGER) AS "limit"
        FROM conversations""",
    "submissions": r"""
        SELECT event_id AS submission_id, user_id % 27 + 1 AS project_id,
               CASE WHEN event_type <> 'view' THEN 'about ' || event_type WHEN user_id % 3 = 0 THEN E' \t' ELSE 'looking' END AS question,
               CASE WHEN user_id % 11 <> 0 THEN event_type IN ('purchase', 'click') END AS useful,
               CASE WHEN user_id % 13 <> 0 THEN event_id % 53 END AS n_similarities,
               CASE WHEN event_type = 'error' THEN props END AS reason,
               CASE WHEN user_id % 17 <> 0 THEN 'user-' || CAST(user_id AS VARCHAR) END AS username,
               ts AS created_at
        FROM events""",
    "inside": """
        SELECT * FROM feedback
        WHERE created_at >= TIMESTAMP '2024-01-03 00:00:00' AND created_at <= TIMESTAMP '2024-01-24 12:00:00'""",
    "weeks": """
        SELECT CAST(w AS DATE) AS week_start FROM generate_series(
            date_trunc('week', TIMESTAMP '2024-01-03 00:00:00'), date_trunc('week', TIMESTAMP '2024-01-24 12:00:00'),
            INTERVAL 7 DAY) AS t(w)""",
    "stats": """
        SELECT w.week_start, p.id AS project_id, p.name AS project_name, COUNT(f.id) AS total_count,
               COUNT(f.id) FILTER (WHERE f.useful) AS useful_count,
               COUNT(f.id) FILTER (WHERE NOT f.useful) AS not_useful_count
        FROM weeks w CROSS JOIN projects p
        LEFT JOIN inside f ON f.project_id = p.id AND CAST(date_trunc('week', f.created_at) AS DATE) = w.week_start
        GROUP BY w.week_start, p.id, p.name""",
    "percented": """
        SELECT *, CASE WHEN total_count = 0 THEN 0.0::DOUBLE ELSE round_even(useful_count / total_count * 100, 2)::DOUBLE END AS useful_percentage,
               CASE WHEN total_count = 0 THEN 0.0::DOUBLE ELSE round_even(not_useful_count / total_count * 100, 2)::DOUBLE END AS not_useful_percentage
        FROM stats""",
    "question_words": r"""
        SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS words FROM questions""",
    "neighbours": """
        SELECT a.vec_id, a.embedding AS a, b.embedding AS b
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
}

_NEEDS = {
    "text_space": ["docs", "models"],
    "space": ["text_space"],
    "pairs": ["requests", "space"],
    "ranked": ["pairs"],
    "inside": ["feedback"],
    "stats": ["weeks", "projects", "inside"],
    "percented": ["stats"],
    "question_words": ["questions"],
}


def with_views(body: str, *names: str) -> str:
    """A query over the named derived tables."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body if order else body

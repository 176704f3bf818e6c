"""For each registered query, the same result in DuckDB's SQL."""

from __future__ import annotations

from workload.views import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *views: str) -> None:
    """A body that begins with tables of its own has them after the views."""
    if views and body.startswith("WITH "):
        body = ", " + body.removeprefix("WITH ")
    ORACLES[name] = with_views(body, *views)


# --- sources and sinks

oracle("read_projects", "SELECT id, name, git_url, git_raw_url, epoch_us(created_at) AS created_at_us FROM projects", "projects")
oracle(
    "read_embedding_models",
    """SELECT m.id, provider, model, dimensions, normalized, COUNT(d.id) AS n_documents
       FROM models m LEFT JOIN docs d ON d.embedding_model_id = m.id GROUP BY ALL""",
    "models", "docs",
)
oracle(
    "read_code_documents",
    """SELECT id, project_id, kind, namespace, type_name, source_file, md5(embedding_text) AS text_digest, CAST(64 AS BIGINT) AS n_dimensions,
              round(CASE WHEN embedding IS NULL THEN 0 ELSE list_sum(embedding::DOUBLE[]) END, 9)::DOUBLE AS embedding_sum
       FROM docs""",
    "docs",
)
oracle(
    "read_feedback",
    """SELECT id, project_id, question, useful, reason, username, round(similarities[1] + similarities[2], 6) AS similarity_sum,
              epoch_us(created_at) AS created_at_us, CAST(created_at AS DATE) AS created_on
       FROM feedback""",
    "feedback",
)
oracle(
    "read_feedback_window",
    """SELECT id, project_id, question, useful, reason, username, epoch_us(created_at) AS created_at_us FROM feedback
       WHERE created_at >= DATE '2024-01-03' AND created_at < DATE '2024-01-25'""",
    "feedback",
)
oracle(
    "check_constraints",
    """SELECT 'code_documents' AS "table", 'unique (document_id, embedding_model_id)' AS "constraint",
              md5(embedding_text) || '|' || embedding_model_id AS "key", COUNT(*) AS violations
       FROM docs GROUP BY embedding_text, embedding_model_id HAVING COUNT(*) > 1
       UNION ALL
       SELECT 'code_documents', 'foreign key (embedding_model_id)', CAST(embedding_model_id AS VARCHAR), COUNT(*)
       FROM docs WHERE embedding_model_id = 2 GROUP BY embedding_model_id
       UNION ALL
       SELECT 'code_documents', 'foreign key (project_id)', CAST(project_id AS VARCHAR), COUNT(*)
       FROM docs WHERE project_id NOT IN (SELECT id FROM projects WHERE git_url IS NOT NULL) GROUP BY project_id
       UNION ALL
       SELECT 'code_documents', 'not null', 'embedding', COUNT(*) FROM docs WHERE embedding IS NULL HAVING COUNT(*) > 0
       UNION ALL
       SELECT 'code_query_feedback', 'not null', 'username', COUNT(*) FROM feedback WHERE reason IS NOT NULL
       UNION ALL
       SELECT 'code_query_feedback', 'foreign key (project_id)', CAST(project_id AS VARCHAR), COUNT(*)
       FROM feedback WHERE project_id NOT IN (SELECT id FROM projects WHERE git_url IS NOT NULL) GROUP BY project_id""",
    "docs", "feedback", "projects",
)

FEEDBACK_ERROR = r"""
    CASE WHEN question IS NULL OR regexp_full_match(question, '\s*') THEN '400-question-required'
         WHEN length(question) > 1000 THEN '400-question-too-long'
         WHEN useful IS NULL THEN '400-useful-required'
         WHEN n_similarities IS NULL THEN '400-similarities-required'
         WHEN n_similarities > 50 THEN '400-too-many-similarities'
         WHEN username IS NULL OR regexp_full_match(username, '\s*') THEN '400-user-required'
         WHEN length(username) > 200 THEN '400-user-too-long'
         WHEN length(reason) > 1000 THEN '400-reason-too-long'
         WHEN project_id NOT IN (SELECT id FROM projects) THEN '404-project-not-found' END"""

oracle(
    "append_feedback",
    f"""SELECT (SELECT MAX(id) FROM feedback) + row_number() OVER (ORDER BY submission_id) AS id,
              project_id, question, useful, n_similarities, reason, username, epoch_us(created_at) AS created_at_us
        FROM submissions WHERE {FEEDBACK_ERROR} IS NULL""",
    "submissions", "projects", "feedback",
)

NUMBER = "upper(regexp_replace(CAST({} AS VARCHAR), '\\.0$', ''))"


def instant(column: str, zone: str) -> str:
    """A wall clock with its offset, out of a UTC timestamp."""
    local = f"(({column} AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"
    minutes = f"CAST(epoch(date_trunc('second', {local})) - epoch(date_trunc('second', {column})) AS BIGINT) // 60"
    return (
        f"strftime({local}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {minutes} < 0 THEN '-' ELSE '+' END || "
        f"printf('%02d:%02d', abs({minutes}) // 60, abs({minutes}) % 60)"
    )


oracle(
    "export_feedback_csv",
    f"""SELECT f.id, project_id, name AS project_name, question, CASE WHEN useful THEN 'True' ELSE 'False' END AS useful,
              '[' || {NUMBER.format("similarities[1]")} || ',' || {NUMBER.format("similarities[2]")} || ']' AS similarities, reason, username,
              {instant("f.created_at", "America/Sao_Paulo")} AS created_at
        FROM inside f JOIN projects p ON p.id = f.project_id""",
    "inside", "projects",
)
QUOTED = "CASE WHEN regexp_matches({0}, '[,\"\r\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"
EXPORT_LINE = " || ',' || ".join(
    [
        "f.id", "project_id", *[QUOTED.format(c) for c in ("name", "question")], "CASE WHEN useful THEN 'True' ELSE 'False' END",
        QUOTED.format(f"""('[' || {NUMBER.format("similarities[1]")} || ',' || {NUMBER.format("similarities[2]")} || ']')"""),
        *[QUOTED.format(c) for c in ("reason", "username")], instant("f.created_at", "America/Sao_Paulo"),
    ]
)
oracle(
    "export_feedback_parts",
    f"""SELECT CAST(0 AS BIGINT) AS place, 'id,project_id,project_name,question,useful,similarities,reason,username,created_at' AS line
        UNION ALL
        SELECT row_number() OVER (ORDER BY f.created_at, f.id), {EXPORT_LINE} FROM inside f JOIN projects p ON p.id = f.project_id""",
    "inside", "projects",
)
oracle(
    "write_weekly_json",
    """SELECT CAST(week_start AS VARCHAR) AS week_start, CAST(week_start + 6 AS VARCHAR) AS week_end, project_id, project_name,
              total_count, useful_count, not_useful_count, useful_percentage, not_useful_percentage
       FROM percented""",
    "percented",
)
oracle(
    "export_file_stem",
    """SELECT project_id,
              'feedback_export_' || strftime(MIN(created_at), '%Y%m%d') || '_' || strftime(MAX(created_at), '%Y%m%d') || '_project-' || project_id || '.csv' AS one_project,
              'feedback_export_' || strftime(MIN(created_at), '%Y%m%d') || '_' || strftime(MAX(created_at), '%Y%m%d') || '.csv' AS all_projects
       FROM feedback GROUP BY project_id""",
    "feedback",
)

oracle(
    "check_new_rows",
    """WITH batch AS (
         SELECT * REPLACE (
           CASE WHEN namespace IS NULL THEN 'doc-' || id ELSE document_id END AS document_id,
           CASE WHEN source_file IS NULL THEN project_id + 1000 ELSE project_id END AS project_id)
         FROM docs WHERE kind = 'es'),
       later AS (SELECT * REPLACE (CASE WHEN useful THEN id ELSE id + 1 END AS id) FROM feedback WHERE question = 'about error'),
       every AS (SELECT id, document_id, embedding_model_id FROM docs WHERE kind <> 'es' UNION ALL SELECT id, document_id, embedding_model_id FROM batch),
       rows AS (SELECT id FROM feedback WHERE question <> 'about error' UNION ALL SELECT id FROM later)
       SELECT 'code_documents' AS "table", 'unique (document_id, embedding_model_id)' AS "constraint",
              document_id || '|' || embedding_model_id AS "key", COUNT(*) AS violations
       FROM every GROUP BY document_id, embedding_model_id HAVING COUNT(*) > 1
       UNION ALL
       SELECT 'code_documents', 'foreign key (project_id)', CAST(project_id AS VARCHAR), COUNT(*) FROM batch
       WHERE project_id NOT IN (SELECT id FROM projects) GROUP BY project_id
       UNION ALL
       SELECT 'code_documents', 'not null', 'embedding', COUNT(*) FROM batch WHERE embedding IS NULL HAVING COUNT(*) > 0
       UNION ALL
       SELECT 'code_query_feedback', 'primary key (id)', CAST(id AS VARCHAR), COUNT(*) FROM rows GROUP BY id HAVING COUNT(*) > 1""",
    "docs", "feedback", "projects",
)

# --- predicates

oracle(
    "match_patterns",
    r"""WITH words AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
       patterns AS (
         SELECT item_id * 10 AS pattern_id, '%' || w[2][1:4] || '%' AS pattern FROM words
         UNION ALL SELECT item_id * 10 + 1, '%' || upper(w[3]) || ' ' || w[4] || '%' FROM words
         UNION ALL SELECT item_id * 10 + 2, '%' || w[3][1:2] || '_' || w[5][1:1] || '%' FROM words
         UNION ALL SELECT item_id * 10 + 3, w[1][1:1] || '%' FROM words
         UNION ALL SELECT item_id * 10 + 4, CASE item_id % 4 WHEN 0 THEN '%' WHEN 1 THEN '%\%%' END FROM words)
       SELECT pattern_id, doc_id AS id FROM patterns JOIN documents ON text ILIKE pattern ESCAPE '\'""".replace("\\\\", "\\"),
)


def where(name: str, condition: str) -> None:
    oracle(name, f"SELECT id, project_id, kind, namespace, type_name FROM docs WHERE {condition}", "docs")


where("in_project", "project_id = 7")
where("kind_filter_contains", "kind ILIKE '%E%'")
where("kind_filter_equals", "kind = 'en'")
where("kind_filter_not_equals", "kind <> 'en'")
where("namespace_filter_contains", "namespace ILIKE 'SRC1%'")
where("namespace_filter_not_contains", "namespace IS NULL OR namespace NOT ILIKE 'SRC1_'")
where("namespace_filter_equals", "namespace = 'src3'")
where("namespace_filter_not_equals", "namespace IS NULL OR namespace <> 'src3'")
where("type_name_filter_contains", "type_name ILIKE 'good%'")
where("type_name_filter_not_contains", "type_name IS NULL OR type_name NOT ILIKE '%OR%'")
where("type_name_filter_equals", "type_name = 'GoodText'")
where("all_of", "kind <> 'de' AND namespace ILIKE '%1%' AND (type_name IS NULL OR type_name NOT ILIKE 'Poor%')")
oracle(
    "wildcard",
    """SELECT doc_id, 'S%' || substr(source, 4, 1) || '%' AS pattern, 's_c' || right(source, 1) AS tidied,
              source ILIKE 'S%' || substr(source, 4, 1) || '%' AS matched,
              source ILIKE 's_c' || right(source, 1) AS matched_tidied
       FROM documents""",
)

COSINE = "list_cosine_similarity(a::DOUBLE[], b::DOUBLE[])"
oracle(
    "min_similarity",
    f"SELECT vec_id, round({COSINE}, 10) AS similarity FROM neighbours WHERE {COSINE} >= 0.05",
    "neighbours",
)
oracle("in_window", "SELECT id, epoch_us(created_at) AS created_at_us FROM inside", "inside")
oracle(
    "project_name_contains",
    """SELECT c_custkey, c_name AS name FROM customer
       WHERE c_name ILIKE '%CUSTOMER#%1%' OR c_name ILIKE '%_0' || CAST(c_nationkey AS VARCHAR) || '%'""",
)
oracle(
    "project_name_is",
    """SELECT c_custkey AS id, c_mktsegment AS name FROM customer
       WHERE (c_mktsegment = 'BUILDING' AND c_custkey <> 7) OR c_mktsegment = 'building'""",
)
oracle(
    "hit_columns",
    "SELECT id, source_file, kind, type_name, member, md5(embedding_text) AS embedding_text FROM docs",
    "docs",
)
oracle(
    "with_git_links",
    """SELECT d.id, d.project_id, source_file, git_url, git_raw_url || '/' || source_file AS git_raw_url
       FROM docs d JOIN projects p ON p.id = d.project_id""",
    "docs", "projects",
)

# --- joins

oracle("with_embedding_space", "SELECT id, project_id, embedding_model_id FROM space", "space")
oracle(
    "feedback_with_project",
    "SELECT f.id, project_id, name AS project_name, useful FROM feedback f JOIN projects p ON p.id = f.project_id",
    "feedback", "projects",
)
oracle(
    "week_project_grid",
    """SELECT CAST(w AS DATE) AS week_start, p.id AS project_id, p.name AS project_name
       FROM generate_series((SELECT date_trunc('week', MIN(created_at)) FROM feedback), (SELECT date_trunc('week', MAX(created_at)) FROM feedback), INTERVAL 7 DAY) t(w)
       CROSS JOIN projects p""",
    "feedback", "projects",
)
oracle("grid_with_feedback", "SELECT * FROM stats", "stats")
ASKED = "SELECT DISTINCT user_id % 30 + 1 AS project_id FROM events"
oracle("projects_exist", f"SELECT project_id, project_id IN (SELECT id FROM projects) AS \"exists\" FROM ({ASKED})", "projects")
oracle("project_by_id", f"SELECT id, name, git_url, git_raw_url FROM projects WHERE id IN ({ASKED})", "projects")
oracle("has_documents", "SELECT id, name, id IN (SELECT project_id FROM docs) AS has_documents FROM projects", "projects", "docs")
oracle("has_feedback", "SELECT id, name, id IN (SELECT project_id FROM feedback) AS has_feedback FROM projects", "projects", "feedback")
oracle(
    "name_exists",
    """SELECT n.*, EXISTS (SELECT 1 FROM projects p WHERE p.name = n.name AND (n.excluding IS NULL OR p.id <> n.excluding)) AS "exists"
       FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'nation_' ELSE 'NATION_' END || CAST(s_nationkey AS VARCHAR) AS name,
                    CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey + 1 AS BIGINT) END AS excluding FROM supplier) n""",
    "projects",
)
oracle(
    "join_scores",
    """SELECT query_id, r.id, (r.id * 7) % 10 / 10.0::DOUBLE AS rerank_score, CAST(vector_rank AS INTEGER) AS vector_rank, kind
       FROM ranked r JOIN docs d ON d.id = r.id WHERE kind = 'en'""",
    "ranked", "docs",
)
oracle(
    "unknown_scores",
    """SELECT query_id, r.id, (r.id * 7) % 10 / 10.0::DOUBLE AS rerank_score
       FROM ranked r JOIN docs d ON d.id = r.id WHERE kind = 'en' AND vector_rank > 5""",
    "ranked", "docs",
)
oracle(
    "listwise_to_ids",
    """SELECT query_id, id, vector_rank / 10.0::DOUBLE AS rerank_score,
              CAST(MAX(vector_rank) OVER (PARTITION BY query_id) - vector_rank + 1 AS INTEGER) AS rerank_order
       FROM ranked""",
    "ranked",
)
CANDIDATES = """
    SELECT r.query_id, r.id, CAST(r.vector_rank AS INTEGER) AS vector_rank, d.project_id, d.source_file, d.embedding_text, r.sim,
           q.text AS question, CAST(r.query_id % 5 + 1 AS INTEGER) AS "limit"
    FROM ranked r JOIN docs d ON d.id = r.id JOIN documents q ON q.doc_id = r.query_id"""
oracle(
    "hits_with_project",
    f"""SELECT query_id, c.id, vector_rank, c.project_id, source_file, git_url, git_raw_url || '/' || source_file AS git_raw_url
        FROM ({CANDIDATES}) c JOIN projects p ON p.id = c.project_id""",
    "ranked", "docs", "projects",
)

# --- aggregations

oracle(
    "weekly_counts",
    """SELECT CAST(date_trunc('week', created_at) AS DATE) AS week_start, project_id, COUNT(id) AS total_count,
              COUNT(*) FILTER (WHERE useful) AS useful_count, COUNT(*) FILTER (WHERE NOT useful) AS not_useful_count
       FROM inside GROUP BY ALL""",
    "inside",
)
for column in ("total_count", "useful_count", "not_useful_count"):
    oracle(column, f"SELECT week_start, project_id, {column} FROM stats", "stats")
oracle(
    "useful_pct",
    """SELECT username, COUNT(*) AS total_count, COUNT(*) FILTER (WHERE useful) AS useful_count, COUNT(*) FILTER (WHERE NOT useful) AS not_useful_count,
              round_even(COUNT(*) FILTER (WHERE useful) / COUNT(*) * 100, 2)::DOUBLE AS useful_percentage,
              round_even(COUNT(*) FILTER (WHERE NOT useful) / COUNT(*) * 100, 2)::DOUBLE AS not_useful_percentage
       FROM feedback GROUP BY username""",
    "feedback",
)
oracle("weekly_feedback_stats", "SELECT * FROM percented", "percented")
oracle("weekly_feedback_stats_one_project", "SELECT * FROM percented WHERE project_id = 3", "percented")
oracle(
    "nest_weeks",
    """SELECT week_start, CAST(week_start + 6 AS DATE) AS week_end, CAST(row_number() OVER (PARTITION BY week_start ORDER BY project_id) - 1 AS INTEGER) AS place,
              project_id, project_name, total_count, useful_count, not_useful_count, useful_percentage, not_useful_percentage
       FROM percented""",
    "percented",
)
oracle(
    "nest_weeks_in_parts",
    """SELECT week_start, project_id // 10 AS part,
              CAST(row_number() OVER (PARTITION BY week_start, project_id // 10 ORDER BY project_id) - 1 AS INTEGER) AS place, project_id, total_count
       FROM percented""",
    "percented",
)
oracle("weekly_feedback_stats_stored", "SELECT * FROM percented", "percented")
oracle("weekly_feedback_stats_maintained", "SELECT * FROM percented", "percented")
oracle(
    "mean_pool",
    """SELECT label, COUNT(*) AS token_count, CAST(dim AS INTEGER) AS dim, round(AVG(embedding[dim + 1]::DOUBLE), 9) AS mean
       FROM embeddings CROSS JOIN range(64) t(dim) GROUP BY label, dim""",
)

# --- search and order

oracle(
    "search",
    """SELECT d.id, source_file, kind, type_name, member, md5(embedding_text) AS embedding_text, round(sim, 10) AS similarity
       FROM docs d JOIN (
           SELECT id, list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
           FROM space s, (SELECT embedding FROM embeddings WHERE vec_id = 3) e
           WHERE project_id = 4 AND (type_name IS NULL OR type_name NOT ILIKE 'poor%') AND kind ILIKE '%E%'
             AND list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= -0.2
           ORDER BY sim DESC, id LIMIT 10) USING (id)""",
    "space",
)
oracle(
    "search_by_expression",
    """SELECT d.id, source_file, kind, type_name, member, md5(embedding_text) AS embedding_text, round(sim, 10) AS similarity
       FROM docs d JOIN (
           SELECT id, list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
           FROM space s, (SELECT embedding FROM embeddings WHERE vec_id = 3) e
           WHERE project_id = 4 AND (type_name IS NULL OR type_name NOT ILIKE 'good%')
             AND list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= -0.1
           ORDER BY sim DESC, id LIMIT 10) USING (id)""",
    "space",
)
oracle(
    "search_batch",
    """SELECT query_id, CAST(vector_rank AS INTEGER) AS vector_rank, d.id, source_file, kind, type_name, member,
              md5(embedding_text) AS embedding_text, round(sim, 10) AS similarity
       FROM ranked r JOIN docs d ON d.id = r.id""",
    "ranked",
)
ORACLES["search_batch_blocks"] = ORACLES["search_batch"]
ORACLES["search_pruned"] = ORACLES["search_batch"]
oracle(
    "search_stored",
    """SELECT d.id, source_file, kind, type_name, member, md5(embedding_text) AS embedding_text, round(sim, 10) AS similarity
       FROM docs d JOIN (
           SELECT id, list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
           FROM space s, (SELECT embedding FROM embeddings WHERE vec_id = 3) e WHERE project_id = 4
           ORDER BY sim DESC, id LIMIT 10) USING (id)""",
    "space",
)
oracle(
    "search_batch_filtered",
    """, scored AS (
           SELECT r.query_id, r.k, d.id, list_cosine_similarity(d.embedding::DOUBLE[], r.query_vector::DOUBLE[]) AS sim
           FROM filtered_requests r JOIN space d ON d.project_id = r.project_id
           WHERE (min_similarity IS NULL OR list_cosine_similarity(d.embedding::DOUBLE[], r.query_vector::DOUBLE[]) >= min_similarity)
             AND CASE label WHEN 1 THEN kind = 'en' WHEN 2 THEN kind <> 'en' WHEN 3 THEN kind ILIKE '%E%' AND COALESCE(type_name ILIKE '%text', FALSE)
                 WHEN 4 THEN namespace IS NULL OR namespace NOT ILIKE 'SRC1%' WHEN 5 THEN COALESCE(namespace ILIKE '%1', FALSE)
                 WHEN 6 THEN namespace IS NULL OR namespace <> 'src2' WHEN 7 THEN type_name IS NULL OR type_name NOT ILIKE 'good%'
                 WHEN 8 THEN COALESCE(type_name = 'PoorText', FALSE) ELSE TRUE END)
       SELECT query_id, CAST(n AS INTEGER) AS vector_rank, id, round(sim, 10) AS similarity
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS n FROM scored) WHERE n <= k""",
    "filtered_requests", "space",
)
ORACLES["search_batch_blocks_filtered"] = ORACLES["search_batch_filtered"]
ORACLES["search_pruned_filtered"] = ORACLES["search_batch_filtered"]
oracle(
    "best_per_query",
    """SELECT query_id, id, distance, CAST(n AS INTEGER) AS vector_rank FROM (
           SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS id, -l_extendedprice AS distance,
                  row_number() OVER (PARTITION BY l_suppkey ORDER BY -l_extendedprice, l_orderkey * 10 + l_linenumber) AS n
           FROM lineitem) WHERE n <= 10""",
)
oracle(
    "pool_size",
    """SELECT query_id, lim AS "limit", CAST(least(greatest(COALESCE(lim, 10), 25), 200) AS INTEGER) AS k
       FROM (SELECT query_id, CASE WHEN "limit" > 0 THEN "limit" * 5 END AS lim FROM questions)""",
    "questions",
)
SCORED = """SELECT query_id, id, CAST(vector_rank AS INTEGER) AS vector_rank,
                   CASE WHEN id % 4 <> 0 THEN id % 3 / 10.0::DOUBLE END AS rerank_score FROM ranked"""
RANKED_SCORES = f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, vector_rank) AS INTEGER) AS rank FROM ({SCORED})"""
oracle("order_by_score", RANKED_SCORES, "ranked")
oracle(
    "take_requested",
    f"""SELECT *, CAST(CASE WHEN query_id % 2 = 0 THEN 3 END AS INTEGER) AS "limit" FROM ({RANKED_SCORES})
        WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 3 ELSE 10 END""",
    "ranked",
)
oracle("list_projects", "SELECT id, name, git_url, git_raw_url FROM projects WHERE name ILIKE '%ATION_1%' ORDER BY name", "projects")
oracle(
    "export_rows",
    """SELECT f.id, project_id, name AS project_name, question, useful, reason, username, epoch_us(f.created_at) AS created_at_us
       FROM inside f JOIN projects p ON p.id = f.project_id ORDER BY f.created_at, f.id""",
    "inside", "projects",
)
oracle("in_grid_order", "SELECT week_start, project_id, total_count FROM stats ORDER BY ALL", "stats")

# --- scalar functions

oracle("cosine_distance", f"SELECT vec_id, round(1 - {COSINE}, 10) AS distance FROM neighbours", "neighbours")
oracle(
    "similarity",
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x: CAST(x * x AS FLOAT))::DOUBLE[]), 10) AS similarity
       FROM embeddings""",
)
oracle("round10", "SELECT event_id, round(value / 7, 10) AS rounded FROM events")
oracle(
    "l2_normalize",
    """SELECT vec_id, CAST(dim AS INTEGER) AS dim,
              round(CAST(CAST(e[dim + 1]::DOUBLE / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS x
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * (label + 1) AS FLOAT)) AS e FROM embeddings) CROSS JOIN range(64) t(dim)""",
)
oracle("dimension_guard", "SELECT vec_id, label >= 8 AS fits, CAST(64 AS INTEGER) AS size FROM embeddings")
oracle("week_start", "SELECT id, CAST(date_trunc('week', created_at) AS DATE) AS week_start FROM feedback", "feedback")
oracle(
    "weeks_between",
    """SELECT project_id, CAST(unnest(generate_series(date_trunc('week', MIN(created_at)), date_trunc('week', MAX(created_at)), INTERVAL 7 DAY)) AS DATE) AS week_start
       FROM feedback GROUP BY project_id""",
    "feedback",
)
oracle("week_end", "SELECT id, CAST(date_trunc('week', created_at) + INTERVAL 6 DAY AS DATE) AS week_end FROM feedback", "feedback")
oracle(
    "is_blank",
    r"""SELECT id, regexp_full_match(regexp_replace(embedding_text, '[\p{L}\p{N}.,]+', '', 'g'), '\s*') AS blank_rest,
               type_name IS NULL AS blank_type, regexp_full_match(embedding_text, '\s*') AS blank_text
        FROM docs""",
    "docs",
)
oracle("too_long", "SELECT doc_id, length(text) > 1000 AS too_long FROM documents")
oracle("default_to", "SELECT id, COALESCE(type_name, 'untyped') AS type_name, COALESCE(namespace, kind) AS namespace FROM docs", "docs")
oracle("grade_to_score", "SELECT event_id, least(greatest(CAST(trunc(value / 10) AS INTEGER) - 3, 0), 10) / 10.0::DOUBLE AS score FROM events")
oracle(
    "parse_grade",
    """SELECT event_id,
              CASE WHEN event_type IN ('view', 'click') THEN least(greatest(user_id % 14 - 2, 0), 10) / 10.0::DOUBLE WHEN event_type = 'error' THEN 0.0::DOUBLE END AS score,
              CASE event_type WHEN 'signup' THEN 'malformed' WHEN 'purchase' THEN 'blank' END AS error
       FROM events""",
)
oracle(
    "parse_embedding",
    """SELECT vec_id, CASE WHEN label = 0 THEN 'no-embedding' END AS first_error, CASE label WHEN 0 THEN 'no-embedding' WHEN 1 THEN 'malformed' END AS second_error,
              CASE WHEN label > 0 THEN CAST(dim AS INTEGER) END AS dim, CASE WHEN label > 0 THEN round(embedding[dim + 1]::DOUBLE, 6) END AS first,
              CASE WHEN label > 1 THEN round(embedding[dim + 1]::DOUBLE, 6) END AS second
       FROM embeddings CROSS JOIN range(64) t(dim) WHERE label > 0 OR dim = 0""",
)
oracle(
    "parse_grader_reply",
    """SELECT event_id, CASE event_type WHEN 'view' THEN least(greatest(user_id % 14 - 2, 0), 10) / 10.0::DOUBLE END AS score,
              CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN 'malformed' ELSE 'blank' END AS error
       FROM events""",
)
oracle(
    "parse_ranking",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN NULL WHEN event_type IN ('error', 'signup') THEN 'malformed' ELSE 'blank' END AS error,
              CASE event_type WHEN 'view' THEN CAST(n AS INTEGER) END AS rerank_order, CASE event_type WHEN 'view' THEN CAST(2 - n AS INTEGER) END AS "index",
              CASE event_type WHEN 'view' THEN CASE n WHEN 1 THEN user_id % 8 / 8.0::DOUBLE ELSE 0.125::DOUBLE END END AS rerank_score
       FROM events CROSS JOIN range(1, 3) t(n) WHERE event_type = 'view' OR n = 1""",
)
oracle(
    "json_numbers",
    f"""SELECT event_id, '[' || {NUMBER.format("floor(value * 8) / 8")} || ',' || {NUMBER.format("value / 1048576")} || ',' || {NUMBER.format("value * 1099511627776")} || ',' || {NUMBER.format("floor(value)")} || ']' AS text
        FROM events""",
)
oracle("bool_text", "SELECT id, CASE WHEN useful THEN 'True' ELSE 'False' END AS useful FROM feedback", "feedback")
oracle(
    "created_at_text",
    f"""SELECT id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS utc, {instant("t", "America/New_York")} AS new_york, {instant("t", "Asia/Kolkata")} AS kolkata
        FROM (SELECT id, created_at + to_days(CAST(id % 300 AS INTEGER)) AS t FROM feedback)""",
    "feedback",
)
oracle("known_timezone", "SELECT vec_id, label < 3 OR label >= 6 AS known FROM embeddings")
PROMPT = (
    "'Judge how well a piece of code answers a question about a code base. "
    "Reply with JSON holding one whole number, score, between 0 (unrelated) and 10 (a full answer).' || E'\\n\\nQuestion: ' "
    "|| 'what is ' || document_id || E'\\n\\nCode:\\n' || embedding_text"
)
oracle("build_prompt", f"SELECT id, md5({PROMPT}) AS digest, length({PROMPT}) AS length FROM docs", "docs")
oracle(
    "positive_id",
    "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'error') AND event_id > 50 THEN event_id - 50 END AS parsed FROM events",
)

# --- validation and maintenance

FILTERED_QUESTIONS = r"""
    SELECT query_id, project_id, "limit", CASE WHEN query_id % 10 <> 3 THEN question ELSE '  ' END AS question,
           CASE WHEN query_id % 7 = 1 THEN query_id % 3 * 0.75::DOUBLE END AS min_similarity,
           query_id % 5 = 0 AS by_kind, query_id % 35 = 0 AS odd_kind, CASE WHEN query_id % 3 = 0 THEN 'en' ELSE '' END AS kind_value,
           query_id % 4 = 0 AS by_namespace, query_id % 8 = 0 AS long_namespace
    FROM questions"""
SEARCH_ERROR = r"""
    CASE WHEN regexp_full_match(question, '\s*') THEN '400-question-required'
         WHEN length(question) > 1000 THEN '400-question-too-long'
         WHEN "limit" NOT BETWEEN 1 AND 50 THEN '400-limit-out-of-range'
         WHEN min_similarity NOT BETWEEN 0 AND 1 THEN '400-min-similarity-out-of-range'
         WHEN odd_kind THEN '400-kind-filter-operator-unknown'
         WHEN by_kind AND kind_value = '' THEN '400-kind-filter-value-required'
         WHEN by_namespace AND long_namespace THEN '400-namespace-filter-value-too-long'
         WHEN project_id NOT IN (SELECT id FROM projects) THEN '404-project-not-found' END"""
SEARCH_MESSAGE = """
    CASE error_code WHEN '400-question-required' THEN 'The ''question'' field is required and must not be empty.'
         WHEN '400-question-too-long' THEN 'The ''question'' field must be at most 1000 characters long.'
         WHEN '400-limit-out-of-range' THEN 'The ''limit'' field must be between 1 and 50.'
         WHEN '400-min-similarity-out-of-range' THEN 'The ''minSimilarity'' field must be between 0.0 and 1.0.'
         WHEN '400-kind-filter-operator-unknown' THEN 'The ''kind'' filter''s ''operator'' field must be one of contains, equals, not_equals.'
         WHEN '400-kind-filter-value-required' THEN 'The ''kind'' filter''s ''value'' field is required and must not be empty.'
         WHEN '400-namespace-filter-value-too-long' THEN 'The ''namespace'' filter''s ''value'' field must be at most 200 characters long.'
         WHEN '404-project-not-found' THEN 'No project exists with id ' || project_id || '.' END"""
CHECKED_QUESTIONS = f"SELECT *, {SEARCH_ERROR} AS error_code FROM ({FILTERED_QUESTIONS})"
oracle(
    "validate_search_requests",
    f"SELECT query_id, project_id, error_code, {SEARCH_MESSAGE} AS error_message FROM ({CHECKED_QUESTIONS})",
    "questions", "projects",
)
oracle("validate_feedback", f"SELECT submission_id, project_id, {FEEDBACK_ERROR} AS error_code FROM submissions", "submissions", "projects")
CHANGES = """
    SELECT c_custkey AS change_id, CAST(c_nationkey + 1 + c_custkey % 2 AS BIGINT) AS id,
           CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 1 THEN 'NATION_' || c_nationkey WHEN c_custkey % 37 = 2 THEN '  '
                WHEN c_custkey % 41 = 3 THEN repeat(c_name, 20) ELSE c_name END AS name,
           CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'https://git/' || c_name END AS git_url,
           CASE WHEN c_custkey % 13 = 0 THEN repeat('u', 2001) WHEN c_custkey % 4 = 0 THEN 'https://raw/' || c_name END AS git_raw_url
    FROM customer"""
CHANGE_ERROR = r"""
    CASE WHEN regexp_full_match(name, '\s*') THEN '400-name-required' WHEN length(name) > 200 THEN '400-name-field-too-long'
         WHEN regexp_full_match(git_url, '\s*') THEN '400-git-url-empty' WHEN length(git_url) > 2000 THEN '400-git-url-too-long'
         WHEN regexp_full_match(git_raw_url, '\s*') THEN '400-git-raw-url-empty' WHEN length(git_raw_url) > 2000 THEN '400-git-raw-url-too-long' END"""
CHECKED_CHANGES = f"SELECT *, {CHANGE_ERROR} AS rule FROM ({CHANGES})"
oracle("validate_project_changes", f"SELECT change_id, rule AS error_code FROM ({CHECKED_CHANGES})")
CREATED = f"""
    SELECT change_id, name, git_url, git_raw_url,
           CASE WHEN rule IS NOT NULL THEN rule WHEN name IN (SELECT name FROM projects) THEN '409-name-already-exists'
                WHEN row_number() OVER (PARTITION BY name, rule IS NULL ORDER BY change_id) > 1 THEN '409-name-already-exists' END AS error_code
    FROM ({CHECKED_CHANGES})"""
oracle(
    "create_projects",
    f"""SELECT id, name, git_url, git_raw_url, epoch_us(created_at) AS created_at_us FROM projects
        UNION ALL
        SELECT (SELECT MAX(id) FROM projects) + row_number() OVER (ORDER BY change_id), name, git_url, git_raw_url, epoch_us(TIMESTAMP '2024-02-01 08:30:00')
        FROM ({CREATED}) WHERE error_code IS NULL""",
    "projects",
)
oracle(
    "create_projects_outcomes",
    f"""SELECT change_id, error_code,
              CASE error_code WHEN '409-name-already-exists' THEN 'A project named ''' || name || ''' already exists.'
                   WHEN '400-name-required' THEN 'The ''name'' field is required and must not be empty.'
                   WHEN '400-name-field-too-long' THEN 'The ''name'' field must be at most 200 characters long.'
                   WHEN '400-git-url-empty' THEN 'The ''git_url'' field must not be empty when provided.'
                   WHEN '400-git-raw-url-too-long' THEN 'The ''git_raw_url'' field must be at most 2000 characters long.' END AS error_message
        FROM ({CREATED})""",
    "projects",
)
REPLACED = f"""
    SELECT c.*, CASE WHEN early IS NOT NULL THEN early
                     WHEN id <> first_value(id) OVER (PARTITION BY name, early IS NULL ORDER BY change_id) THEN '409-name-already-exists' END AS error_code
    FROM (SELECT *, CASE WHEN rule IS NOT NULL THEN rule
                         WHEN EXISTS (SELECT 1 FROM projects p WHERE p.name = x.name AND p.id <> x.id) THEN '409-name-already-exists'
                         WHEN id NOT IN (SELECT id FROM projects) THEN '404-project-not-found' END AS early
          FROM ({CHECKED_CHANGES}) x) c"""
oracle(
    "replace_projects",
    f""", last_change AS (
            SELECT id, arg_max(struct_pack(name := name, git_url := git_url, git_raw_url := git_raw_url), change_id) AS n
            FROM ({REPLACED}) WHERE error_code IS NULL GROUP BY id)
        SELECT p.id, CASE WHEN n IS NULL THEN p.name ELSE n.name END AS name, CASE WHEN n IS NULL THEN p.git_url ELSE n.git_url END AS git_url,
               CASE WHEN n IS NULL THEN p.git_raw_url ELSE n.git_raw_url END AS git_raw_url, epoch_us(created_at) AS created_at_us
        FROM projects p LEFT JOIN last_change l ON l.id = p.id""",
    "projects",
)
oracle("replace_projects_outcomes", f"SELECT change_id, id, error_code FROM ({REPLACED})", "projects")
DELETED = """
    SELECT project_id, CASE WHEN project_id = 25 OR project_id IN (SELECT project_id FROM docs WHERE kind = 'es' AND type_name = 'PoorText') THEN '409-has-indexed-code-documents'
                            WHEN project_id IN (SELECT project_id FROM feedback) THEN '409-has-feedback'
                            WHEN project_id NOT IN (SELECT id FROM projects) THEN '404-project-not-found' END AS error_code
    FROM (SELECT DISTINCT CAST(c_nationkey + 1 + c_custkey % 4 AS BIGINT) AS project_id FROM customer)"""
oracle(
    "delete_projects",
    f"SELECT id, name FROM projects WHERE id NOT IN (SELECT project_id FROM ({DELETED}) WHERE error_code IS NULL)",
    "projects", "docs", "feedback",
)
for stored, changed in (("new", "create"), ("replaced", "replace")):
    ORACLES[f"store_{stored}_projects"] = ORACLES[f"{changed}_projects"]
ORACLES["store_without_deleted_projects"] = ORACLES["delete_projects"]
oracle("delete_projects_outcomes", DELETED, "projects", "docs", "feedback")
WINDOWS = """
    SELECT user_id, CASE WHEN user_id % 5 = 0 THEN last WHEN user_id % 5 <> 1 THEN early END AS start_date,
           CASE WHEN user_id % 5 = 0 THEN first WHEN user_id % 5 <> 2 THEN last END AS end_date
    FROM (SELECT user_id, MIN(ts) AS first, MAX(ts) AS last, MIN(ts) - to_days(CAST(user_id * 4 AS INTEGER)) AS early FROM events GROUP BY user_id)"""


def window(first: str, last: str, inverted: str) -> str:
    return f"""
        SELECT user_id, epoch_us(s) AS window_start_us, epoch_us(e) AS window_end_us,
               CASE WHEN {inverted} THEN '400-invalid-date-range' WHEN epoch_us(e) - epoch_us(s) > 366 * 86400000000 THEN '400-window-too-large' END AS error_code
        FROM (SELECT *, {first} AS s, {last} AS e FROM ({WINDOWS}))"""


NOW = "TIMESTAMP '2024-02-01 08:30:00'"
LAST = f"COALESCE(end_date, start_date + to_days(30), {NOW})"
oracle("stats_window", window(f"COALESCE(start_date, {LAST} - to_days(30))", LAST, "start_date > end_date"))
oracle("export_window", window("COALESCE(start_date, TIMESTAMP '2024-02-01 00:00:00')", f"COALESCE(end_date, {NOW})", "s > e"))
oracle(
    "validate_project_filter",
    """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '400-name-empty' WHEN doc_id % 9 IN (1, 2) THEN NULL WHEN text = '' THEN '400-name-empty'
              WHEN length(text) > 200 THEN '400-name-too-long' END AS error_code
       FROM documents""",
)
oracle(
    "window_project_filter",
    """SELECT user_id, project_id, CASE WHEN missing THEN '404-project-not-found' END AS error_code,
              CASE WHEN missing THEN 'No project exists with id ' || project_id || '.' END AS error_message
       FROM (SELECT DISTINCT user_id, user_id % 30 + 1 AS project_id, user_id % 30 + 1 NOT IN (SELECT id FROM projects) AS missing FROM events)""",
    "projects",
)
oracle(
    "failure_status",
    f"""SELECT submission_id, code, CASE WHEN code LIKE '404-%' THEN 404 ELSE 400 END AS status
        FROM (SELECT submission_id, COALESCE({FEEDBACK_ERROR}, question) AS code FROM submissions)""",
    "submissions", "projects",
)

# --- streams

TAKEN_IN = f"""
    SELECT id, project_id, question, useful, username, created_at, CAST(NULL AS VARCHAR) AS error_code FROM feedback
    UNION ALL
    SELECT CASE WHEN error_code IS NULL THEN (SELECT MAX(id) FROM feedback) + row_number() OVER (PARTITION BY error_code IS NULL ORDER BY submission_id)
                ELSE submission_id END, project_id, question, useful, username, created_at, error_code
    FROM (SELECT *, {FEEDBACK_ERROR} AS error_code FROM submissions)"""
oracle(
    "stream_feedback_intake",
    f"SELECT id, project_id, question, username, epoch_us(created_at) AS created_at_us, error_code FROM ({TAKEN_IN})",
    "submissions", "projects", "feedback",
)
oracle(
    "stream_feedback_repeats",
    f"SELECT id, project_id, question, username, epoch_us(created_at) AS created_at_us FROM ({TAKEN_IN}) WHERE error_code IS NULL",
    "submissions", "projects", "feedback",
)
ORACLES["weekly_feedback_stats_streamed"] = with_views("SELECT * FROM percented", "submissions", "percented").replace(
    "inside AS (\n        SELECT * FROM feedback", f"inside AS (\n        SELECT * FROM ({TAKEN_IN}) t"
).replace("WHERE created_at >= TIMESTAMP", "WHERE error_code IS NULL AND created_at >= TIMESTAMP")
oracle(
    "stream_weekly_counts",
    """SELECT CAST(date_trunc('week', created_at) AS DATE) AS week_start, project_id, COUNT(id) AS total_count,
              COUNT(*) FILTER (WHERE useful) AS useful_count, COUNT(*) FILTER (WHERE NOT useful) AS not_useful_count
       FROM feedback GROUP BY ALL""",
    "feedback",
)

# --- embedding, reranking, end to end


def embedding(rows: str, key: str, text: str, dimensions: int, normalized: bool) -> str:
    """(key, dim, x): mean of the sign vectors of a text's words, as single-precision numbers.

    A word's signs are the leading bits of its MD5; equal words are counted, not repeated.
    """
    unit = "pooled / CASE WHEN norm > 0 THEN norm ELSE 1 END" if normalized else "pooled"
    return rf"""
        SELECT {key}, CAST(dim AS INTEGER) AS dim, CAST({unit} AS FLOAT) AS x FROM (
            SELECT *, sqrt(SUM(pooled * pooled) OVER (PARTITION BY {key})) AS norm FROM (
                SELECT r.{key}, dim, COALESCE(SUM(n * (2 * ((bits >> CAST(63 - dim AS INTEGER)) & 1)::INTEGER - 1)) / SUM(n), 0)::DOUBLE AS pooled
                FROM ({rows}) r CROSS JOIN range({dimensions}) t(dim)
                LEFT JOIN (SELECT {key}, word, COUNT(*) AS n, CAST('0x' || substr(md5(word), 1, 16) AS UBIGINT) AS bits
                           FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS word FROM ({rows}))
                           GROUP BY ALL) w ON w.{key} = r.{key}
                GROUP BY r.{key}, dim))"""


oracle(
    "embed_changed",
    f"""SELECT doc_id, coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents WHERE lang = 'en') AS reused, dim, round(x::DOUBLE, 9) AS x
        FROM ({embedding('SELECT doc_id, text FROM documents', 'doc_id', 'text', 64, True)}) JOIN documents USING (doc_id)""",
)
oracle("embed_table", f"SELECT doc_id, dim, round(x::DOUBLE, 9) AS x FROM ({embedding('SELECT doc_id, text FROM documents', 'doc_id', 'text', 64, True)})")
oracle(
    "resolve_embedder",
    f"""SELECT query_id, dim, round(x::DOUBLE, 9) AS x, 'Local' AS embedding_provider, CAST(16 AS INTEGER) AS embedding_dimensions
        FROM ({embedding('SELECT query_id, question FROM questions', 'query_id', 'question', 16, False)})""",
    "questions",
)
oracle(
    "hashed_tokens",
    r"""SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)""",
)


def words(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))"


GRADED = f"""
    SELECT *, CASE WHEN len(q) > 0 THEN CAST(floor(len(list_intersect(q, t)) * 10 / len(q)) AS INTEGER) ELSE 0 END AS grade
    FROM (SELECT *, {words("question")} AS q, {words("embedding_text")} AS t FROM ({CANDIDATES}))"""
LEXICAL = f"""SELECT *, least(greatest(grade, 0), 10) / 10.0::DOUBLE AS rerank_score FROM ({GRADED})"""
oracle(
    "resolve_reranker",
    f"""SELECT query_id, id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank) AS INTEGER) AS rank
        FROM ({LEXICAL})""",
    "ranked", "docs",
)
oracle(
    "rerank_none",
    f"SELECT query_id, id, vector_rank, vector_rank AS rank, CAST(NULL AS DOUBLE) AS rerank_score FROM ({CANDIDATES})",
    "ranked", "docs",
)
oracle(
    "rerank_pointwise",
    f"""SELECT query_id, id, vector_rank, rerank_score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY COALESCE(rerank_score, 0) DESC, vector_rank) AS INTEGER) AS rerank_order
        FROM (SELECT * REPLACE (CASE WHEN length(embedding_text) % 3 <> 0 THEN rerank_score END AS rerank_score) FROM ({LEXICAL}))""",
    "ranked", "docs",
)
oracle(
    "rerank_listwise",
    f"""SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY share DESC, vector_rank) AS INTEGER) AS rerank_order, round(share, 9) AS rerank_score
        FROM (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS share FROM ({GRADED}))""",
    "ranked", "docs",
)
oracle(
    "lexical_grade",
    f"""SELECT doc_id, turn, CASE WHEN len(q) > 0 THEN CAST(floor(len(list_intersect(q, t)) * 10 / len(q)) AS INTEGER) ELSE 0 END AS grade
        FROM (SELECT doc_id, turn, {words("c.text")} AS q, {words("d.text")} AS t FROM documents d LEFT JOIN conversations c ON d.doc_id = c.conv_id)""",
)
oracle(
    "rerank_batch",
    f"""SELECT query_id, rank, id, rerank_score, round(sim, 10) AS similarity FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank) AS INTEGER) AS rank FROM ({LEXICAL}))
        WHERE rank <= "limit" """,
    "ranked", "docs",
)
oracle(
    "code_search",
    f""", asked AS ({CHECKED_QUESTIONS}),
        accepted AS (SELECT * FROM asked WHERE error_code IS NULL),
        question_vectors AS (SELECT query_id, list(x::DOUBLE ORDER BY dim) AS qv FROM ({embedding('SELECT query_id, question FROM accepted', 'query_id', 'question', 64, True)}) GROUP BY query_id),
        document_vectors AS (SELECT id, list(x::DOUBLE ORDER BY dim) AS dv FROM ({embedding('SELECT id, embedding_text FROM text_space', 'id', 'embedding_text', 64, True)}) GROUP BY id),
        scored AS (
            SELECT a.query_id, a."limit", a.question, d.*, list_cosine_similarity(dv, qv) AS sim
            FROM accepted a JOIN question_vectors USING (query_id) JOIN text_space d ON d.project_id = a.project_id JOIN document_vectors v ON v.id = d.id
            WHERE (min_similarity IS NULL OR list_cosine_similarity(dv, qv) >= min_similarity)
              AND (NOT by_kind OR kind = kind_value) AND (NOT by_namespace OR COALESCE(namespace ILIKE 'src1%', FALSE))),
        pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS vector_rank FROM scored)
                 WHERE vector_rank <= least(greatest(COALESCE("limit", 10), 25), 200)),
        graded AS (SELECT *, CASE WHEN len(q) > 0 THEN floor(len(list_intersect(q, t)) * 10 / len(q)) / 10.0::DOUBLE ELSE 0 END AS rerank_score
                   FROM (SELECT *, {words("question")} AS q, {words("embedding_text")} AS t FROM pool))
        SELECT query_id, rank, g.id, source_file, kind, type_name, member, md5(embedding_text) AS embedding_text, round(sim, 10) AS similarity,
               git_url, git_raw_url || '/' || source_file AS git_raw_url, rerank_score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank) AS INTEGER) AS rank FROM graded) g
        JOIN projects p ON p.id = g.project_id WHERE rank <= COALESCE("limit", 10)""",
    "questions", "projects", "text_space",
)
oracle(
    "code_search_rejected",
    f"SELECT query_id, error_code, {SEARCH_MESSAGE} AS error_message FROM ({CHECKED_QUESTIONS}) WHERE error_code IS NOT NULL",
    "questions", "projects",
)

"""Project lookup, maintenance, constraint checks and validation rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import rules, scalars
from sparkseek.operators import constraints, projects, validate
from sparkseek.plans.code_search import complete_requests
from sparkseek.sources import tables
from tests.conftest import at, tuples

PROJECT = "id long, name string, git_url string, git_raw_url string, created_at timestamp"
NOW = at("2026-03-15T10:30")


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, "shopping-cart-service", "u1", "r1", at("2020-01-01")), (2, "billing", None, None, at("2020-01-02")), (5, "a_b", "u5", None, at("2020-01-03"))], PROJECT
    )


def changes(spark, *rows):
    """(name, git_url, git_raw_url, id) with trailing parts optional."""
    full = [(n + 1, *(list(r) + [None] * 4)[:4]) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, "change_id long, name string, git_url string, git_raw_url string, id long")


def codes(maintenance, key="change_id"):
    return {r[key]: r["error_code"] for r in maintenance.outcomes.collect()}


def test_list_projects(table):
    assert [r["id"] for r in projects.list_projects(table, "SHOPPING-CART").collect()] == [1]
    assert [r["id"] for r in projects.list_projects(table).collect()] == [5, 2, 1]
    assert projects.list_projects(table, "*").count() == 0
    assert [r["id"] for r in projects.list_projects(table, "a_b").collect()] == [5]
    assert [r["id"] for r in projects.list_projects(table, "L_I%g").collect()] == [2]


def test_lookups(spark, table):
    ids = spark.createDataFrame([(1,), (1,), (9,)], "project_id long")
    assert sorted(tuples(projects.projects_exist(ids, table))) == [(1, True), (1, True), (9, False)]
    assert [r["name"] for r in projects.project_by_id(table, ids).collect()] == ["shopping-cart-service"]
    rows = spark.createDataFrame([(2,)] * 50, "project_id long")
    assert {r["id"]: r["has_documents"] for r in projects.has_documents(table, rows).collect()} == {1: False, 2: True, 5: False}
    assert {r["id"]: r["has_feedback"] for r in projects.has_feedback(table, rows).collect()} == {1: False, 2: True, 5: False}


def test_name_exists(spark, table):
    names = spark.createDataFrame([("billing", None), ("billing", 2), ("billing", 1), ("Billing", None)], "name string, excluding long")
    assert [r["exists"] for r in projects.name_exists(names, table).orderBy("name", "excluding").collect()] == [False, True, True, False]


def test_create(spark, table):
    done = projects.create_projects(
        table,
        changes(spark, ("new", "u", "r"), ("billing",), ("new",), ("Billing",), (" ",), ("x" * 201,), ("n", " "), ("n", "u" * 2001), ("n", None, ""), ("n", None, "r" * 2001), ("n",)).drop("id"),
        NOW,
    )
    assert codes(done) == {
        1: None, 2: "409-name-already-exists", 3: "409-name-already-exists", 4: None, 5: "400-name-required", 6: "400-name-field-too-long",
        7: "400-git-url-empty", 8: "400-git-url-too-long", 9: "400-git-raw-url-empty", 10: "400-git-raw-url-too-long", 11: None,
    }
    added = done.projects.filter("id > 5").orderBy("id").collect()
    assert [(r["id"], r["name"], r["git_url"], r["created_at"]) for r in added] == [(6, "new", "u", NOW), (7, "Billing", None, NOW), (8, "n", None, NOW)]
    assert done.projects.count() == 6


def test_create_with_one_name_asked_for_by_most_rows(spark, table):
    many = spark.range(1, 2001).select(
        F.col("id").alias("change_id"), F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), "id")).alias("name"),
        F.lit(None).cast("string").alias("git_url"), F.lit(None).cast("string").alias("git_raw_url"),
    )
    done = projects.create_projects(table, many, NOW, rows_per_range=100)
    assert done.projects.count() == 3 + 1 + 666
    assert done.projects.filter("name = 'hot'").first()["id"] == 6
    ids = [r["id"] for r in done.projects.filter("id > 5").orderBy("id").collect()]
    assert ids == list(range(6, 6 + 667))


def test_replace(spark, table):
    done = projects.replace_projects(
        table, changes(spark, ("renamed", "u", None, 1), ("billing", None, None, 2), ("billing", None, None, 5), ("free", None, None, 9), ("", None, None, 1))
    )
    assert codes(done) == {1: None, 2: None, 3: "409-name-already-exists", 4: "404-project-not-found", 5: "400-name-required"}
    after = {r["id"]: r for r in done.projects.collect()}
    assert (after[1]["name"], after[1]["git_url"], after[1]["git_raw_url"], after[1]["created_at"]) == ("renamed", "u", None, at("2020-01-01"))
    assert after[2]["name"] == "billing" and after[5]["git_url"] == "u5" and len(after) == 3


def test_replace_within_one_batch(spark, table):
    done = projects.replace_projects(table, changes(spark, ("x", "1", None, 1), ("x", "2", None, 2), ("y", "3", None, 1), ("x", "4", None, 1)))
    assert codes(done) == {1: None, 2: "409-name-already-exists", 3: None, 4: None}
    assert {r["id"]: (r["name"], r["git_url"]) for r in done.projects.collect()} == {1: ("x", "4"), 2: ("billing", None), 5: ("a_b", "u5")}
    assert sorted(tuples(projects.replace_projects(done.projects, changes(spark, ("x", "4", None, 1))).projects)) == sorted(tuples(done.projects))


def test_delete(spark, table):
    docs = spark.createDataFrame([(1,), (1,)], "project_id long")
    feedback = spark.createDataFrame([(1,), (2,)], "project_id long")
    ids = spark.createDataFrame([(1,), (2,), (5,), (9,), (5,)], "project_id long")
    done = projects.delete_projects(table, ids, docs, feedback)
    assert codes(done, "project_id") == {1: "409-has-indexed-code-documents", 2: "409-has-feedback", 5: None, 9: "404-project-not-found"}
    assert sorted(r["id"] for r in done.projects.collect()) == [1, 2]


def test_constraints(spark, table):
    docs = spark.createDataFrame(
        [(1, "d1", 1, 1, "k"), (1, "d2", 1, 1, None), (3, "d2", 1, 77, "k"), (4, "d2", 2, 77, "k")],
        "id long, document_id string, embedding_model_id long, project_id long, kind string",
    )
    models = spark.createDataFrame([(1, "P", "m", 3)], "id long, provider string, model string, dimensions int")
    found = constraints.check_constraints({"projects": table, "embedding_models": models, "code_documents": docs})
    assert sorted(tuples(found)) == [
        ("code_documents", "foreign key (embedding_model_id)", "2", 1),
        ("code_documents", "foreign key (project_id)", "77", 2),
        ("code_documents", "not null", "kind", 1),
        ("code_documents", "primary key (id)", "1", 2),
        ("code_documents", "unique (document_id, embedding_model_id)", "d2|1", 2),
    ]


SEARCHES = [
    (dict(question=None), "400-question-required"),
    (dict(question=" \n"), "400-question-required"),
    (dict(question="x" * 1000), None),
    (dict(question="x" * 1001, limit=0), "400-question-too-long"),
    (dict(question="\U0001f600" * 501), "400-question-too-long"),
    (dict(limit=0), "400-limit-out-of-range"),
    (dict(limit=51), "400-limit-out-of-range"),
    (dict(limit=50, min_similarity=1.0), None),
    (dict(min_similarity=-0.01), "400-min-similarity-out-of-range"),
    (dict(min_similarity=1.01), "400-min-similarity-out-of-range"),
    (dict(kind_operator="equals"), "400-kind-filter-value-required"),
    (dict(kind_value="x" * 300), None),
    (dict(kind_operator="equals", kind_value="x" * 201), "400-kind-filter-value-too-long"),
    (dict(namespace_operator="equals", namespace_value=" "), "400-namespace-filter-value-required"),
    (dict(namespace_operator="equals", namespace_value="x" * 201), "400-namespace-filter-value-too-long"),
    (dict(type_name_operator="equals"), "400-type-name-filter-value-required"),
    (dict(type_name_operator="equals", type_name_value="x" * 201, project_id=9), "400-type-name-filter-value-too-long"),
    (dict(project_id=9), "404-project-not-found"),
    (dict(project_id=None), "404-project-not-found"),
]


def test_search_rules(spark, table):
    columns = "query_id long, project_id long, question string, limit int, min_similarity double, kind_operator string, kind_value string, namespace_operator string, namespace_value string, type_name_operator string, type_name_value string"
    names = [c.split()[0] for c in columns.split(", ")]
    data = [{"query_id": i, "project_id": 1, "question": "q", **case} for i, (case, _) in enumerate(SEARCHES)]
    requests = complete_requests(spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], columns))
    got = {r["query_id"]: r["error_code"] for r in validate.validate_search_requests(requests, table).collect()}
    assert [got[i] for i in range(len(SEARCHES))] == [code for _, code in SEARCHES]


SUBMISSIONS = [
    (dict(question=" "), "400-question-required"),
    (dict(question="x" * 1001), "400-question-too-long"),
    (dict(useful=None), "400-useful-required"),
    (dict(useful=None, similarities=None), "400-useful-required"),
    (dict(similarities=None), "400-similarities-required"),
    (dict(similarities=[0.1] * 51), "400-too-many-similarities"),
    (dict(similarities=[]), None),
    (dict(username=""), "400-user-required"),
    (dict(username="u" * 201), "400-user-too-long"),
    (dict(reason="r" * 1001), "400-reason-too-long"),
    (dict(reason=""), None),
    (dict(project_id=9, username=None), "400-user-required"),
    (dict(project_id=9), "404-project-not-found"),
]


def test_feedback_rules(spark, table):
    columns = "submission_id long, project_id long, question string, useful boolean, similarities array<double>, reason string, username string"
    names = [c.split()[0] for c in columns.split(", ")]
    data = [{"submission_id": i, "project_id": 1, "question": "q", "useful": False, "similarities": [0.1], "reason": None, "username": "u", **case} for i, (case, _) in enumerate(SUBMISSIONS)]
    checked = validate.validate_feedback(spark.createDataFrame([tuple(d[n] for n in names) for d in data], columns), table)
    got = {r["submission_id"]: r["error_code"] for r in checked.collect()}
    assert [got[i] for i in range(len(SUBMISSIONS))] == [code for _, code in SUBMISSIONS]
    messages = {r["error_code"]: r["error_message"] for r in validate.with_messages(checked, "project_id").collect()}
    assert messages["404-project-not-found"] == "No project exists with id 9." and messages[None] is None


def test_every_failure_has_a_status(spark):
    rows = spark.createDataFrame([(c,) for c in [*rules.FAILURES, "404", "x-1", "", "-404-x", "409"]], "c string")
    got = {r[0]: r[1] for r in rows.select("c", scalars.failure_status(F.col("c"))).collect()}
    assert all(got[c] == int(c[:3]) for c in rules.FAILURES)
    assert (got["404"], got["x-1"], got[""], got["-404-x"], got["409"]) == (404, 400, 400, 400, 409)


def test_project_name_filter():
    assert validate.validate_project_filter(None) is None and validate.validate_project_filter("  ") == "  "
    with pytest.raises(rules.RuleViolation, match="400-name-empty"):
        validate.validate_project_filter("")
    with pytest.raises(rules.RuleViolation, match="400-name-too-long"):
        validate.validate_project_filter("x" * 201)


@pytest.mark.parametrize("text,value", [("7", 7), (" 7 ", 7), ("+7", 7), ("0", None), ("-1", None), ("7.0", None), ("x", None), ("", None), (None, None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None)])
def test_positive_id(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.positive_id(F.col("t"))).first()[0] == value


def test_changes_rewrite_only_the_folders_they_touch(spark, tmp_path):
    made = F.lit(at("2024-01-01")).cast("timestamp").alias("created_at")
    none = [F.lit(None).cast("string").alias(c) for c in ("git_url", "git_raw_url")]
    first = spark.range(1, 61).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), *none, made)
    path = str(tmp_path / "projects")
    tables.write_projects(first, path, folders=16)

    def files():
        return {str(f) for f in (tmp_path / "projects").glob("id_folder=*/*.parquet")}

    def store(after, work):
        return tables.store_project_changes(tables.read_stored_projects(spark, path), after, path, str(tmp_path / work), folders=16)

    now, kept = tables.read_stored_projects(spark, path), files()
    assert store(now.limit(100), "none") == 0 and files() == kept
    renamed = now.withColumn("name", F.when(F.col("id") == 7, "other").otherwise(F.col("name")))
    assert store(renamed.filter("id <> 9"), "some") <= 2
    assert len(kept - files()) <= 2 and len(kept & files()) >= len(kept) - 2
    names = {r["id"]: r["name"] for r in tables.read_stored_projects(spark, path).collect()}
    assert names == {i: "other" if i == 7 else f"p{i}" for i in range(1, 61) if i != 9}
    # Every project of a folder goes, and one comes back.
    gone = tables.read_stored_projects(spark, path).filter("id = 7")
    store(gone, "most")
    assert [r["id"] for r in tables.read_stored_projects(spark, path).collect()] == [7]
    assert store(tables.read_stored_projects(spark, path).unionByName(first.filter("id = 30")), "back") == 1
    assert sorted(r["id"] for r in tables.read_stored_projects(spark, path).collect()) == [7, 30]

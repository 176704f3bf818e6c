"""Patterns narrowed by grams, keys kept by folder, and the export in parts, against plain versions."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import filters
from sparkseek.operators import constraints, feedback, patterns
from sparkseek.sources import sinks
from tests.conftest import tuples


def test_every_pattern_against_every_text(spark):
    rng = random.Random(2)
    letters = ["a", "b", "É", "é", "%", "_", "\\", " ", "ab", "中", "Ab", "\n"]
    texts = [None, "", "a", "%", "\\", "long " * 400 + "Needle", *["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(150)]]
    wild = [*letters, "*", "*", "%", "_", "\\%", "\\_", "\\*", "\\\\", "\\a"]
    tried = [None, "", "*", "%%", "_", "*needle", "NEEDL_", "*edle*", *["".join(rng.choice(wild) for _ in range(rng.randrange(8))) for _ in range(150)]]
    values = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:30])], "id long, value string")
    table = spark.createDataFrame(list(enumerate(tried)), "pattern_id long, pattern string")
    expected = values.crossJoin(table).filter(F.ilike("value", filters.wildcard_column(F.col("pattern")))).select("pattern_id", "id")
    assert sorted(tuples(patterns.match_patterns(values, table))) == sorted(tuples(expected))
    assert patterns.match_patterns(values.limit(0), table).count() == 0 == patterns.match_patterns(values, table.limit(0)).count()


@pytest.mark.parametrize(
    ("pattern", "kept"), [("%", [0]), ("", [0]), ("a%", [1 + 97]), ("a_b", [1 + 97, 1 + 98]), ("ab%c", [257 + 97 * 256 + 98]), ("\\%\\_x", [65793 + (37 << 16) + (95 << 8) + 120])]
)
def test_grams_of_a_pattern(pattern, kept):
    assert patterns.pattern_grams(pattern.encode()) == kept


def test_a_pattern_that_repeats_is_tried_once(spark):
    """A text meets the list of its candidates: no row of a text and a pattern goes through the LIKE."""
    values = spark.createDataFrame([(i, f"Text {i} holds a needle") for i in range(20)], "id long, value string")
    table = spark.createDataFrame([(i, ["*", "T*", "*need_e*", "none%"][i % 4]) for i in range(400)], "pattern_id long, pattern string")
    found = patterns.match_patterns(values, table)
    assert " LIKE " not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuples(found)) == sorted((p, i) for p in range(400) if p % 4 < 3 for i in range(20))


@pytest.mark.parametrize(
    ("pattern", "held", "not_held"),
    [("%", ["", "\n"], []), ("a_c%", ["abc", "a\ncd"], ["ac", "xabc"]), ("%ab%ba%", ["abba", "xabxbax"], ["aba"]), ("\\%%\\_", ["%_", "%a_"], ["%"]), ("a%\n", ["a\n"], ["a"]), ("%中_", ["x中é"], ["中"])],
)
def test_matcher_is_like(pattern, held, not_held):
    assert [t for t in held + not_held if patterns.matcher(pattern)(t)] == held


PROJECT = "id long, name string"
DOCUMENT = "id long, document_id string, embedding_model_id long, project_id long, kind string"


def stored_and_new(spark):
    projects = spark.createDataFrame([(1, "a"), (2, "b")], PROJECT)
    models = spark.createDataFrame([(1, "p", "m", 2)], "id long, provider string, model string, dimensions int")
    old = spark.createDataFrame([(i, f"d{i}", 1, i % 2 + 1, "k") for i in range(50)], DOCUMENT)
    new = spark.createDataFrame(
        [(50, "d50", 1, 1, "k"), (7, "d7", 1, 2, "k"), (51, "d51", 1, 9, None), (52, "d52", 3, None, "k"), (53, "d52", 3, 1, "k"), (None, None, None, 4, "k")], DOCUMENT
    )
    return projects, models, old, new


def test_new_rows_break_what_a_full_check_finds(spark, tmp_path):
    projects, models, old, new = stored_and_new(spark)
    more = spark.createDataFrame([(3, "c"), (2, "z")], PROJECT)
    path = str(tmp_path / "keys")
    constraints.store_keys({"projects": projects, "embedding_models": models}, path)
    constraints.store_keys({"code_documents": old}, path)
    shown = ("table", "constraint", "key", "violations")
    for batch in ({"code_documents": new}, {"projects": more}, {"projects": more, "code_documents": new.withColumn("project_id", F.lit(3))}):
        found = sorted(tuples(constraints.check_new_rows(batch, path).select(*shown)), key=str)
        stored = {"projects": projects, "embedding_models": models, "code_documents": old}
        every = {name: rows.unionByName(batch[name]) if name in batch else rows for name, rows in stored.items()}
        assert found == sorted(tuples(constraints.check_constraints(every).select(*shown)), key=str)
    # A checked batch joins the kept keys.
    constraints.store_keys({"projects": more.filter("id = 3")}, path)

    assert sorted(r["key"] for r in constraints.check_new_rows({"projects": more.filter("id = 3")}, path).collect()) == ["3", "c"]


def test_only_the_folders_of_the_new_keys_are_read(spark, tmp_path):
    projects, models, old, new = stored_and_new(spark)
    path = str(tmp_path / "keys")
    constraints.store_keys({"projects": projects, "embedding_models": models, "code_documents": old}, path)
    asked = constraints._dealt(constraints._keys("code_documents", new.limit(1)), constraints.FOLDERS)
    plan = constraints._stored_keys(asked, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_folder" in plan or "PartitionFilters: [key_folder" in plan
    read = {r[0] for r in constraints._stored_keys(asked, path).select(constraints.FOLDER).distinct().collect()}
    assert read <= {r[0] for r in asked.select(constraints.FOLDER).collect()}
    assert len(read) < spark.read.parquet(path).select(constraints.FOLDER).distinct().count() / 4


ROWS = "id long, project_id long, project_name string, question string, useful boolean, similarities array<double>, reason string, username string, created_at timestamp"


@pytest.mark.parametrize("n", [0, 1, 200])
def test_parts_joined_by_the_manifest_are_the_one_file(spark, tmp_path, n):
    odd = ["plain", 'quo"ted', "a,b", " lead", "line\nbreak", "", None]
    rows = spark.createDataFrame(
        [(i, 1, "p", odd[i % 7], i % 2 == 0, [0.5, 1.0], odd[i % 5], "u", datetime(2024, 1, 1 + i % 9, i % 24, 0, i % 60)) for i in range(n)], ROWS
    ).repartition(3)
    ours, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    sinks.export_feedback_parts(rows, ours, feedback.text_columns())
    sinks.export_feedback_csv(feedback.export_text(rows.orderBy("created_at", "id").coalesce(1)), whole)
    manifest = sinks.read_manifest(spark, ours).orderBy("part").collect()
    joined = b"".join(next((tmp_path / "parts" / "parts" / f"part={r['part']}").glob("part-*.txt")).read_bytes() for r in manifest)
    (single,) = (tmp_path / "whole").glob("part-*.csv")
    assert joined == (single.read_bytes() or b"id,project_id,project_name,question,useful,similarities,reason,username,created_at\n")
    assert sum(r["rows"] for r in manifest) == n and [r["part"] for r in manifest] == list(range(len(manifest)))
    keys = [(r[f"{end}_created_at"], r[f"{end}_id"]) for r in manifest for end in ("first", "last") if n]
    assert keys == sorted(keys) and (n < 200 or len(manifest) > 1)

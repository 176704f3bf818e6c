"""Counts kept by folder, texts embedded once, repeated submissions, and rows without a key."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkseek.functions.vectors import matrix
from sparkseek.operators import embed, feedback, maintained, numbering, projects
from sparkseek.sources.tables import read_feedback, write_feedback
from sparkseek.streaming import feedback_intake as intake
from tests.conftest import tuples
from tests.test_streaming import SUBMISSION

START, END = datetime(2024, 1, 3, 9), datetime(2024, 1, 20, 15, 30)


def rows_of(spark, first, last):
    ids = spark.range(first, last)
    return ids.select(
        "id", (F.col("id") % 3 + 1).alias("project_id"), F.lit("q").alias("question"), (F.col("id") % 4 == 0).alias("useful"),
        F.array(F.lit(0.5)).alias("similarities"), F.lit(None).cast("string").alias("reason"), F.lit("u").alias("username"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7_001).alias("created_at"),
    )


@pytest.fixture
def named(spark):
    return spark.createDataFrame([(i, f"p{i}") for i in range(1, 5)], "id long, name string")


def same_report(spark, path, counts, named, **kept):
    stored = read_feedback(spark, path)
    for start, end in ((START, END), (datetime(2024, 1, 5), datetime(2024, 1, 5, 10)), (datetime(2024, 1, 2), datetime(2024, 1, 9, 23, 59, 59, 999999))):
        for project in (None, 2):
            ours = maintained.weekly_feedback_stats_maintained(stored, maintained.read_counts(spark, counts), named, start, end, project)
            theirs = feedback.weekly_feedback_stats(stored, named, start, end, project)
            assert sorted(tuples(ours.select(theirs.columns))) == sorted(tuples(theirs))


def test_only_changed_folders_are_counted_again(spark, tmp_path, named):
    path, counts = str(tmp_path / "feedback"), str(tmp_path / "counts")
    write_feedback(rows_of(spark, 0, 200), path, intake="first")
    days = len(list((tmp_path / "feedback").glob("created_on=*")))
    assert maintained.update_counts(spark, path, counts) == days
    same_report(spark, path, counts, named)
    assert maintained.update_counts(spark, path, counts) == 0

    # Late rows of two days, and the same again.
    write_feedback(rows_of(spark, 20, 30), path, intake="late")
    late = len(list((tmp_path / "feedback").glob("created_on=*/intake=late")))
    assert 0 < late < days and maintained.update_counts(spark, path, counts) == late
    same_report(spark, path, counts, named)
    write_feedback(rows_of(spark, 20, 30), path, "overwrite", "late")
    assert maintained.update_counts(spark, path, counts) == late
    same_report(spark, path, counts, named)

    # A folder whose files are gone.
    gone = next((tmp_path / "feedback").glob("created_on=*/intake=late"))
    for file in gone.iterdir():
        file.unlink()
    assert maintained.update_counts(spark, path, counts) == 1
    assert maintained.update_counts(spark, path, counts) == 0
    same_report(spark, path, counts, named)


def test_an_update_cut_short_is_made_good_by_the_next(spark, tmp_path, named):
    """The counts of some folders were replaced, those of others not yet."""
    path, counts = str(tmp_path / "feedback"), str(tmp_path / "counts")
    write_feedback(rows_of(spark, 0, 100), path, intake="first")
    maintained.update_counts(spark, path, counts)
    for folder in list((tmp_path / "counts").glob("created_on=*"))[:3]:
        for file in folder.glob("*/*"):
            file.unlink()
    assert maintained.update_counts(spark, path, counts) == 3
    same_report(spark, path, counts, named)


class Counting(embed.HashedTokens):
    """Counts the texts that it is given."""

    seen = None

    def open(self):
        run, seen = super().open(), self.seen

        def counted(batch):
            seen.add(len(batch))
            return run(batch)

        return counted


def test_each_different_text_is_embedded_once(spark):
    texts = ["one", "two", "three", None, "", "stored", "clash"]
    rows = spark.createDataFrame(
        [(i, texts[i % 7], "same" if texts[i % 7] in ("clash", "stored") else f"h{i % 7}") for i in range(70)], "id long, text string, embedding_text_hash string"
    )
    embedder = embed.HashedTokens(16)
    before = spark.createDataFrame([("stored", "same"), ("stored", "same"), ("one", "h0")], "text string, embedding_text_hash string")
    old = embed.embed_table(before, "text", embedder)
    other = old.withColumns({"embedding_model": F.when(F.col("text") == "one", "other").otherwise(F.col("embedding_model"))})
    counting = Counting(16)
    object.__setattr__(counting, "seen", spark.sparkContext.accumulator(0))
    done = embed.embed_changed(rows, "text", counting, other).collect()
    assert len(done) == 70
    # Null and "" have hashes of their own; "one" was stored for another model only.
    assert counting.seen.value == 6
    assert {r["text"] for r in done if r["reused"]} == {"stored"}
    expected = {r["id"]: r["embedding"] for r in embed.embed_table(rows, "text", embedder).collect()}
    assert {r["id"]: r["embedding"] for r in done} == expected
    assert matrix(embed.embed_changed(rows, "text", embedder, old.limit(0)).select("embedding").toArrow()["embedding"]).shape == (70, 16)


@pytest.mark.parametrize("within", [None, "7 days"])
def test_repeats_are_stored_once_across_batches_and_restarts(spark, tmp_path, within):
    named = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    table, rejected, checkpoint = (str(tmp_path / n) for n in ("table", "rejected", "checkpoint"))
    good = ("q", True, [0.5], None, "u", datetime(2024, 1, 5))
    sent = [
        [(1, 1, *good), (1, 1, *good), (2, 1, *good), (3, 9, *good), (None, 1, *good)],
        [(2, 1, *good), (3, 2, *good), (None, 1, *good)],  # 3 was rejected before, and comes again mended
        [(3, 2, *good), (1, 1, *good), (4, 3, *good)],
    ]
    for i, rows in enumerate(sent):
        spark.createDataFrame(rows, SUBMISSION).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(SUBMISSION).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        intake.stream_feedback_intake(stream, named, table, rejected, checkpoint, repeats=True, repeats_within=within).awaitTermination()
    stored = read_feedback(spark, table)
    assert sorted(r["id"] for r in stored.collect()) == list(range(1, 7))
    assert stored.groupBy("project_id").count().orderBy("project_id").collect() == [(1, 4), (2, 1), (3, 1)]
    assert spark.read.parquet(rejected).count() == 1


def test_rows_without_a_key_are_numbered_last(spark):
    rows = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "b")], "key long, x string")
    for ranges in (1_000_000, 1):
        numbered = sorted((r["id"], r["x"]) for r in numbering.number_rows(rows, "key", 10, rows_per_range=ranges).collect())
        assert [i for i, _ in numbered] == [11, 12, 13, 14, 15]
        assert [x for _, x in numbered[:2]] == ["c", "a"] and sorted(x for _, x in numbered[2:]) == ["b", "b", "d"]
        again = sorted((r["id"], r["x"]) for r in numbering.number_rows(rows.repartition(3), "key", 10, rows_per_range=ranges).collect())
        assert again == numbered
    assert numbering.number_rows(rows.filter("key is null"), "key", 0).count() == 3
    assert numbering.number_rows(rows.limit(0), "key", 0).count() == 0


def test_a_new_project_without_a_change_id_is_no_conflict(spark):
    table = spark.createDataFrame([(1, "old", None, None, datetime(2024, 1, 1))], "id long, name string, git_url string, git_raw_url string, created_at timestamp")
    new = spark.createDataFrame(
        [(1, "a", None, None), (None, "b", None, None), (None, "c", None, None), (2, "a", None, None), (None, "a", None, None), (None, "old", None, None)],
        "change_id long, name string, git_url string, git_raw_url string",
    )
    done = projects.create_projects(table, new, datetime(2024, 2, 1))
    assert sorted((r["id"], r["name"]) for r in done.projects.collect())[:2] == [(1, "old"), (2, "a")]
    assert sorted(r["name"] for r in done.projects.collect()) == ["a", "b", "c", "old"]
    assert sorted((r["name"], r["error_code"] or "") for r in done.outcomes.collect()) == [
        ("a", ""), ("a", "409-name-already-exists"), ("a", "409-name-already-exists"), ("b", ""), ("c", ""), ("old", "409-name-already-exists"),
    ]

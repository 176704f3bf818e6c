"""The feedback stream: same rows as the batch path, no matter how they arrive."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import feedback, validate
from sparkseek.sources.tables import read_feedback, write_feedback
from sparkseek.streaming import feedback_intake as intake
from tests.conftest import at, tuples

SUBMISSION = (
    "submission_id long, project_id long, question string, useful boolean, similarities array<double>, reason string, username string, created_at timestamp"
)


@pytest.fixture
def arrived(spark, tmp_path):
    """Three files of submissions, some of them invalid."""
    rows = spark.range(90).select(
        F.col("id").alias("submission_id"), (F.col("id") % 4 + 1).alias("project_id"), F.when(F.col("id") % 10 != 3, "q").alias("question"),
        (F.col("id") % 2 == 0).alias("useful"), F.array(F.lit(0.5)).alias("similarities"), F.lit(None).cast("string").alias("reason"),
        F.lit("u").alias("username"), (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 40_000)).alias("created_at"),
    )
    for part in range(3):
        rows.filter(F.col("submission_id").between(part * 30, part * 30 + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_intake(spark, arrived, tmp_path):
    projects = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    accepted, rejected, checkpoint = (str(tmp_path / n) for n in ("accepted", "rejected", "checkpoint"))
    stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 1).parquet(arrived)
    intake.stream_feedback_intake(stream, projects, accepted, rejected, checkpoint).awaitTermination()

    checked = validate.validate_feedback(spark.read.parquet(arrived), projects)
    good, bad = validate.split(checked)
    assert spark.read.parquet(accepted).select("intake").distinct().count() == 3
    stored = read_feedback(spark, accepted)
    ids = [r["id"] for r in stored.orderBy("id").collect()]
    assert ids == list(range(1, good.count() + 1))
    assert sorted(tuples(stored.select("project_id", "useful", "created_at"))) == sorted(tuples(good.select("project_id", "useful", "created_at")))
    refused = spark.read.parquet(rejected)
    assert sorted(tuples(refused.select("submission_id", "error_code"))) == sorted(tuples(bad.select("submission_id", "error_code")))

    # Started again on the same checkpoint, nothing is stored twice.
    intake.stream_feedback_intake(stream, projects, accepted, rejected, checkpoint).awaitTermination()
    assert read_feedback(spark, accepted).count() == good.count()


def test_rows_without_a_time_get_one(spark, arrived, tmp_path):
    projects = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    accepted, rejected, checkpoint = (str(tmp_path / n) for n in ("accepted", "rejected", "checkpoint"))
    stream = spark.readStream.schema(SUBMISSION).parquet(arrived).drop("created_at")
    intake.stream_feedback_intake(stream, projects, accepted, rejected, checkpoint).awaitTermination()
    times = read_feedback(spark, accepted).select("created_at").distinct().collect()
    assert len(times) == 1 and times[0][0].year >= 2024


def test_replayed_batch_writes_the_same_rows(spark, arrived, tmp_path):
    """The commit of the last batch is lost after its rows were written."""
    projects = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    accepted, rejected, checkpoint = (str(tmp_path / n) for n in ("accepted", "rejected", "checkpoint"))
    stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 1).parquet(arrived)

    def run():
        intake.stream_feedback_intake(stream, projects, accepted, rejected, checkpoint).awaitTermination()
        return sorted((r["id"], r["project_id"], r["created_at"], r["intake"]) for r in spark.read.parquet(accepted).collect())

    before = run()
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert run() == before


def test_ids_go_on_after_stored_rows(spark, arrived, tmp_path):
    """One table for batch and stream; the reports see both."""
    projects = spark.createDataFrame([(i, f"p{i}") for i in range(1, 5)], "id long, name string")
    table, rejected, checkpoint = (str(tmp_path / n) for n in ("table", "rejected", "checkpoint"))
    submissions = spark.read.parquet(arrived)
    accepted, _ = validate.split(validate.validate_feedback(submissions, projects))
    first = feedback.stored_rows(accepted.filter("submission_id < 20"), None, 100)
    write_feedback(first, table)
    stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 1).parquet(arrived)
    intake.stream_feedback_intake(stream, projects, table, rejected, checkpoint).awaitTermination()
    stored = read_feedback(spark, table)
    n, m = first.count(), accepted.count()
    assert sorted(r["id"] for r in stored.collect()) == list(range(101, 101 + n + m))
    stats = feedback.weekly_feedback_stats(stored, projects, at("2000-01-01"), at("2100-01-01"))
    assert stats.agg(F.sum("total_count")).first()[0] == n + m


def test_a_given_start(spark, arrived, tmp_path):
    projects = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    table, rejected, checkpoint = (str(tmp_path / n) for n in ("table", "rejected", "checkpoint"))
    stream = spark.readStream.schema(SUBMISSION).parquet(arrived)
    for start in (5000, 1):  # kept from the first run
        intake.stream_feedback_intake(stream, projects, table, rejected, checkpoint, start_after=start).awaitTermination()
    assert read_feedback(spark, table).agg(F.min("id")).first()[0] == 5001


@pytest.mark.parametrize("compact_every", [2, 100])
def test_weekly_counts_in_any_order(spark, arrived, tmp_path, compact_every):
    """Files in reverse order of time, one a batch: nothing is too late to count."""
    rows = spark.read.parquet(arrived).withColumnRenamed("submission_id", "id")
    source, path = str(tmp_path / "reversed"), str(tmp_path / "weekly")
    for part in range(5):
        rows.filter(F.col("id").between(72 - part * 18, 89 - part * 18)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = intake.stream_weekly_counts(stream)
    intake.write_weekly_counts(counts, path, str(tmp_path / "checkpoint"), compact_every=compact_every).awaitTermination()
    batch = feedback.weekly_counts(rows, at("2000-01-01"), at("2100-01-01"))
    assert sorted(tuples(intake.read_weekly_counts(spark, path, compact_every))) == sorted(tuples(batch))

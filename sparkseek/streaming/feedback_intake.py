"""Feedback arriving as a stream: intake into the table, and running weekly counts."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkseek.functions.scalars import week_start
from sparkseek.operators.feedback import stored_rows
from sparkseek.operators.numbering import largest_id
from sparkseek.operators.validate import ERROR, feedback_checks, split, with_failure, with_project_check
from sparkseek.sources.tables import read_feedback, write_feedback

BATCH = "intake_batch"
_LAST_ID = T.StructType([T.StructField("last_id", T.LongType())])

# A folder of weekly counts out of so many is complete.
COMPACT_EVERY = 100

# Fixed value: Spark counts windows from 1970-01-01, a Thursday; Mondays are 4 days on.
MONDAY_SHIFT = "4 days"


def checked_submissions(submissions: DataFrame, projects: DataFrame) -> DataFrame:
    """A stream of submissions with ``created_at`` and ``error_code``, joined to the static project table.

    A row without a time gets that of its micro-batch, which Spark keeps with the
    batch: it is the same again when the batch is replayed.
    """
    given = [F.col("created_at")] if "created_at" in submissions.columns else []
    stamped = submissions.withColumn("created_at", F.coalesce(*given, F.current_timestamp()))
    return with_project_check(with_failure(stamped, feedback_checks()), projects)


def accepted_once(checked: DataFrame, within: str | None = None) -> DataFrame:
    """The stream without submissions whose ``submission_id`` has been accepted before, in this micro-batch or an earlier one.

    Spark keeps the accepted ids as keyed state: for good, or with ``within`` (for example "7 days") until so long after their
    arrival. Arrival, not ``created_at``, is what counts, so that no row is ever too late to be stored. A rejected submission leaves
    no id behind and may come again, mended; rows without an id are each their own. Of repeats in one micro-batch any is kept.
    """
    once = F.when(F.col(ERROR).isNull(), F.col("submission_id").cast("string"))
    rows = checked.withColumn("_once", F.coalesce(once, F.concat(F.lit("alone-"), F.uuid())))
    if within is None:
        return rows.dropDuplicates(["_once"]).drop("_once")
    arrived = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return arrived.dropDuplicatesWithinWatermark(["_once"]).drop("_once", "_arrived")


def stream_feedback_intake(
    submissions: DataFrame,
    projects: DataFrame,
    table_path: str,
    rejected_path: str,
    checkpoint: str,
    every: str | None = None,
    start_after: int | None = None,
    name: str = "stream",
    repeats: bool = False,
    repeats_within: str | None = None,
) -> StreamingQuery:
    """Appends accepted rows with new ids to the feedback table, and rejected rows with their codes.

    The rows join those that ``write_feedback`` stores in ``table_path``. New ids go on after ``start_after``,
    by default the largest id in the table when the stream first runs; it is kept beside the checkpoint. Nothing
    else may append to the table while the stream runs. Streams into one table need different names.

    Runs until all that has arrived is taken in, or on and on with ``every``
    (for example "1 minute").

    ``submission_id`` is unique, or with ``repeats`` the rows of an id that comes again are left out (see ``accepted_once``).
    Rows without an id are stored after the others of their micro-batch. Each micro-batch replaces its own folders of each day, and
    numbers its rows after those of the batch before, so a batch that is
    replayed after a failure writes the same rows again instead of more rows.
    Beside the checkpoint, one small row per batch keeps the last id, so that no
    batch reads the rows stored before it.
    """
    ids_path = f"{checkpoint.rstrip('/')}-ids"
    spark = projects.sparkSession
    if not _exists(spark, _batch_folder(ids_path, -1)):
        if start_after is None:
            start_after = largest_id(read_feedback(spark, table_path)) if _exists(spark, table_path) else 0
        _keep_last_id(spark, ids_path, -1, start_after)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last_id = spark.read.schema(_LAST_ID).parquet(_batch_folder(ids_path, batch_id - 1)).first()["last_id"]
        batch = batch.persist()
        try:
            accepted_now, rejected_now = split(batch)
            rows = stored_rows(accepted_now, None, last_id)
            write_feedback(rows, table_path, "overwrite", f"{name}-{batch_id}")
            rejected_now.write.mode("overwrite").parquet(_batch_folder(rejected_path, batch_id))
            _keep_last_id(spark, ids_path, batch_id, last_id + accepted_now.count())
        finally:
            batch.unpersist()

    checked = checked_submissions(submissions, projects)
    if repeats:
        checked = accepted_once(checked, repeats_within)
    return (
        checked.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def _keep_last_id(spark: SparkSession, path: str, batch_id: int, last_id: int) -> None:
    rows = spark.createDataFrame([(last_id,)], _LAST_ID).coalesce(1)
    rows.write.mode("overwrite").parquet(_batch_folder(path, batch_id))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table in the folder."""
    try:
        spark.read.schema(_LAST_ID).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _trigger(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def _batch_folder(path: str, batch_id: int) -> str:
    return os.path.join(path, f"{BATCH}={batch_id}")


def monday_window(instant: str | Column) -> Column:
    return F.window(instant, "7 days", "7 days", MONDAY_SHIFT)


def stream_weekly_counts(feedback: DataFrame) -> DataFrame:
    """Running counts per week and project, for weeks with feedback only.

    State is one row per week and project, kept for good: there is no watermark, so every row counts,
    however late it comes.
    """
    weeks = feedback.groupBy(monday_window("created_at").alias("_week"), "project_id")
    return weeks.agg(
        F.count("id").alias("total_count"),
        F.count_if("useful").alias("useful_count"),
        F.count_if(~F.col("useful")).alias("not_useful_count"),
    ).select(
        week_start(F.col("_week.start")).alias("week_start"), "project_id", "total_count", "useful_count", "not_useful_count"
    )


def write_weekly_counts(
    counts: DataFrame, path: str, checkpoint: str, every: str | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Stores the changed counts of every micro-batch, each in its own folder.

    Every ``compact_every``-th folder holds all counts so far; older folders are no longer read and may go.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id and batch_id % compact_every == 0:
            spark = batch.sparkSession
            before = _latest(_batches(spark, path, batch_id - compact_every, batch_id - 1))
            rows = before.join(batch, ["week_start", "project_id"], "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(_batch_folder(path, batch_id))

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def read_weekly_counts(spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The latest counts of each week and project, from the last complete folder on."""
    newest = spark.read.parquet(path).agg(F.max(BATCH)).first()[0]
    return _latest(_batches(spark, path, newest - newest % compact_every, newest))


def _batches(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(BATCH).between(first, last))


def _latest(rows: DataFrame) -> DataFrame:
    numbers = ("total_count", "useful_count", "not_useful_count")
    latest = rows.groupBy("week_start", "project_id").agg(F.max_by(F.struct(*numbers), BATCH).alias("_latest"))
    return latest.select("week_start", "project_id", "_latest.*")

"""The weekly report out of stored counts, of which only those of changed folders are made again.

Feedback is stored by day and intake. For each such folder the counts by project are kept beside it, with a state of the folder's
files. An update lists the files, recounts the folders whose state is another one, and replaces just their counts, so an update that is
repeated after a failure changes nothing more.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions import filters
from sparkseek.functions.scalars import utc, week_start
from sparkseek.operators.feedback import grid_with_feedback, week_project_grid, weekly_counts, with_percentages
from sparkseek.sources import schemas
from sparkseek.sources.tables import DAY, INTAKE

#: Changed folders that are named in the scan's own predicate; more are joined.
MAX_LISTED_FOLDERS = 1_000
COUNTS = ("total_count", "useful_count", "not_useful_count")
STATE = "folder_state"

COUNTED = T.StructType(
    [
        T.StructField("project_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField(STATE, T.StringType()),
        T.StructField(DAY, T.DateType()),
        T.StructField(INTAKE, T.StringType()),
    ]
)


def _folder_states(spark: SparkSession, path: str) -> DataFrame:
    """(day, intake, state) of each folder of the feedback table: the names, sizes and times of its files, which are listed but not read."""
    schema = spark.read.format("binaryFile").load(path).schema
    if DAY not in schema.names:  # no files
        return spark.createDataFrame([], f"{DAY} date, {INTAKE} string, {STATE} string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    return files.groupBy(F.col(DAY).cast("date").alias(DAY), F.col(INTAKE).cast("string").alias(INTAKE)).agg(
        F.concat_ws("/", F.count("*"), F.sum("length"), F.sum(one)).alias(STATE)
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The kept counts; none if there are none yet. A folder without feedback has a row without a project."""
    try:
        return spark.read.schema(COUNTED).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTED)


def update_counts(spark: SparkSession, feedback_path: str, counts_path: str) -> int:
    """Brings the kept counts up to the feedback table; returns how many folders were counted again or found gone.

    Nothing may write to the feedback table meanwhile. Late rows, replays and removed folders all show in the files.
    """
    now = _folder_states(spark, feedback_path)
    folder = [DAY, INTAKE]
    before = read_counts(spark, counts_path).select(*folder, F.col(STATE).alias("_before")).distinct()
    gone = F.lit("gone")
    changed = (
        now.join(before, folder, "full")
        .select(*folder, F.coalesce(STATE, gone).alias(STATE), "_before")
        .filter(F.col("_before").isNull() | (F.col("_before") != F.col(STATE)))
        .select(*folder, STATE)
    )
    changed = spark.createDataFrame(changed.toArrow(), changed.schema)  # a row a folder: what the driver lists anyway
    many = changed.count()
    if not many:
        return 0
    stored = T.StructType([*schemas.CODE_QUERY_FEEDBACK.fields, *COUNTED.fields[-2:]])
    rows = spark.read.schema(stored).parquet(feedback_path)
    if many <= MAX_LISTED_FOLDERS:
        rows = rows.filter(F.col(DAY).isin([r[DAY] for r in changed.select(DAY).distinct().collect()]))
    counted = (
        rows.join(F.broadcast(changed.select(*folder)) if many <= MAX_LISTED_FOLDERS else changed.select(*folder), folder, "left_semi")
        .groupBy(*folder, "project_id")
        .agg(F.count("id").alias(COUNTS[0]), F.count_if("useful").alias(COUNTS[1]), F.count_if(~F.col("useful")).alias(COUNTS[2]))
    )
    # A row without a project stands for every changed folder, so that one that is empty or gone is replaced too.
    none = changed.select(*folder, F.lit(None).cast("long").alias("project_id"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    (
        counted.unionByName(none)
        .join(changed, folder)
        .select(*COUNTED.names)
        .hint("rebalance", DAY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folder)
        .parquet(counts_path)
    )
    return many


def weekly_feedback_stats_maintained(
    feedback: DataFrame, counts: DataFrame, projects: DataFrame, start: datetime, end: datetime, project_id: int | None = None
) -> DataFrame:
    """``weekly_feedback_stats`` from the kept counts of whole days; of days that the window cuts, from the feedback itself."""
    first, last = utc(start), utc(end)
    midnight, before_midnight = time(0, 0), time(23, 59, 59, 999999)
    whole_from = first.date() if first.time() == midnight else first.date() + timedelta(days=1)
    whole_to = last.date() if last.time() == before_midnight else last.date() - timedelta(days=1)
    own = None if project_id is None else filters.in_project(project_id)
    days = counts.filter(filters.all_of(F.col("project_id").isNotNull(), F.col(DAY).between(F.lit(whole_from), F.lit(whole_to)), own))
    parts = [days.select(week_start(F.col(DAY).cast("timestamp")).alias("week_start"), "project_id", *COUNTS)]
    for day in sorted({first.date(), last.date()}):
        if not whole_from <= day <= whole_to:
            lower = max(first, datetime.combine(day, midnight, first.tzinfo))
            upper = min(last, datetime.combine(day, before_midnight, first.tzinfo))
            parts.append(weekly_counts(feedback, lower, upper, project_id))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    weeks = rows.groupBy("week_start", "project_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return with_percentages(grid_with_feedback(week_project_grid(projects, start, end, project_id), weeks))

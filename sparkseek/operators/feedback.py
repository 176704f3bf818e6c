"""Feedback intake, the weekly project grid and the raw export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import filters
from sparkseek.functions.scalars import (
    bool_text,
    created_at_text,
    instant,
    json_numbers,
    percentage,
    week_end,
    week_start,
    weeks_between,
)
from sparkseek.operators.numbering import ROWS_PER_RANGE, largest_id, number_rows

FEEDBACK_COLUMNS = ("id", "project_id", "question", "useful", "similarities", "reason", "username", "created_at")
EXPORT_COLUMNS = ("id", "project_id", "project_name", "question", "useful", "similarities", "reason", "username", "created_at")


def append_feedback(
    existing: DataFrame, accepted: DataFrame, now: datetime, key: str = "submission_id", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Accepted submissions as stored rows: next ids in order of ``key``, time stamped."""
    return stored_rows(accepted, now, largest_id(existing), key, rows_per_range)


def stored_rows(
    accepted: DataFrame, now: datetime | None, last_id: int, key: str = "submission_id", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``append_feedback`` where the last id handed out is known; without ``now`` rows bring their time."""
    if now is not None:
        given = [F.col("created_at")] if "created_at" in accepted.columns else []
        accepted = accepted.withColumn("created_at", F.coalesce(*given, instant(now)))
    return number_rows(accepted, key, last_id, rows_per_range=rows_per_range).select(*FEEDBACK_COLUMNS)


def feedback_with_project(feedback: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds ``project_name``. Unhinted: small project tables are broadcast, hot projects split."""
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return feedback.join(names, "project_id")


def _inside(feedback: DataFrame, start: datetime, end: datetime, project_id: int | None) -> DataFrame:
    """Feedback of the window; of a table stored by day, only the folders that it overlaps are read."""
    day = "created_on" if "created_on" in feedback.columns else None
    project = None if project_id is None else filters.in_project(project_id)
    return feedback.filter(filters.all_of(filters.in_window(start, end, day=day), project))


def weekly_counts(feedback: DataFrame, start: datetime, end: datetime, project_id: int | None = None) -> DataFrame:
    """Sparse (week_start, project_id) counts of the feedback inside the window.

    Counted before the shuffle, so each task sends one row per week and project.
    """
    return _inside(feedback, start, end, project_id).groupBy(week_start(F.col("created_at")).alias("week_start"), "project_id").agg(
        F.count("id").alias("total_count"),
        F.count_if("useful").alias("useful_count"),
        F.count_if(~F.col("useful")).alias("not_useful_count"),
    )


def week_project_grid(projects: DataFrame, start: datetime, end: datetime, project_id: int | None = None) -> DataFrame:
    """Every project in every week that overlaps the window."""
    eligible = projects if project_id is None else projects.filter(F.col("id") == project_id)
    return eligible.select(
        F.explode(weeks_between(start, end)).alias("week_start"),
        F.col("id").alias("project_id"),
        F.col("name").alias("project_name"),
    )


def grid_with_feedback(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """The grid with counts, zero where a project had no feedback in a week."""
    joined = grid.join(counts, ["week_start", "project_id"], "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("total_count", "useful_count", "not_useful_count")}
    )


def with_percentages(stats: DataFrame) -> DataFrame:
    total = F.col("total_count")
    return stats.withColumns(
        {
            "useful_percentage": percentage(F.col("useful_count"), total),
            "not_useful_percentage": percentage(F.col("not_useful_count"), total),
        }
    )


def weekly_feedback_stats(
    feedback: DataFrame, projects: DataFrame, start: datetime, end: datetime, project_id: int | None = None
) -> DataFrame:
    """Dense week by project grid with counts and percentages."""
    grid = week_project_grid(projects, start, end, project_id)
    counts = weekly_counts(feedback, start, end, project_id)
    return with_percentages(grid_with_feedback(grid, counts))


def in_grid_order(stats: DataFrame) -> DataFrame:
    return stats.orderBy("week_start", "project_id")


def nest_weeks(stats: DataFrame, projects_per_row: int | None = None) -> DataFrame:
    """(week_start, week_end, projects[]): one row a week, the projects in order of id.

    With ``projects_per_row`` a week has further rows, with a column ``part``, each for that many ids: for
    tables with more projects than one row should hold. For any number, the flat statistics are the form.
    """
    entry = F.struct(
        "project_id",
        "project_name",
        "total_count",
        "useful_count",
        "not_useful_count",
        "useful_percentage",
        "not_useful_percentage",
    )
    parts = {}
    if projects_per_row is not None:
        parts = {"part": F.floor(F.col("project_id") / projects_per_row).cast("long")}
    weeks = stats.withColumns(parts).groupBy("week_start", *parts).agg(F.array_sort(F.collect_list(entry)).alias("projects"))
    return weeks.select("week_start", week_end(F.col("week_start")).alias("week_end"), *parts, "projects")


def export_rows(
    feedback: DataFrame, projects: DataFrame, start: datetime, end: datetime, project_id: int | None = None
) -> DataFrame:
    """Raw feedback of the window with project names, oldest first."""
    inside = _inside(feedback, start, end, project_id)
    return feedback_with_project(inside, projects).select(*EXPORT_COLUMNS).orderBy("created_at", "id")


def text_columns(zone: str | None = None) -> list[Column]:
    """The columns of ``export_rows`` as the CSV shows them."""
    return [
        F.col("id"),
        F.col("project_id"),
        F.col("project_name"),
        F.col("question"),
        bool_text(F.col("useful")).alias("useful"),
        json_numbers(F.col("similarities")).alias("similarities"),
        F.col("reason"),
        F.col("username"),
        created_at_text(F.col("created_at"), zone).alias("created_at"),
    ]


def export_text(rows: DataFrame, zone: str | None = None) -> DataFrame:
    """Export rows with every column as the CSV shows it."""
    return rows.select(*text_columns(zone))

"""The two feedback reports, from request to rows and files."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame

from sparkseek.functions.scalars import export_file_stem, instant, known_timezone
from sparkseek.operators.feedback import export_rows, export_text, nest_weeks, weekly_feedback_stats
from sparkseek.operators.validate import export_window, require_project, stats_window
from sparkseek.sources.sinks import export_feedback_csv, write_weekly_json


def stats_report(
    feedback: DataFrame,
    projects: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    project_id: int | None = None,
    now: datetime | None = None,
    projects_per_row: int | None = None,
) -> DataFrame:
    """Weeks with their nested project statistics, in order; each row names the window it is part of.

    ``projects_per_row``: see ``nest_weeks``.
    """
    first, last = stats_window(start, end, now)
    require_project(projects, project_id)
    weeks = nest_weeks(weekly_feedback_stats(feedback, projects, first, last, project_id), projects_per_row)
    window = {"start_date": instant(first), "end_date": instant(last)}
    return weeks.withColumns(window).orderBy("week_start", *(["part"] if projects_per_row is not None else []))


def export_report(
    feedback: DataFrame,
    projects: DataFrame,
    folder: str,
    start: datetime | None = None,
    end: datetime | None = None,
    project_id: int | None = None,
    zone: str | None = None,
    now: datetime | None = None,
) -> str:
    """Writes the CSV export into ``folder`` and returns its path."""
    zone = known_timezone(zone)
    first, last = export_window(start, end, now)
    require_project(projects, project_id)
    path = os.path.join(folder, export_file_stem(first, last, project_id))
    export_feedback_csv(export_text(export_rows(feedback, projects, first, last, project_id), zone), path)
    return path


def write_stats_report(report: DataFrame, path: str) -> None:
    write_weekly_json(report, path)

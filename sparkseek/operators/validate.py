"""Contract rules over tables of requests.

Each validator adds ``error_code``: the first broken rule in the contract's
order, or null for an accepted row. Whether a project exists comes last.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import rules
from sparkseek.functions.filters import FILTER_OPERATORS
from sparkseek.functions.rules import RuleViolation
from sparkseek.functions.scalars import days_later, failure_message, instant, is_blank, too_long, utc

ERROR = "error_code"


def first_failure(checks: Iterable[tuple[Column, str]]) -> Column:
    """The code of the first check that holds; unknown (null) checks do not."""
    return F.coalesce(*[F.when(broken, F.lit(code)) for broken, code in checks])


def with_failure(rows: DataFrame, checks: Iterable[tuple[Column, str]]) -> DataFrame:
    """Adds the first failure, keeping one found earlier."""
    found = first_failure(checks)
    return rows.withColumn(ERROR, F.coalesce(F.col(ERROR), found) if ERROR in rows.columns else found)


def with_messages(rows: DataFrame, value: str | Column) -> DataFrame:
    """Adds ``error_message`` with the row's own value (an id or a name) in it."""
    column = F.col(value) if isinstance(value, str) else value
    return rows.withColumn("error_message", failure_message(F.col(ERROR), column))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the error column, and rejected rows."""
    return checked.filter(F.col(ERROR).isNull()).drop(ERROR), checked.filter(F.col(ERROR).isNotNull())


def with_project_check(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rejects otherwise valid rows whose project does not exist.

    No join hint: Spark broadcasts the ids if they are few and otherwise splits a
    project that holds many of the rows.
    """
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_known"))
    marked = rows.join(known, "project_id", "left")
    return with_failure(marked, [(F.col("_known").isNull(), "404-project-not-found")]).drop("_known")


def search_request_checks() -> list[tuple[Column, str]]:
    question, limit, minimum = F.col("question"), F.col("limit"), F.col("min_similarity")
    checks = [
        (is_blank(question), "400-question-required"),
        (too_long(question, rules.MAX_QUESTION), "400-question-too-long"),
        (~limit.between(1, rules.MAX_RESULTS), "400-limit-out-of-range"),
        ((minimum < 0.0) | ((minimum > 1.0) & ~F.isnan(minimum)), "400-min-similarity-out-of-range"),
    ]
    for column, slug in (("kind", "kind"), ("namespace", "namespace"), ("type_name", "type-name")):
        used, value = F.col(f"{column}_operator").isNotNull(), F.col(f"{column}_value")
        known = F.col(f"{column}_operator").isin(*FILTER_OPERATORS[column])
        checks.append((used & ~known, f"400-{slug}-filter-operator-unknown"))
        checks.append((used & is_blank(value), f"400-{slug}-filter-value-required"))
        checks.append((used & too_long(value, rules.MAX_FILTER_VALUE), f"400-{slug}-filter-value-too-long"))
    return checks


def validate_search_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests: question, limit, min_similarity, project_id and the six filter columns."""
    return with_project_check(with_failure(requests, search_request_checks()), projects)


def feedback_checks() -> list[tuple[Column, str]]:
    question, user = F.col("question"), F.col("username")
    return [
        (is_blank(question), "400-question-required"),
        (too_long(question, rules.MAX_QUESTION), "400-question-too-long"),
        (F.col("useful").isNull(), "400-useful-required"),
        (F.col("similarities").isNull(), "400-similarities-required"),
        (F.size("similarities") > rules.MAX_SIMILARITIES, "400-too-many-similarities"),
        (is_blank(user), "400-user-required"),
        (too_long(user, rules.MAX_USER), "400-user-too-long"),
        (too_long(F.col("reason"), rules.MAX_REASON), "400-reason-too-long"),
    ]


def validate_feedback(submissions: DataFrame, projects: DataFrame) -> DataFrame:
    """Submissions: project_id, question, useful, similarities, reason, username."""
    return with_project_check(with_failure(submissions, feedback_checks()), projects)


def project_change_checks() -> list[tuple[Column, str]]:
    name = F.col("name")
    checks = [
        (is_blank(name), "400-name-required"),
        (too_long(name, rules.MAX_NAME), "400-name-field-too-long"),
    ]
    for column, slug in (("git_url", "git-url"), ("git_raw_url", "git-raw-url")):
        url = F.col(column)
        checks.append((url.isNotNull() & is_blank(url), f"400-{slug}-empty"))
        checks.append((too_long(url, rules.MAX_GIT_URL), f"400-{slug}-too-long"))
    return checks


def validate_project_changes(changes: DataFrame) -> DataFrame:
    """Changes: name, git_url, git_raw_url."""
    return with_failure(changes, project_change_checks())


def _now(now: datetime | None) -> datetime:
    return utc(now if now is not None else datetime.now(timezone.utc))


def _span_checked(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    if end - start > timedelta(days=rules.MAX_WINDOW_DAYS):
        raise RuleViolation("400-window-too-large")
    return start, end


def stats_window(start: datetime | None, end: datetime | None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The reported window; a missing end is derived from the other one."""
    start, end = start and utc(start), end and utc(end)
    if start is not None and end is not None and start > end:
        raise RuleViolation("400-invalid-date-range")
    width = timedelta(days=rules.DEFAULT_WINDOW_DAYS)
    last = end or (start + width if start is not None else _now(now))
    return _span_checked(start or last - width, last)


def export_window(start: datetime | None, end: datetime | None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The exported window; each end has its own default."""
    current = _now(now)
    start, end = start and utc(start), end and utc(end)
    first = start or current.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    last = end or current
    if first > last:
        raise RuleViolation("400-invalid-date-range")
    return _span_checked(first, last)


def _with_window(requests: DataFrame, first: Column, last: Column, inverted: Column) -> DataFrame:
    ranged = requests.withColumn("window_start", first).withColumn("window_end", last)
    span = F.unix_micros("window_end") - F.unix_micros("window_start")
    return with_failure(
        ranged,
        [
            (inverted, "400-invalid-date-range"),
            (span > rules.MAX_WINDOW_DAYS * 86_400_000_000, "400-window-too-large"),
        ],
    )


def with_stats_window(requests: DataFrame, now: datetime) -> DataFrame:
    """``stats_window`` for a table of report requests (start_date, end_date)."""
    start, end = F.col("start_date"), F.col("end_date")
    width = rules.DEFAULT_WINDOW_DAYS
    last = F.coalesce(end, days_later(start, width), instant(now))
    return _with_window(requests, F.coalesce(start, days_later(last, -width)), last, start > end)


def with_export_window(requests: DataFrame, now: datetime) -> DataFrame:
    """``export_window`` for a table of report requests (start_date, end_date)."""
    month = instant(utc(now).replace(day=1, hour=0, minute=0, second=0, microsecond=0))
    first, last = F.coalesce("start_date", month), F.coalesce("end_date", instant(now))
    return _with_window(requests, first, last, F.col("window_start") > F.col("window_end"))


def validate_project_filter(name: str | None) -> str | None:
    """A name filter may be absent or all white space, but not empty or very long."""
    if name is not None and not name:
        raise RuleViolation("400-name-empty")
    if name is not None and len(name) > rules.MAX_NAME_FILTER:
        raise RuleViolation("400-name-too-long")
    return name


def with_project_filter_check(requests: DataFrame, column: str = "name_filter") -> DataFrame:
    """``validate_project_filter`` for a table of lookups."""
    name = F.col(column)
    return with_failure(
        requests, [(name == "", "400-name-empty"), (too_long(name, rules.MAX_NAME_FILTER), "400-name-too-long")]
    )


def require_project(projects: DataFrame, project_id: int | None) -> None:
    """Fails, before anything else is planned, for a project that does not exist."""
    if project_id is not None and projects.filter(F.col("id") == project_id).isEmpty():
        raise RuleViolation("404-project-not-found", project_id)

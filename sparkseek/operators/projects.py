"""Project lookup and set-based maintenance of the project table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import filters
from sparkseek.functions.scalars import instant
from sparkseek.operators.numbering import ROWS_PER_RANGE, largest_id, number_rows
from sparkseek.operators.validate import ERROR, validate_project_changes, with_failure

PROJECT_COLUMNS = ("id", "name", "git_url", "git_raw_url", "created_at")


def list_projects(projects: DataFrame, name: str | None = None) -> DataFrame:
    """All projects, or those whose name contains the text, in order of name."""
    condition = None if name is None else filters.project_name_contains(name)
    return projects.filter(filters.all_of(condition)).select(*PROJECT_COLUMNS).orderBy("name", "id")


def project_by_id(projects: DataFrame, ids: DataFrame) -> DataFrame:
    """The projects asked for; ids without one yield nothing."""
    wanted = ids.select(F.col("project_id").alias("id")).distinct()
    return projects.join(wanted, "id").select(*PROJECT_COLUMNS)


def projects_exist(ids: DataFrame, projects: DataFrame) -> DataFrame:
    """Each row of ``ids`` (project_id) with ``exists``."""
    return _marked(ids, "project_id", projects.select(F.col("id").alias("project_id")), "exists")


def has_documents(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects with ``has_documents``."""
    return _marked(projects, "id", _present(projects, documents), "has_documents")


def has_feedback(projects: DataFrame, feedback: DataFrame) -> DataFrame:
    """Projects with ``has_feedback``."""
    return _marked(projects, "id", _present(projects, feedback), "has_feedback")


def _present(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """The projects' ids that some row has. The semi-join comes first: where rows are stored by project, only the
    folders of these projects are read."""
    wanted = projects.select(F.col("id").alias("project_id")).distinct()
    found = rows.select("project_id").join(wanted, "project_id", "left_semi")
    return found.distinct().withColumnRenamed("project_id", "id")


def _marked(rows: DataFrame, key: str, present: DataFrame, output: str) -> DataFrame:
    """Marks the rows whose key is present. ``present`` has each key once (made
    distinct per task first, so a key with very many rows is not moved whole)."""
    marks = present.withColumn("_present", F.lit(True))
    return rows.join(marks, key, "left").withColumn(output, F.coalesce("_present", F.lit(False))).drop("_present")


def name_exists(names: DataFrame, projects: DataFrame) -> DataFrame:
    """Each (name, excluding) with ``exists``: held, exactly, by a project other than ``excluding``.

    Project names are unique, so the join adds no rows.
    """
    held = projects.select("name", F.col("id").alias("_holder"))
    other = F.col("_holder").isNotNull() & (F.col("excluding").isNull() | (F.col("_holder") != F.col("excluding")))
    return names.join(held, "name", "left").withColumn("exists", other).drop("_holder")


@dataclass
class Maintenance:
    """The table after a batch of changes, and every change with its ``error_code``."""

    projects: DataFrame
    outcomes: DataFrame


def _with_claims(changes: DataFrame) -> DataFrame:
    """Adds ``_claim``, which orders the changes: by ``change_id``, and those without one after all others.

    Changes without an id are told apart by their place among those of the same name and all the same null id.
    """
    keyed, unkeyed = changes.filter(F.col("change_id").isNotNull()), changes.filter(F.col("change_id").isNull())
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("git_url", "git_raw_url"))).cast("long")
    claim = F.struct(F.col("change_id").isNull().alias("late"), F.coalesce(F.col("change_id").cast("long"), "_place").alias("place"))
    rows = keyed.withColumn("_place", F.lit(None).cast("long")).unionByName(unkeyed.withColumn("_place", place))
    return rows.withColumn("_claim", claim).drop("_place")


def _check_names(changes: DataFrame, projects: DataFrame, own_id: str | None) -> DataFrame:
    """Rejects names held in the table by another project, or claimed earlier in the batch."""
    held = projects.select("name", F.col("id").alias("_holder"))
    marked = changes.join(held, "name", "left")
    taken = F.col("_holder").isNotNull()
    if own_id is not None:
        taken = taken & (F.col("_holder") != F.col(own_id))
    return with_failure(marked, [(taken, "409-name-already-exists")]).drop("_holder")


def _check_batch(changes: DataFrame) -> DataFrame:
    """Rejects all but the earliest valid change of each name.

    A grouped minimum instead of a window: a name asked for by very many rows is
    reduced in each task before it is moved.
    """
    claims = _with_claims(changes)
    first = claims.filter(F.col(ERROR).isNull()).groupBy("name").agg(F.min("_claim").alias("_first"))
    claimed = claims.join(first, "name", "left")
    return with_failure(claimed, [(F.col("_first") != F.col("_claim"), "409-name-already-exists")]).drop("_first", "_claim")


def create_projects(
    projects: DataFrame, new: DataFrame, now: datetime, rows_per_range: int = ROWS_PER_RANGE
) -> Maintenance:
    """Adds projects (change_id, name, git_url, git_raw_url) with the next ids in order of change_id.

    ``change_id`` is unique and tells which of two equal names came first; changes without one come last.
    """
    outcomes = _check_batch(_check_names(validate_project_changes(new), projects, own_id=None))
    accepted = outcomes.filter(F.col(ERROR).isNull()).withColumn("created_at", instant(now))
    created = number_rows(accepted, "change_id", largest_id(projects), rows_per_range=rows_per_range)
    return Maintenance(
        projects.select(*PROJECT_COLUMNS).unionByName(created.select(*PROJECT_COLUMNS)),
        outcomes,
    )


def replace_projects(projects: DataFrame, changes: DataFrame) -> Maintenance:
    """Replaces name and urls whole (change_id, id, name, git_url, git_raw_url).

    An omitted url becomes null; id and creation time stay. All changes are judged
    against the table as it was; of several for one project the last one stands.
    """
    checked = _check_names(validate_project_changes(changes), projects, own_id="id")
    known = projects.select("id", F.lit(True).alias("_known"))
    known_checked = with_failure(
        checked.join(known, "id", "left"), [(F.col("_known").isNull(), "404-project-not-found")]
    ).drop("_known")
    # A name may be claimed again by the same project, but not by two of them.
    claims = known_checked.filter(F.col(ERROR).isNull()).groupBy("name").agg(F.min_by("id", "change_id").alias("_claimant"))
    claimed = known_checked.join(claims, "name", "left")
    outcomes = with_failure(claimed, [(F.col("_claimant") != F.col("id"), "409-name-already-exists")]).drop("_claimant")

    accepted = outcomes.filter(F.col(ERROR).isNull())
    last = accepted.groupBy("id").agg(
        F.max_by(F.struct("name", "git_url", "git_raw_url"), "change_id").alias("_new")
    )
    changed = F.col("_new").isNotNull()
    after = projects.join(last, "id", "left").select(
        "id",
        *[F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "git_url", "git_raw_url")],
        "created_at",
    )
    return Maintenance(after, outcomes)


def delete_projects(projects: DataFrame, ids: DataFrame, documents: DataFrame, feedback: DataFrame) -> Maintenance:
    """Deletes projects (project_id) that have neither documents nor feedback."""
    wanted = ids.select(F.col("project_id").alias("id")).distinct()
    marked = has_feedback(has_documents(wanted, documents), feedback)
    known = projects.select("id", F.lit(True).alias("_known"))
    outcomes = with_failure(
        marked.join(known, "id", "left"),
        [
            (F.col("has_documents"), "409-has-indexed-code-documents"),
            (F.col("has_feedback"), "409-has-feedback"),
            (F.col("_known").isNull(), "404-project-not-found"),
        ],
    ).select(F.col("id").alias("project_id"), ERROR)
    gone = outcomes.filter(F.col(ERROR).isNull()).select(F.col("project_id").alias("id"))
    return Maintenance(projects.join(gone, "id", "left_anti").select(*PROJECT_COLUMNS), outcomes)

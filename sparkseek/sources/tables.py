"""Reading and writing the stored tables as Parquet.

Documents are laid out by project and feedback by day, the two columns every
query filters on, so that partition pruning stands in for secondary indexes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions.scalars import utc, utc_date
from sparkseek.sources import schemas

DAY, INTAKE, STORED = "created_on", "intake", "batch"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects with the five columns the reports and lookups use."""
    return _read(spark, path, schemas.PROJECTS).select("id", "name", "git_url", "git_raw_url", "created_at")


def read_embedding_models(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.EMBEDDING_MODELS)


def read_code_documents(spark: SparkSession, path: str) -> DataFrame:
    """All document columns; a search touches only some, and the scan reads only those."""
    return _read(spark, path, schemas.CODE_DOCUMENTS)


def read_feedback(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Feedback rows with ``created_on``, the UTC day they are stored by.

    The reports turn their window into days and so skip the folders of others; a window given
    here does the same by whole days.
    """
    stored = T.StructType(
        [*schemas.CODE_QUERY_FEEDBACK.fields, T.StructField(DAY, T.DateType()), T.StructField(INTAKE, T.StringType())]
    )
    rows = _read(spark, path, stored).drop(INTAKE)
    if start is not None:
        rows = rows.filter(F.col(DAY) >= F.lit(utc(start).date()))
    if end is not None:
        rows = rows.filter(F.col(DAY) <= F.lit(utc(end).date()))
    return rows


ID_FOLDER = "id_folder"
PROJECT_FOLDERS = 64


def _in_folders(projects: DataFrame, folders: int) -> DataFrame:
    return projects.withColumn(ID_FOLDER, F.pmod(F.xxhash64("id"), F.lit(folders)).cast("int"))


def _write_folders(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.hint("rebalance", ID_FOLDER)
        .sortWithinPartitions(ID_FOLDER, "id")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(ID_FOLDER)
        .parquet(path)
    )


def write_projects(projects: DataFrame, path: str, folders: int = PROJECT_FOLDERS) -> None:
    """Store projects in folders by a hash of their ids, so that changes rewrite only the folders that they touch."""
    _write_folders(_in_folders(projects, folders), path, "errorifexists")


def read_stored_projects(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_projects``, as ``read_projects`` gives it."""
    return read_projects(spark, path).filter(F.col("id").isNotNull())


def store_project_changes(before: DataFrame, after: DataFrame, path: str, work: str, folders: int = PROJECT_FOLDERS) -> int:
    """Makes the stored table ``after`` where it is ``before`` (both whole tables); returns how many folders are rewritten.

    Folders without a new, changed or deleted project keep their files. The rows of the others are put together in the folder ``work`` and then
    replace them, so a change that is repeated after a failure leaves the same table. A folder whose last project goes keeps a row
    without an id, which reading leaves out.
    """
    spark = after.sparkSession
    names = [c for c in after.columns if c != "id"]
    sides = [t.select("id", F.struct(*names).alias(side)) for t, side in ((before, "_before"), (after, "_after"))]
    differ = sides[0].join(sides[1], "id", "full").filter(~F.col("_before").eqNullSafe(F.col("_after")))
    touched = _in_folders(differ, folders).select(ID_FOLDER).distinct()
    found = touched.toArrow()[ID_FOLDER].to_pylist()  # as many as there are folders at most
    if not found:
        return 0
    rows = _in_folders(after, folders).filter(F.col(ID_FOLDER).isin(found))
    empty = spark.createDataFrame([(f,) for f in found], f"{ID_FOLDER} int").join(rows.select(ID_FOLDER).distinct(), ID_FOLDER, "left_anti")
    rows.unionByName(empty, allowMissingColumns=True).write.parquet(work)
    _write_folders(spark.read.schema(rows.schema).parquet(work), path, "overwrite")
    return len(found)


def write_code_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Store documents by project, sorted by id so that a search for few ids skips row groups.

    Spark sizes the writers: a project with very many rows is spread over several, small ones share one.
    """
    (
        documents.hint("rebalance", "project_id")
        .sortWithinPartitions("project_id", "embedding_model_id", "id")
        .write.mode(mode)
        .partitionBy("project_id")
        .parquet(path)
    )


def write_feedback(feedback: DataFrame, path: str, mode: str = "append", intake: str = STORED) -> None:
    """Store feedback by UTC day and by the intake that brought it.

    With ``mode="overwrite"`` only the folders of this intake that get rows are replaced, so an intake that is
    repeated after a failure leaves the same rows.
    """
    placed = feedback.withColumn(DAY, utc_date(F.col("created_at"))).withColumn(INTAKE, F.lit(intake))
    (
        placed.hint("rebalance", DAY)
        .sortWithinPartitions(DAY, "project_id", "created_at")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, INTAKE)
        .parquet(path)
    )

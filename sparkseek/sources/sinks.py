"""File outputs of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# How CSV is written; null and empty fields look the same.
CSV = {
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
PART = "range"
MANIFEST = "part int, rows long, first_created_at timestamp, first_id long, last_created_at timestamp, last_id long"


def export_feedback_csv(text_rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, quotes doubled inside quoted fields, nulls empty.

    Rows sorted beforehand stay sorted from one part file to the next; a small
    export ends up in a single part. Records end in a line feed; line breaks and leading blanks inside a
    field are kept as they are, and a leading blank alone does not make a field quoted.
    """
    text_rows.write.mode(mode).options(header="true", **CSV).csv(path)


def export_feedback_parts(rows: DataFrame, path: str, text: Sequence[Column]) -> None:
    """The export as ordered CSV parts, the header in the first alone, and a manifest: joined in its order they are one CSV file.

    ``rows`` are raw export rows in any order, ``text`` the columns that the CSV shows of them (``feedback.text_columns``). Rows are dealt
    to parts by ranges of (created_at, id), kept under ``path``/ranges, so that a part is the same when it is written again. The parts lie
    under ``path``/parts, a file each; the manifest under ``path``/manifest has a row a part: its place, the number of its rows, and its
    first and last key. An export without rows is one part with the header.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange("created_at", "id").withColumn(PART, F.spark_partition_id())
    ranged.write.partitionBy(PART).parquet(f"{path}/ranges")
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(f"{path}/ranges")
    # Places without gaps, as a range may be empty.
    sized = stored.groupBy(PART).agg(
        F.count("*").alias("rows"), F.min(F.struct("created_at", "id")).alias("first"), F.max(F.struct("created_at", "id")).alias("last")
    )
    listed = sorted(sized.collect(), key=lambda r: r[PART])  # a row a part
    manifest = [(place, r["rows"], *r["first"], *r["last"]) for place, r in enumerate(listed)] or [(0, 0, None, None, None, None)]
    places = spark.createDataFrame([(r[PART], place) for place, r in enumerate(listed)] or [(-1, 0)], f"{PART} int, part int")
    names = rows.select(*text).columns
    lines = stored.join(F.broadcast(places), PART).select(
        "part", F.struct("created_at", "id").alias("_key"), F.to_csv(F.struct(*text), CSV).alias("value")
    )
    header = spark.createDataFrame([(0, ",".join(names))], "part int, value string")
    every = lines.unionByName(header, allowMissingColumns=True)
    every.repartition(len(manifest), "part").sortWithinPartitions("part", F.asc_nulls_first("_key")).select("part", "value").write.partitionBy(
        "part"
    ).text(f"{path}/parts")
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.json(f"{path}/manifest")


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_feedback_csv(spark, path: str, schema) -> DataFrame:
    """Reads an export back; fields may hold line breaks."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("nullValue", "")
        .csv(path)
    )


def write_weekly_json(weeks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row of ``nest_weeks``, nulls written out."""
    weeks.write.mode(mode).option("ignoreNullFields", False).json(path)

"""Dense ids for appended rows, as an identity column would hand out."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000
#: Cuts of the key that are looked for in one pass, and so the most ranges.
QUANTILES = 1_000


def number_rows(rows: DataFrame, key: str, start: int, output: str = "id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``output`` = start + 1, start + 2, ... in order of a unique numeric key; rows with a null key come last.

    One global row number would sort everything in a single task. Instead the key
    is cut at approximate quantiles, one range for each ``rows_per_range`` rows but as many as there
    are shuffle partitions at least (and `QUANTILES` at most); rows are numbered within each range, and the ranges shifted by the row
    counts before them, a small table. The cuts only balance the work: a row's range depends on its key
    alone, so the ids are exact wherever they fall, and the same on a re-run. Rows with a null key are dealt to ranges
    of their own by a hash of all their columns, and numbered in order of it: the same again for the same rows.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    number = F.col(key).cast("double")
    cuts, keyed, missing = rows.agg(F.percentile_approx(number, shares, QUANTILES * 10), F.count(key), F.count_if(F.col(key).isNull())).first()
    ranges = min(QUANTILES, max(least, -(-keyed // rows_per_range)))
    picked = [cuts[i * QUANTILES // ranges - 1] for i in range(1, ranges)] if cuts else []
    splits = [-float("inf"), *(sorted(set(picked)) or [0.0]), float("inf")]
    of_nulls = max(1, min(QUANTILES, -(-missing // rows_per_range)))
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(rows.withColumn("_key", F.coalesce(number, F.lit(0.0))))
    tie = F.when(F.col(key).isNull(), F.xxhash64(*[F.col(c).cast("string") for c in rows.columns]))
    ranged = placed.withColumn("_tie", tie).withColumn(
        "_range",
        F.when(F.col(key).isNotNull(), F.col("_range")).otherwise(len(splits) - 1 + F.pmod("_tie", F.lit(of_nulls))).cast("int"),
    )
    counted = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before = accumulate((counted.get(i, 0) for i in range(len(splits) + of_nulls - 2)), initial=start)
    offsets = spark.createDataFrame([(i, n) for i, n in enumerate(before)], "_range int, _before long")
    row = F.row_number().over(Window.partitionBy("_range").orderBy(key, "_tie"))
    return (
        ranged.withColumn("_row", row)
        .join(F.broadcast(offsets), "_range")
        .withColumn(output, F.col("_before") + F.col("_row"))
        .drop("_range", "_row", "_before", "_key", "_tie")
    )


def largest_id(table: DataFrame) -> int:
    """The greatest id handed out so far; zero for an empty table."""
    return table.agg(F.max("id")).first()[0] or 0

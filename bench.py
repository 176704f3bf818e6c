"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice; the better time counts, and the first is shown beside it.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkseek.operators.search import search_batch, with_embedding_space
from workload.queries import QUERIES
from workload.views import DIMENSIONS, MODEL, PROVIDER, Views

HEADLINE = [
    "search",
    "search_by_expression",
    "search_batch",
    "search_batch_filtered",
    "search_batch_blocks",
    "search_batch_blocks_filtered",
    "search_stored",
    "weekly_feedback_stats",
    "weekly_feedback_stats_stored",
    "nest_weeks",
    "export_rows",
    "export_feedback_csv",
    "embed_table",
    "embed_changed",
    "rerank_batch",
    "rerank_listwise",
    "code_search",
    "validate_feedback",
    "append_feedback",
    "mean_pool",
    "check_constraints",
    "create_projects",
    "stream_weekly_counts",
]


# Batches of a few requests, timed beside the one that asks for every vector.
BATCHES = (20, 200)


def run(frame: DataFrame) -> None:
    """Computes every column of every row and throws the rows away."""
    frame.write.format("noop").mode("overwrite").save()


def clock(make: Callable[[], DataFrame]) -> float:
    began = time.perf_counter()
    run(make())
    return round(time.perf_counter() - began, 3)


def few_requests(views: Views, n: int, blocks: bool) -> DataFrame:
    embedded = views.documents.filter("embedding IS NOT NULL")
    space = with_embedding_space(embedded, views.models, PROVIDER, MODEL, DIMENSIONS)
    return search_batch(space, views.requests.orderBy("query_id").limit(n), DIMENSIONS, blocks)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the executors' JVM and Python workers before anything is timed.
    run(spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count())
    run(spark.range(1000).mapInArrow(lambda batches: batches, "id long"))
    timed = {name: (lambda name=name: QUERIES[name](spark, folder)) for name in HEADLINE}
    for n in BATCHES:
        for name, blocks in (("requests", False), ("requests_in_blocks", True)):
            timed[f"search_batch_{n}_{name}"] = lambda n=n, blocks=blocks: few_requests(Views(spark, folder), n, blocks)
    seconds, first = {}, {}
    for name, make in timed.items():
        first[name] = clock(make)
        seconds[name] = min(first[name], clock(make))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

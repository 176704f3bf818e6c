"""Search over stored blocks against the search that compares everything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import pruned, search

DIMENSIONS = 8


def vectors_of(rng, n, clusters, spread):
    centres = rng.normal(size=(clusters, DIMENSIONS))
    return (centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, DIMENSIONS))).astype("float32")


def documents_of(spark, vectors, projects=3):
    rows = [
        (i, int(i % projects if i % 2 else 0) + 1, [float(x) for x in v], ["en", "de"][i % 2], f"src{i % 5}", None if i % 3 else "GoodText", f"f{i}", f"text {i}")
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(
        rows, "id long, project_id long, embedding array<float>, kind string, namespace string, type_name string, source_file string, embedding_text string"
    )


def requests_of(spark, vectors, **columns):
    rows = [(i, i % 3 + 1, [float(x) for x in v], i % 6 + 1) for i, v in enumerate(vectors)]
    asked = spark.createDataFrame(rows, "query_id long, project_id long, query_vector array<float>, k int")
    return asked.withColumns(columns)


def both(spark, tmp_path, monkeypatch, vectors, requests, block_rows=16, slice_rows=64):
    monkeypatch.setattr(pruned, "SLICE_ROWS", slice_rows)
    documents = documents_of(spark, vectors)
    pruned.write_vector_blocks(documents, str(tmp_path / "blocks"), str(tmp_path / "levels"), block_rows)
    stored = pruned.VectorBlocks(spark, str(tmp_path / "blocks"))
    found = pruned.search_pruned(documents, stored, requests, DIMENSIONS, str(tmp_path / "search"))
    expected = search.search_batch(documents, requests, DIMENSIONS, blocks=False)
    show = ("query_id", "vector_rank", "id", F.coalesce(F.col("similarity").cast("string"), F.lit("-")).alias("s"))
    ours, theirs = (sorted(tuple(r) for r in x.select(*show).collect()) for x in (found, expected))
    opened = spark.read.parquet(str(tmp_path / "search/first")).unionByName(spark.read.parquet(str(tmp_path / "search/further")))
    return ours, theirs, pruned.opened_share(stored, requests, opened).first()


def test_clustered_vectors_leave_most_blocks_out(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = vectors_of(rng, 900, 25, 0.05)
    ours, theirs, share = both(spark, tmp_path, monkeypatch, vectors, requests_of(spark, vectors[:60] + np.float32(0.01)))
    assert ours == theirs
    assert share["opened"] < 0.25 * share["blocks"]


def test_scattered_vectors_with_zero_nan_and_copies(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = vectors_of(rng, 300, 300, 1.0)
    vectors[::40] = 0.0
    vectors[1::50] = np.nan
    vectors[100:160] = vectors[100]
    asked = np.concatenate([vectors[:20], vectors_of(rng, 20, 20, 1.0)])
    ours, theirs, _ = both(spark, tmp_path, monkeypatch, vectors, requests_of(spark, asked))
    assert ours == theirs


@pytest.mark.parametrize("floor", [0.2, 0.97])
def test_thresholds_and_filters(spark, tmp_path, monkeypatch, floor):
    rng = np.random.default_rng(3)
    vectors = vectors_of(rng, 400, 20, 0.2)
    odd = F.col("query_id") % 2 == 1
    requests = requests_of(
        spark, vectors[:30],
        min_similarity=F.when(F.col("query_id") % 3 > 0, F.lit(floor)),
        kind_operator=F.when(odd, "equals"), kind_value=F.when(odd, "de"),
        type_name_operator=F.when(~odd, "not_contains"), type_name_value=F.when(~odd, "good*"),
    )
    ours, theirs, _ = both(spark, tmp_path, monkeypatch, vectors, requests)
    assert ours == theirs


def test_more_asked_than_there_is_and_projects_without_vectors(spark, tmp_path, monkeypatch):
    vectors = vectors_of(np.random.default_rng(4), 12, 3, 0.1)
    vectors[3] = 0.0
    requests = requests_of(spark, vectors[:9]).withColumns({"k": F.lit(50), "project_id": F.col("query_id") % 5})
    ours, theirs, share = both(spark, tmp_path, monkeypatch, vectors, requests)
    assert ours == theirs
    assert share["opened"] == share["blocks"]


def test_a_request_comes_back_once_a_shelf_not_once_a_block():
    """Eight blocks that all requests open give k rows of each request, not k of each block."""
    docs = pa.table({"id": pa.array(range(80), pa.int64()), "block": pa.array([i % 8 for i in range(80)], pa.int64()),
                     "embedding": pa.array([[1.0, i / 80] for i in range(80)], pa.list_(pa.float32()))})
    asked = pa.table({"query_id": pa.array([7, 9, 4]), "project_id": pa.array([1, 1, 1]), "k": pa.array([3, 2, 5]),
                      "query_vector": pa.array([[1.0, 0.0], [1.0, 1.0], [1.0, 0.0]], pa.list_(pa.float32())),
                      "blocks": pa.array([list(range(8)), list(range(8)), [5, 90]], pa.list_(pa.int64()))})
    found = pruned._best_of_opened(docs, asked, 2)
    rows = sorted(zip(found["query_id"].to_pylist(), found["id"].to_pylist(), strict=True))
    assert rows == [(4, 5), (4, 13), (4, 21), (4, 29), (4, 37), (7, 0), (7, 1), (7, 2), (9, 78), (9, 79)]
    assert pruned._best_of_opened(docs.slice(0, 0), asked, 2).num_rows == 0 == pruned._best_of_opened(docs, asked.slice(0, 0), 2).num_rows


def test_pivots_are_drawn_in_one_pass(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("cell"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    pivots = pruned._pivots(rows, 0, 20)
    found = [(r["cell"], r["pivot"]) for r in pivots.collect()]
    assert len(found) == len(set(found)) and {(0, 0), (1, 1), (2, 2)} <= set(found) and 9 < len(found) < 60
    assert all(p % 3 == c for c, p in found)
    assert "Union" not in pivots._jdf.queryExecution().optimizedPlan().toString()

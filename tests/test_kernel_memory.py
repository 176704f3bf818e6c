"""What the search kernel holds at a time, in bytes that numpy allocates."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkseek.operators import rerank, topk


def test_a_block_of_many_requests_is_met_in_small_matrices():
    rng = np.random.default_rng(3)
    vectors = [pa.array(list(rng.standard_normal((3000, 8)).astype(np.float32)), pa.list_(pa.float32())) for _ in range(2)]
    ids, ones = pa.array(range(3000), pa.int64()), pa.array([1] * 3000, pa.int64())
    docs = pa.table({"id": ids, "project_id": ones, "embedding": vectors[0]})
    asked = topk.RequestBlock.from_arrow(pa.table({"query_id": ids, "project_id": ones, "k": ones, "query_vector": vectors[1]}), 8)
    tracemalloc.start()
    try:
        (found,) = topk.best_rows([docs], asked)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 3000 and peak < 60 << 20


def test_word_sets_of_a_batch_are_not_held_together():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(1000)) if i % 9 else None for i in range(3000)], pa.string())
    questions = pa.array([f"w{i}x5 other" for i in range(3000)], pa.string())
    tracemalloc.start()
    try:
        grades = rerank._grades_of_batch(questions, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert grades.to_pylist() == [5 if i % 9 else 0 for i in range(3000)] and peak < 120 << 20

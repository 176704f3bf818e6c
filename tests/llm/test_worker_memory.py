"""What a Python worker holds at most, and what it keeps after a task."""

import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sparkseek.llm import jaccard_join, shared, token_files


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_full_round_of_shingles_is_counted_in_place():
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    random = np.random.default_rng(3)
    texts = []
    for _ in range(210):
        text = np.full(40_000, 0x20, np.uint8)
        text[::2] = random.choice(letters, 20_000)
        texts.append(text.tobytes().decode())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found: list[pa.RecordBatch] = []
    # 4 million shingles of 8 bytes, and what one piece of text needs: no second or third copy of them beside.
    assert peak_mb(lambda: found.extend(jaccard_join._scan(5)(iter([batch])))) < 110
    tokens, times = (np.concatenate([b.column(c).drop_null().to_numpy() for b in found]) for c in ("token", "times"))
    sets = list(jaccard_join.shingle_sets(batch.column("text"), 5))
    assert sum(map(len, sets)) >= jaccard_join.COUNTED_AT_ONCE
    every, n = np.unique(np.concatenate(sets), return_counts=True)
    assert (times > 1).all() and np.isin(tokens.view(np.uint64), every[n > 1]).all()
    if len(found) and sum(b.column("token").null_count < b.num_rows for b in found) == 1:
        assert (tokens.view(np.uint64) == every[n > 1]).all() and (times == n[n > 1]).all()


@pytest.mark.parametrize("counted_at_once", [1, 7, 1000])
def test_recurring_shingles_are_counted_as_before(monkeypatch, counted_at_once):
    monkeypatch.setattr(jaccard_join, "COUNTED_AT_ONCE", counted_at_once)
    texts = ["a b c d", "a b c", None, "", "x", "x", "b c d a b c", "a b c d"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t], pa.string())], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    shown = [b for b in jaccard_join._scan(3)(iter(batches)) if b.column("token").null_count < b.num_rows]
    rounds, held = [[]], 0
    for batch in batches:
        (s,) = jaccard_join.shingle_sets(batch.column("text"), 3)
        rounds[-1].append(s)
        held += len(s)
        if held >= counted_at_once:
            rounds.append([])
            held = 0
    expected = []
    for kept in rounds:
        tokens, times = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
        expected += [(int(t), int(n)) for t, n in zip(tokens.view(np.int64)[times > 1], times[times > 1], strict=True)]
    assert [(r["token"], r["times"]) for b in shown for r in b.to_pylist()] == expected


def test_pairs_of_a_shard_are_counted_within_few_copies():
    random = np.random.default_rng(5)
    symbols = random.integers(0, 300, 1_000_000).astype(np.uint32)
    left, right = symbols[:-1], symbols[1:]
    at, which, counts = token_files.frequent_pairs(left[:50_000], right[:50_000], left[:50_000] != 7)
    pairs = (left[:50_000].astype(np.uint64) << np.uint64(32)) | right[:50_000]
    kinds, n = np.unique(pairs[left[:50_000] != 7], return_counts=True)
    assert sorted(counts.tolist()) == sorted(n[n >= token_files.LEAST_COUNT].tolist())
    assert (counts[which] == n[np.searchsorted(kinds, pairs[at])]).all()


@pytest.mark.skipif(sys.platform != "linux" or shared._trim is None, reason="needs glibc")
def test_pages_of_freed_arrays_go_back():
    def held_mb() -> float:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

    arrays = [np.ones(8_000) for _ in range(2_000)]  # 128 MB in blocks that the allocator keeps
    last, full = np.ones(8_000), held_mb()
    del arrays
    shared.release_memory()
    assert held_mb() < full - 100 and last.sum() == 8_000

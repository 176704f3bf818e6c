"""SuperMinHash near duplicates against all pairs, and signatures against their definition."""

import random

import numpy as np
import pytest

from sparkseek.llm import superminhash
from sparkseek.llm.words import U64, mix
from tests.llm import plain
from tests.llm.test_joins_and_mixes import near_copies


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_signature(elements, size):
    """The smallest (rank, draw) of each place, with whole permutations and without stopping early."""
    found = [None] * size
    for element in elements:
        places = list(range(size))
        for rank in range(size):
            draw = int(mix(np.array([element], U64) + U64(0x9E3779B97F4A7C15) * U64(rank + 1))[0])
            k = rank + ((draw >> 32) * (size - rank) >> 32)
            places[rank], places[k] = places[k], places[rank]
            value = rank << 32 | draw & 0xFFFFFFFF
            at = places[rank]
            found[at] = value if found[at] is None else min(found[at], value)
    return [2**64 - 1 if x is None else x for x in found]


def test_signatures_with_early_stopping_equal_whole_ones():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 7, 40, 300, 0, 3]
    sets = [rng.integers(0, 2**63, n).astype(U64) for n in sizes]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    found = superminhash.signatures(np.concatenate(sets), begins, 24)
    assert found.tolist() == [plain_signature(s, 24) for s in sets]


def test_shares_of_equal_places_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 30).astype(U64)
    estimates = []
    for _ in range(300):
        x = mix(pool + U64(rng.integers(1, 2**62)))
        found = superminhash.signatures(np.concatenate([x[:24], x[6:]]), np.array([0, 24, 48]), 64)
        estimates.append((found[0] == found[1]).mean())
    assert abs(np.mean(estimates) - 18 / 30) < 0.02
    # Independent minima would have a variance of 0.6 * 0.4 / 64 here.
    assert np.var(estimates) < 0.75 * 0.6 * 0.4 / 64


@pytest.mark.parametrize(("seed", "few", "part"), [(1, 8, 512), (2, 0, 3), (3, 2, 7)])
def test_components_equal_those_of_all_pairs(few_partitions, monkeypatch, seed, few, part):
    monkeypatch.setattr(superminhash, "FEW", few)
    monkeypatch.setattr(superminhash, "PART_MEMBERS", part)
    monkeypatch.setattr(superminhash, "PART_ASKERS", part)
    texts = near_copies(random.Random(seed), 70)
    texts |= {100: None, 101: "", 102: " \n ", 103: texts[0].upper(), 104: texts[1] + "  "}
    rows = [(i, t, i, "x") for i, t in texts.items()]
    random.Random(seed).shuffle(rows)
    documents = few_partitions.createDataFrame(rows, "doc_id long, text string, n long, key string")
    found = {r["doc_id"]: r for r in superminhash.near_duplicates(documents).collect()}
    expected = plain.linked(texts, 4, 80)
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(plain.shingles(t, 4)) for i, t in texts.items()}
    assert {i: r["kept"] for i, r in found.items()} == {i: i == c for i, c in expected.items()}


def test_null_and_repeated_ids_long_texts_and_empty_tables(few_partitions):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(200_000))
    rows = [(None, "a b c d e"), (None, None), (3, "a b c d e"), (3, "a b c d e"), (5, long), (6, long + " more"), (-2, "A b c D e")]
    documents = few_partitions.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in superminhash.near_duplicates(documents).collect())
    assert found == sorted([("None", None, None)] * 2 + [("3", -2, False)] * 2 + [("5", 5, True), ("6", 5, False), ("-2", -2, True)])
    assert superminhash.near_duplicates(few_partitions.createDataFrame([], "doc_id long, text string")).count() == 0

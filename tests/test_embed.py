"""Embedding: the hashed embedder, custom embedders and pooling."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import vectors
from sparkseek.operators import embed


def signs(word: str, dimensions: int) -> np.ndarray:
    digest = hashlib.md5(word.encode()).digest()
    for i in range(1, -(-dimensions // 128)):
        digest += hashlib.md5(f"{i}:{word}".encode()).digest()
    return 2.0 * np.unpackbits(np.frombuffer(digest, np.uint8))[:dimensions] - 1


@pytest.mark.parametrize("dimensions,normalized,limit", [(64, True, None), (200, True, None), (32, False, None), (64, True, 2)])
def test_hashed_tokens(spark, dimensions, normalized, limit):
    texts = ["Open the FILE, the file!", "", "?? --", "x"]
    embedder = embed.HashedTokens(dimensions, normalized, limit)
    out = embed.embed_table(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", embedder, tasks=2)
    got = {r["i"]: np.array(r["embedding"]) for r in out.collect()}
    words = ["open", "the", "file", "the", "file"][:limit]
    expected = np.mean([signs(w, dimensions) for w in words], axis=0)
    if normalized:
        expected = expected / np.linalg.norm(expected)
    assert got[0] == pytest.approx(expected, abs=1e-6)
    assert not got[1].any() and not got[2].any() and len(got[1]) == dimensions
    assert np.linalg.norm(got[3]) == pytest.approx(1.0 if normalized else np.sqrt(dimensions), abs=1e-5)


def test_whole_text_counts(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = spark.createDataFrame([(1, long), (2, long + " " + "tail " * 3000)], "i int, t string")
    a, b = [np.array(r["embedding"]) for r in embed.embed_table(rows, "t", embed.HashedTokens()).orderBy("i").collect()]
    assert a @ b < 0.99


class Lengths:
    """A made-up model: the text's length, opened once per task."""

    provider, model, dimensions = "Test", "length", 2

    def __init__(self, width=2):
        self.width = width

    def prepare(self, text):
        return F.upper(text)

    def open(self):
        def run(batch: pa.Array) -> pa.Array:
            rows = [[float(len(x.as_py())), float(x.as_py().isupper())][: self.width] for x in batch]
            return pa.array(rows, pa.list_(pa.float32()))

        return run


def test_custom_embedder(spark):
    embed.register_embedder("Test", Lengths)
    out = embed.embed_table(spark.createDataFrame([("abc",)], "t string"), "t", embed.resolve_embedder("test")).first()
    assert out["embedding"] == [3.0, 1.0]
    assert (out["embedding_provider"], out["embedding_model"], out["embedding_dimensions"]) == ("Test", "length", 2)


def test_wrong_length_fails(spark):
    with pytest.raises(Exception, match="vector has 1 dimensions, model has 2"):
        embed.embed_table(spark.createDataFrame([("abc",)], "t string"), "t", Lengths(width=1)).collect()


def test_texts_are_pooled_together_as_alone(spark):
    texts = [None, "", "one", "one two two", " . ", *[f"w{i} w{i % 7} x" for i in range(700)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for dimensions, normalized in ((16, True), (200, False)):
        embedder = embed.HashedTokens(dimensions, normalized)
        found = {r["i"]: r["embedding"] for r in embed.embed_table(frame, "t", embedder).collect()}
        for i in (0, 1, 2, 3, 4, 5, 300, 704):
            bits = []
            for word in re.findall(r"\w+", (texts[i] or "").lower()):
                digest = b"".join(hashlib.md5(s.encode()).digest() for s in [word, *[f"{d}:{word}" for d in range(1, embedder.digests)]])
                bits.append(np.unpackbits(np.frombuffer(digest, np.uint8))[:dimensions] * 2.0 - 1)
            mean = np.mean(bits, axis=0) if bits else np.zeros(dimensions)
            norm = np.sqrt(mean @ mean)
            assert found[i] == pytest.approx(mean / norm if normalized and norm else mean, abs=1e-6)


def test_unused_vectors_are_not_computed(spark):
    rows = embed.embed_table(spark.range(3).select(F.col("id").cast("string").alias("t")), "t", Lengths())
    assert "ArrowEval" not in rows.select("t")._jdf.queryExecution().executedPlan().toString()


def test_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in rows.select(vectors.l2_normalize(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_mean_pool(spark):
    tokens = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "doc long, vector array<float>")
    pooled = {r["doc"]: (r["token_count"], r["pooled"]) for r in vectors.mean_pool(tokens, "doc").collect()}
    assert pooled == {1: (2, [2.0, 3.0]), 2: (1, [5.0, 5.0])}
    scattered = spark.range(4000).select(
        F.concat(F.lit("k"), F.col("id") % 700).alias("key"), F.array(F.col("id").cast("float"), F.lit(2.0).cast("float")).alias("vector")
    ).repartition(7)
    pooled = {r["key"]: (r["token_count"], r["pooled"]) for r in vectors.mean_pool(scattered, "key").collect()}
    assert len(pooled) == 700 and pooled["k5"] == (6, [5 + 700 * 2.5, 2.0])


def test_mean_pool_of_a_hot_key(spark):
    """One key holds most rows; the sums are combined before the shuffle."""
    tokens = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("doc"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector")
    )
    pooled = vectors.mean_pool(tokens, "doc")
    assert "partial_sum" in pooled._jdf.queryExecution().executedPlan().toString()
    hot = pooled.filter("doc = 0").first()
    assert hot["token_count"] == 18_000 and hot["pooled"][1] == 1.0
    assert hot["pooled"][0] == pytest.approx(np.mean([i for i in range(20_000) if i % 10 < 9]))


def test_split_by_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "i int, v array<float>")
    fits, rest = vectors.split_by_dimensions(rows, "v", 2)
    assert [r["i"] for r in fits.collect()] == [2] and sorted(r["i"] for r in rest.collect()) == [1, 3]


def test_rows_in_few_pieces_are_told_from_rows_in_many(spark, tmp_path):
    for pieces in (1, 6):
        spark.range(0, 60, 1, pieces).write.parquet(str(tmp_path / str(pieces)))
    assert not embed.in_pieces(spark.read.parquet(str(tmp_path / "1")))
    assert embed.in_pieces(spark.range(0, 60, 1, 6))

"""Text to vector: pluggable embedders, run as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.scalars import tokens
from sparkseek.functions.vectors import SMALLEST_FLOAT, dimension_guard
from sparkseek.operators.registry import Registry

# One MD5 digest holds this many sign bits.
DIGEST_BITS = 128
# Texts whose bits are unpacked together.
TEXTS_AT_ONCE = 256


class Embedder(Protocol):
    """What a provider brings. ``open`` runs once per task; an exception fails the job."""

    provider: str
    model: str
    dimensions: int

    def prepare(self, text: Column) -> Column:
        """The UDF's input, built on the JVM side (the text itself, or a digest of it)."""

    def open(self) -> Callable[[pa.Array], pa.Array]:
        """Loads the model and returns a function from inputs to float vectors."""


EMBEDDERS = Registry("embedding provider")


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    EMBEDDERS.register(name, factory)


def resolve_embedder(name: str | None, **options) -> Embedder:
    if not name or not name.strip():
        raise LookupError(f"no embedding provider given; known: {', '.join(EMBEDDERS.names())}")
    return EMBEDDERS.resolve(name, **options)


def embed_column(text: Column, embedder: Embedder) -> Column:
    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = embedder.open()
        for batch in batches:
            yield run(batch)

    return vectors(embedder.prepare(text))


def embed_table(
    rows: DataFrame, text: str, embedder: Embedder, output: str = "embedding", tasks: int | None = None
) -> DataFrame:
    """Adds the vector and the provider, model and dimensions it came from.

    A vector of the wrong length fails the job, as any failure to embed does.
    ``tasks`` spreads the rows first: for tables stored in fewer pieces than there
    are cores, where the model's time outweighs moving the text.
    """
    if tasks is not None:
        rows = rows.repartition(tasks)
    raw = rows.withColumn(output, embed_column(F.col(text), embedder))
    return raw.withColumns(
        {
            output: dimension_guard(F.col(output), embedder.dimensions),
            "embedding_provider": F.lit(embedder.provider),
            "embedding_model": F.lit(embedder.model),
            "embedding_dimensions": F.lit(embedder.dimensions),
        }
    )


def in_pieces(rows: DataFrame) -> bool:
    """Whether the rows of a stored table lie in as many pieces as there are cores, so that ``embed_table`` need not spread them."""
    return rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism


def embed_changed(
    rows: DataFrame,
    text: str,
    embedder: Embedder,
    stored: DataFrame,
    text_hash: str = "embedding_text_hash",
    output: str = "embedding",
    tasks: int | None = None,
) -> DataFrame:
    """``embed_table`` that embeds only texts without a stored vector, each different one once; adds ``reused``.

    ``stored`` has rows embedded before, with the same columns ``text``, ``text_hash`` and ``output`` and the ``embedding_provider``,
    ``embedding_model`` and ``embedding_dimensions`` of ``embed_table``; vectors of other models do not count. Rows are matched by their hash
    together with a digest of the text itself, so that texts whose hashes clash stay apart, and only new texts are moved. A null text is
    a text of its own; a null hash counts as an empty one. Of stored vectors of one text any is taken.
    """
    keys = ["_hash", "_digest"]

    def keyed(table: DataFrame) -> DataFrame:
        digest = F.coalesce(F.sha2(text, 256), F.lit(""))
        return table.withColumns({"_hash": F.coalesce(F.col(text_hash).cast("string"), F.lit("")), "_digest": digest})

    same_model = (
        (F.col("embedding_provider") == embedder.provider)
        & (F.col("embedding_model") == embedder.model)
        & (F.col("embedding_dimensions") == embedder.dimensions)
    )
    known = keyed(stored.filter(same_model & F.col(output).isNotNull())).groupBy(*keys).agg(F.first(output).alias(output))
    asked = keyed(rows)
    missing = asked.select(*keys, text).join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
    new = embed_table(missing, text, embedder, output, tasks).select(*keys, output)
    vectors = known.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))
    joined = asked.join(vectors, keys).drop(*keys)
    return joined.withColumns(
        {
            "embedding_provider": F.lit(embedder.provider),
            "embedding_model": F.lit(embedder.model),
            "embedding_dimensions": F.lit(embedder.dimensions),
        }
    )


@dataclass(frozen=True)
class HashedTokens:
    """Offline embedder: each token is a vector of signs, a text their mean.

    The signs are bits of the token's MD5, taken on the JVM side. ``max_tokens``
    cuts a text at a model's sequence length; by default whole texts count.
    """

    dimensions: int = 64
    normalized: bool = True
    max_tokens: int | None = None
    provider: str = "Local"
    model: str = "hash-64"

    @property
    def digests(self) -> int:
        return -(-self.dimensions // DIGEST_BITS)

    def prepare(self, text: Column) -> Column:
        """All token digests of a text, one after the other, as one binary value."""
        words = tokens(text)
        if self.max_tokens is not None:
            words = F.slice(words, 1, self.max_tokens)

        def digest(word: Column) -> Column:
            salted = [F.md5(F.concat(F.lit(f"{i}:"), word)) for i in range(1, self.digests)]
            return F.concat(F.md5(word), *salted)

        return F.unhex(F.array_join(F.transform(words, digest), ""))

    def open(self) -> Callable[[pa.Array], pa.Array]:
        width, dimensions = self.digests * DIGEST_BITS // 8, self.dimensions

        def run(batch: pa.Array) -> pa.Array:
            batch = batch.cast(pa.large_binary())
            ends = np.frombuffer(batch.buffers()[1], np.int64)[batch.offset : batch.offset + len(batch) + 1]
            data = batch.buffers()[2]
            pooled = np.zeros((len(batch), dimensions))
            if data is not None and len(batch) and ends[-1] > ends[0]:
                raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, width)
                first = (ends[:-1] - ends[0]) // width
                count = np.diff(ends) // width
                some = np.flatnonzero(count)
                for at in range(0, len(some), TEXTS_AT_ONCE):
                    part = some[at : at + TEXTS_AT_ONCE]
                    begin, end = first[part[0]], first[part[-1]] + count[part[-1]]
                    bits = np.unpackbits(raw[begin:end], axis=1)[:, :dimensions]
                    ones = np.add.reduceat(bits, first[part] - begin, axis=0, dtype=np.int64)
                    pooled[part] = (2.0 * ones - count[part][:, None]) / count[part][:, None]
            if self.normalized:
                norm = np.sqrt((pooled * pooled).sum(axis=1))
                pooled /= np.where(norm > SMALLEST_FLOAT, norm, 1.0)[:, None]
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * dimensions
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(pooled.astype(np.float32).ravel()))

        return run


register_embedder("Local", HashedTokens)

"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the smallest positive single-precision number.
SMALLEST_FLOAT = 1.401298464324817e-45


def vector_literal(values: Sequence[float]) -> Column:
    """A single-precision vector, as vectors are stored."""
    return F.lit([float(v) for v in values]).cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; NaN where either vector is all zeros."""
    scale = F.sqrt(squared_norm(a) * squared_norm(b))
    cosine = dot(a, b) / F.when(scale != 0.0, scale)
    held = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))
    return F.when(cosine.isNull(), F.lit(float("nan"))).otherwise(held)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def round10(x: Column) -> Column:
    """Ten decimal places, halves away from zero; for output only."""
    return F.when(F.isnan(x), x).otherwise(F.round(x, 10))


def l2_normalize(v: Column) -> Column:
    """Unit length, as ``array<float>``; a vector of (nearly) no length stays as it is."""
    norm = F.sqrt(squared_norm(v))
    return F.when(norm <= F.lit(SMALLEST_FLOAT), v.cast("array<float>")).otherwise(
        F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
    )


def dimension_guard(v: Column, dimensions: int | Column) -> Column:
    """The vector itself, or a failed job if its length is not the model's."""
    expected = F.lit(dimensions) if isinstance(dimensions, int) else dimensions
    text = F.format_string("vector has %d dimensions, model has %d", F.size(v), expected)
    return F.when(F.size(v) == expected, v).otherwise(F.raise_error(text))


def split_by_dimensions(rows: DataFrame, vector: str, dimensions: int | Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector fits the model, and the rest (missing vectors included)."""
    expected = F.lit(dimensions) if isinstance(dimensions, int) else dimensions
    fits = F.coalesce(F.size(vector) == expected, F.lit(False))
    return rows.filter(fits), rows.filter(~fits)


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int | None = None) -> np.ndarray:
    """A list column as a 2-d float64 array; every vector must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    if column.null_count:
        raise ValueError("vector is missing")
    expected = dimensions if dimensions is not None else (lengths[0].as_py() if len(column) else 0)
    if len(column) and pc.any(pc.not_equal(lengths, expected)).as_py():
        raise ValueError(f"vector length differs from {expected}")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), expected)


def _batch_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts and sums per key of each Arrow batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        codes = np.asarray(coded.indices)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        sums = np.add.reduceat(matrix(batch.column(1))[order], starts, axis=0)
        offsets = np.arange(len(starts) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.record_batch(
            {
                batch.schema.names[0]: coded.dictionary.take(pa.array(codes[order][starts])),
                "_n": pa.array(np.diff(np.r_[starts, len(codes)]), pa.int64()),
                "_sums": pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel())),
            }
        )


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Per-key mean of token vectors held one per row: (key, token_count, pooled).

    The vectors of a key that lie together, as an embedder writes them, are added
    up by the batch. The sums are then combined per (key, dimension) before the
    shuffle, so a key with very many tokens costs no more to move than any other,
    and only one row per dimension is gathered for each key.
    """
    rows = tokens.select(key, vector).filter(F.col(vector).isNotNull())
    sums = T.StructField("_sums", T.ArrayType(T.DoubleType()))
    schema = T.StructType([rows.schema[key], T.StructField("_n", T.LongType()), sums])
    cells = rows.mapInArrow(_batch_sums, schema).select(key, "_n", F.posexplode("_sums").alias("_dim", "_x"))
    means = cells.groupBy(key, "_dim").agg((F.sum("_x") / F.sum("_n")).alias("_mean"), F.sum("_n").alias("_n"))
    return means.groupBy(key).agg(
        F.max("_n").alias("token_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_mean"))), lambda c: c["_mean"]).alias("pooled"),
    )

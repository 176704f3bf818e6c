"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of bits, the sides of random hyperplanes through the mean on which
it lies, and keeps the strings in sorted arrays. A query descends each tree to the longest prefix that it
shares with any string; then all trees ascend together, one bit at a time, until the strings that share the
prefix of that length, over all trees, are enough. All of these are candidates and are compared exactly.

The arrays are cut into blocks by the strings' first bits, and a block that is still large by a hash of
the id, so that no block outgrows a task, however many strings are alike. A first pass counts, for each query, tree and
length, the strings that share the prefix; a second one compares those of the length chosen. A query that needs
more than its blocks hold goes on to the blocks of shorter prefixes.

Equal vectors are one entry with its smallest ids, as many as any answer can name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.llm.shared import cut

TREES = 16
#: Bits of a string.
BITS = 60
#: The ascent ends at so many strings over all trees, as a share of the entries, and so many at least. Vectors
#: without clusters, whose neighbours are hardly nearer than others, need such a share for nine tenths of the true
#: neighbours; clustered ones a small part of it.
SHARE = 0.8
ENOUGH = 1_000
#: Strings of a block, about.
BLOCK_ROWS = 50_000


def usable(vector: F.Column) -> F.Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rows_of(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of a list column without nulls, one a row, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)


def mean_vector(vectors: DataFrame, dimensions: int) -> np.ndarray:
    sums = vectors.agg(*[F.avg(F.col("vector")[i].cast("double")) for i in range(dimensions)]).first()
    return np.array([x or 0.0 for x in sums])


def hyperplanes(dimensions: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, trees * bits))


def with_strings(vectors: DataFrame, mean: np.ndarray, planes: np.ndarray, trees: int) -> DataFrame:
    """The rows once for each tree, with `tree` and `string`; the first bit is the highest."""
    share = vectors.sparkSession.sparkContext.broadcast((mean, planes))
    names = vectors.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, normals = share.value
        bits = normals.shape[1] // trees
        weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sides = (rows_of(batch.column("vector"), len(centre)) - centre) @ normals > 0
            strings = (sides.reshape(-1, trees, bits) * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(list(strings), pa.list_(pa.int64()))],
                names=[*names, "strings"],
            )

    coded = vectors.mapInArrow(run, f"{fields}, strings array<long>")
    return coded.select(*names, F.posexplode("strings").alias("tree", "string"))


def _counts(bits: int):
    """How many of a block's strings share each query's prefix, for every length from none to all bits."""

    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        strings = np.sort(block["string"].to_numpy(np.int64))
        asked = queries["string"].to_numpy(np.int64)
        counts = np.zeros((len(asked), bits + 1), np.int64)
        for length in range(bits + 1):
            low, high = prefix_range(strings, asked, bits - length)
            counts[:, length] = high - low
        return pd.DataFrame({"query_id": queries["query_id"], "counts": pd.Series(list(counts), dtype=object)})

    return run


def prefix_range(strings: np.ndarray, asked: np.ndarray, free: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted strings that agree but for the last `free` bits begin and end."""
    low = (asked >> free) << free
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << free))


def _nearest(bits: int, k: int):
    """The nearest entries of a block among those that share each query's prefix of the length chosen."""

    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "entry": [], "score": []}
        if len(block) and len(queries):
            order = np.argsort(block["string"].to_numpy(np.int64), kind="stable")
            strings = block["string"].to_numpy(np.int64)[order]
            entries = block["entry"].to_numpy(np.int64)[order]
            vectors = np.stack(block["vector"].to_numpy())[order].astype(np.float64)
            free = (bits - queries["length"]).to_numpy(np.int64)
            low, high = prefix_range(strings, queries["string"].to_numpy(np.int64), free)
            asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            for query, q, a, b in zip(queries["query_id"], asked, low, high, strict=True):
                score = np.sqrt(((vectors[a:b] - q) ** 2).sum(axis=1))
                best = np.lexsort((entries[a:b], score))[: k + 1]
                found["query_id"].append(np.full(len(best), query))
                found["entry"].append(entries[a:b][best])
                found["score"].append(score[best])
        return pd.DataFrame(
            {c: np.concatenate([np.zeros(0), *v]).astype(float if c == "score" else np.int64) for c, v in found.items()}
        )

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    trees: int = TREES,
    bits: int = BITS,
    share: float = SHARE,
    enough: int = ENOUGH,
    block_rows: int = BLOCK_ROWS,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query, the k nearest of the vectors found, by Euclidean distance.

    `queries` has the same columns as `vectors`; a query is never its own answer. Ties go to the smaller id. Rows
    with a null id, and vectors that are null, zero or hold null or non-finite components, take no part,
    nor do vectors of another length than that of the smallest id. Rows that repeat an id and a vector
    count once. With fewer candidates than k, all of them. Other columns are ignored.
    """

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))

    points = clean(vectors)
    first = points.agg(F.min_by(F.size("vector"), "id")).first()[0]
    if first is None:
        return points.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        ).limit(0)
    dimensions = int(first)
    points = points.filter(F.size("vector") == dimensions)
    asked = clean(queries).filter(F.size("vector") == dimensions).dropDuplicates(["id"])

    # Equal vectors: one entry with the k + 1 smallest ids; more can never be among the k nearest.
    alike = Window.partitionBy("vector").orderBy("id")
    entries = (
        points.dropDuplicates(["id"])
        .withColumn("at", F.row_number().over(alike))
        .filter(F.col("at") <= k + 1)
        .groupBy("vector")
        .agg(F.min("id").alias("entry"), F.collect_list("id").alias("ids"))
    )
    entries = cut(entries)
    mean = mean_vector(entries, dimensions)
    planes = hyperplanes(dimensions, trees, bits, seed)
    total = entries.count()
    enough = max(enough, int(np.ceil(share * total)))
    head = max(0, int(np.floor(np.log2(max(total, 1) / block_rows)))) if total > block_rows else 0

    def at_head(rows: DataFrame) -> DataFrame:
        return rows.withColumn("head", F.shiftright("string", bits - head))

    strings = at_head(with_strings(entries.select("entry", "vector"), mean, planes, trees))
    queried = at_head(with_strings(asked.select(F.col("id").alias("query_id"), "vector"), mean, planes, trees))
    queried = cut(queried)
    # Large blocks are divided by a hash of the entry.
    sizes = strings.groupBy("tree", "head").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    sizes = cut(sizes)
    blocks = strings.join(sizes, ["tree", "head"]).withColumn("part", F.pmod(F.xxhash64("entry"), "parts").cast("int"))

    def routed(rows: DataFrame) -> DataFrame:
        return rows.join(sizes, ["tree", "head"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def grouped(rows: DataFrame):
        return rows.groupBy("tree", "head", "part")

    # Descent and ascent: the longest prefix, the same for all trees, that enough strings share.
    keys = ["tree", "head", "part"]
    counts = (
        grouped(routed(queried).select(*keys, "query_id", "string"))
        .cogroup(grouped(blocks.select(*keys, "string")))
        .applyInPandas(_counts(bits), "query_id long, counts array<long>")
        .select("query_id", F.posexplode("counts").alias("length", "n"))
        .groupBy("query_id", "length")
        .agg(F.sum("n").alias("n"))
    )
    chosen = counts.filter((F.col("n") >= enough) & (F.col("length") >= head)).groupBy("query_id").agg(
        F.max("length").alias("length")
    )
    ready = queried.join(chosen, "query_id", "left").withColumn("reached", F.col("length").isNotNull())
    ready = cut(ready.withColumn("length", F.coalesce("length", F.lit(head))))
    wide = ready
    if head:
        wide = ready.filter("reached").unionByName(_wider(ready.filter("not reached"), strings, head, enough))
    near = (
        grouped(routed(wide).select(*keys, "query_id", "string", "vector", "length"))
        .cogroup(grouped(blocks.select(*keys, "string", "entry", "vector")))
        .applyInPandas(_nearest(bits, k), "query_id long, entry long, score double")
        .groupBy("query_id", "entry")
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        near.join(entries.select("entry", F.explode("ids").alias("vec_id")), "entry")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _wider(queries: DataFrame, strings: DataFrame, head: int, enough: int) -> DataFrame:
    """Queries whose own blocks hold too few, once for each block under the prefix that holds enough."""
    sizes = cut(strings.groupBy("tree", "head").count())
    found = None
    left = queries
    for length in range(head - 1, -1, -1):
        under = F.shiftright("head", head - length)
        total = sizes.groupBy("tree", under.alias("prefix")).agg(F.sum("count").alias("count"))
        sums = (
            left.withColumn("prefix", under).join(total, ["tree", "prefix"]).groupBy("query_id").agg(F.sum("count").alias("n"))
        )
        done = left.join(sums.filter((F.col("n") >= enough) | F.lit(length == 0)).select("query_id"), "query_id")
        spread = (
            done.withColumn("prefix", under)
            .drop("head")
            .join(sizes.select("tree", "head", under.alias("prefix")), ["tree", "prefix"])
            .drop("prefix")
            .withColumn("length", F.lit(length))
        )
        found = spread if found is None else found.unionByName(spread)
        left = left.join(done.select("query_id").distinct(), "query_id", "left_anti")
    return found

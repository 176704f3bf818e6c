"""Exact search that leaves out whole blocks of vectors by their angles.

Vectors are stored in blocks of near ones, each about a centre, with the largest angle between the centre and a member (the radius).
The angle between a request and any member is at least the angle to the centre less the radius, so a block for which that
is more than the request's k-th best angle so far holds no answer. Searches are in two steps: each request first opens the blocks
with the nearest centres, which gives it a k-th best distance, and then those that may still hold a better row. Both open blocks with
the kernel of the other searches, so rows, ties and thresholds are the same as theirs.

How much is left out depends on the data: much of clustered vectors, nothing of random directions in many dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.vectors import matrix, round10, similarity
from sparkseek.operators import search, topk

#: Vectors that a block aims at, most pivots by which one cell is divided at once, and how often cells are divided.
BLOCK_ROWS = 2_048
MOST_PIVOTS = 256
MOST_LEVELS = 4
#: Vectors, centres or requests that meet in one task.
SLICE_ROWS = 16_384
#: What rounding may take from an angle.
ANGLE_SLACK = 1e-6
#: Blocks of vectors without a direction (zero, or with a NaN) are named by the project, below all ids.
LOOSE = -(1 << 62)

STORED = ("id", "project_id", "embedding", *topk.FILTER_COLUMNS)


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def _slices(count: str, rows: int = SLICE_ROWS) -> F.Column:
    return F.ceil(F.col(count) / rows).cast("int")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], name: str, run, schema: str) -> DataFrame:
    """Both sides of each key, cut into slices of `SLICE_ROWS` by their ids: every slice of one with every slice of the other."""
    sides = []
    counts = [side.groupBy(*keys).agg(F.count("*").alias(c)) for side, c in ((left, "_left"), (right, "_right"))]
    both = counts[0].join(counts[1], keys).select(*keys, _slices("_left").alias("_lefts"), _slices("_right").alias("_rights"))
    for side, own, other in ((left, "left", "right"), (right, "right", "left")):
        each = F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1))
        at = F.pmod(F.xxhash64(F.col("id" if own == "left" else name)), F.col(f"_{own}s"))
        cut = side.join(both, keys).withColumns({f"_{own}": at.cast("int"), f"_{other}": each}).drop("_lefts", "_rights")
        # Columns of their own: the two sides may come from one table.
        sides.append(cut.select(*[F.col(c).alias(c) for c in cut.columns]).groupBy(*keys, "_left", "_right"))
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _nearest_pivot(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """(id, block, angle): the pivot with the smallest angle, of equal ones the smallest id."""
    if not rows.num_rows or not pivots.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "angle": pa.array([], pa.float64())})
    pivots = pivots.sort_by("pivot")
    vectors, centres = _unit(matrix(rows["embedding"])), _unit(matrix(pivots["embedding"]))
    cosine = vectors @ centres.T
    best = cosine.argmax(axis=1)
    angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1.0, 1.0))
    return pa.table({"id": rows["id"].combine_chunks(), "block": pa.array(pivots["pivot"].to_numpy()[best]), "angle": pa.array(angle)})


def _directed(embedding: str) -> F.Column:
    """Whether a vector has a direction."""
    squares = F.aggregate(embedding, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return (squares > 0) & (squares < float("inf"))


def _pivots(cells: DataFrame, level: int, block_rows: int) -> DataFrame:
    """(cell, pivot, embedding): rows drawn by a hash of the id, about one for ``block_rows`` of a cell, and the cell's first.

    Both are read from one join: of a union of the two, Spark takes the partitions to be those of the cells, which adaptive
    execution may then change on one side only, and the job fails on unequal numbers of partitions.
    """
    counts = cells.groupBy("cell").agg(F.count("*").alias("_count"), F.min("id").alias("_first"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("_count") / block_rows))
    share = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / (1 << 30)
    chosen = (share * F.col("_count") < wanted) | (F.col("id") == F.col("_first"))
    return cells.join(counts, "cell").filter(chosen).select("cell", F.col("id").alias("pivot"), "embedding")


def write_vector_blocks(documents: DataFrame, path: str, work: str, block_rows: int = BLOCK_ROWS) -> None:
    """Stores the vectors of one embedding space (unique ids) in ``path``: the rows sorted by block, and a table of the blocks.

    Each project is one cell at first. Cells of more than ``block_rows`` vectors are divided by pivots drawn by a hash of the ids, level by
    level; a cell that pivots cannot divide (copies) stays one block, which is read in slices. ``work`` is a folder for the levels.
    """
    spark = documents.sparkSession
    rows = documents.select(*STORED)
    loose = rows.filter(~_directed("embedding")).withColumns({"block": F.col("project_id") + LOOSE, "angle": F.lit(0.0)})
    rows = rows.filter(_directed("embedding"))
    vectors = rows.select("id", "project_id", "embedding")
    rows.select("id", F.col("project_id").alias("cell"), "embedding").write.parquet(f"{work}/0")
    done = None
    for level in range(MOST_LEVELS):
        cells = spark.read.parquet(f"{work}/{level}")
        pivots = _pivots(cells, level, block_rows)
        _meet(cells, pivots, ["cell"], "pivot", _nearest_pivot, "id long, block long, angle double").groupBy("id").agg(
            F.min(F.struct("angle", "block")).alias("_near")
        ).select("id", "_near.block", "_near.angle").write.parquet(f"{work}/placed-{level}")
        placed = spark.read.parquet(f"{work}/placed-{level}")
        sizes = placed.groupBy("block").agg(F.count("*").alias("_count"), F.max("angle").alias("_radius"))
        large = sizes.filter((F.col("_count") > block_rows) & (F.col("_radius") > ANGLE_SLACK)).select("block")
        last = level + 1 == MOST_LEVELS or large.isEmpty()
        fits = placed if last else placed.join(large, "block", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if last:
            break
        again = placed.join(large, "block").select("id", F.col("block").alias("cell"))
        again.join(vectors.select("id", "embedding"), "id").write.parquet(f"{work}/{level + 1}")
    stored = rows.join(done, "id").unionByName(loose)
    stored.repartitionByRange("project_id", "block", "id").sortWithinPartitions("project_id", "block", "id").write.parquet(f"{path}/vectors")
    kept = spark.read.parquet(f"{path}/vectors")
    blocks = kept.groupBy("project_id", "block").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    centres = vectors.select(F.col("id").alias("block"), F.col("embedding").alias("centre"))
    blocks.join(centres, "block", "left").write.parquet(f"{path}/blocks")


def _bounds(asked: pa.Table, blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest angle between each request and the members of each block; NaN without a direction."""
    queries = _unit(matrix(asked["query_vector"]))
    centres = np.full((blocks.num_rows, queries.shape[1]), np.nan)
    has = blocks["centre"].is_valid().to_numpy()
    if has.any():
        centres[has] = _unit(matrix(blocks["centre"].drop_null()))
    with np.errstate(invalid="ignore"):
        angle = np.arccos(np.clip(queries @ centres.T, -1.0, 1.0))
    radius = blocks["radius"].to_numpy()[None, :] + ANGLE_SLACK
    return np.maximum(angle - radius, 0.0), np.minimum(angle + radius, np.pi)


PAIRS = "query_id long, project_id long, block long"


def _pairs_table(asked: pa.Table, blocks: pa.Table, chosen: np.ndarray) -> pa.Table:
    q, b = np.nonzero(chosen)
    return pa.table(
        {
            "query_id": asked["query_id"].combine_chunks().take(pa.array(q)),
            "project_id": asked["project_id"].combine_chunks().take(pa.array(q)),
            "block": blocks["block"].combine_chunks().take(pa.array(b)),
        }
    )


def _first_blocks(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """The nearest blocks of each request that hold k rows together."""
    if not asked.num_rows or not blocks.num_rows:
        return _pairs_table(asked, blocks, np.zeros((asked.num_rows, blocks.num_rows), bool))
    low, high = _bounds(asked, blocks)
    order = np.argsort(low + high, axis=1, kind="stable")  # NaN last
    held = np.cumsum(blocks["n"].to_numpy()[order], axis=1)
    chosen = np.zeros(low.shape, bool)
    before = np.concatenate([np.zeros((len(held), 1), held.dtype), held[:, :-1]], axis=1)
    np.put_along_axis(chosen, order, before < asked["k"].to_numpy()[:, None], axis=1)
    return _pairs_table(asked, blocks, chosen)


def _further_blocks(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """The blocks that may hold a row within each request's limit: all where it has none, of a request or block without direction too."""
    if not asked.num_rows or not blocks.num_rows:
        return _pairs_table(asked, blocks, np.zeros((asked.num_rows, blocks.num_rows), bool))
    low, _ = _bounds(asked, blocks)
    limit = asked["limit_angle"].fill_null(np.inf).to_numpy()[:, None]
    chosen = ~(low > limit)
    # Rows without a direction come after all others, and are needed only where those are too few.
    loose = ~blocks["centre"].is_valid().to_numpy()
    chosen[:, loose] = asked["open_loose"].to_numpy(zero_copy_only=False)[:, None]
    return _pairs_table(asked, blocks, chosen)


def _best_of_opened(docs: pa.Table, requests: pa.Table, dimensions: int) -> pa.Table:
    """At most k rows of each request out of the blocks it opens, of those that the documents hold."""
    if not docs.num_rows or not requests.num_rows:
        return topk.NO_PAIRS
    top = topk.TopK(topk.RequestBlock.from_arrow(requests, dimensions))
    opened = requests["blocks"].combine_chunks()
    blocks, asked = opened.flatten().to_numpy(), pc.list_parent_indices(opened).to_numpy()
    order = np.argsort(blocks, kind="stable")
    blocks, asked = blocks[order], asked[order]
    docs = docs.sort_by("block")
    held, first = np.unique(docs["block"].to_numpy(), return_index=True)
    for block, at, after in zip(held, first, np.r_[first[1:], docs.num_rows], strict=True):
        start, end = np.searchsorted(blocks, [block, block + 1])
        if end > start:
            top.add_for(np.sort(asked[start:end]), docs.slice(at, after - at))
    return pa.Table.from_batches([top.result()])


def _opened(vectors: DataFrame, blocks: DataFrame, asked: DataFrame, pairs: DataFrame, dimensions: int) -> DataFrame:
    """The kernel's rows of each request out of the blocks that it opens.

    A project's blocks lie on shelves of about `SLICE_ROWS` rows, and a request goes once to each shelf of which it opens a block: its
    vector is moved, and its best rows come back, once a shelf instead of once a block.
    """
    wanted = pairs.select("project_id", "block").distinct()
    listed = wanted.limit(search.MAX_LISTED_HITS + 1).toArrow()
    if listed.num_rows <= search.MAX_LISTED_HITS:
        vectors = vectors.filter(F.col("block").isin(listed["block"].to_pylist()))
    shelves = blocks.groupBy("project_id").agg(F.sum("n").alias("_rows")).select("project_id", _slices("_rows").alias("_shelves"))
    placed = [
        rows.join(shelves, "project_id").withColumn("shelf", F.pmod(F.xxhash64("block"), F.col("_shelves"))).drop("_shelves")
        for rows in (vectors.join(wanted, ["project_id", "block"], "left_semi"), pairs)
    ]
    columns = ["id", "project_id", "shelf", "block", "embedding", *search._filtered_columns(asked)]
    lists = placed[1].groupBy("query_id", "project_id", "shelf").agg(F.collect_list("block").alias("blocks"))
    requests = lists.join(asked.drop("project_id"), "query_id")

    def nearest(docs: pa.Table, requests: pa.Table) -> pa.Table:
        return _best_of_opened(docs, requests, dimensions)

    return _meet(placed[0].select(*columns), requests, ["project_id", "shelf"], "query_id", nearest, search.PAIR_SCHEMA)


class VectorBlocks:
    """A stored table of blocks, and searches in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.parquet(f"{path}/vectors")
        self.blocks = spark.read.parquet(f"{path}/blocks")

    def nearest_pairs(self, requests: DataFrame, dimensions: int, work: str) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, distance, vector_rank) of each request's nearest rows, and the (query_id, project_id, block) it opened.

        Requests as for ``search_batch``. ``work`` is a folder for the rows of the first step.
        """
        spark = requests.sparkSession
        asked = search._request_columns(requests)
        most = asked.agg(F.max("k")).first()[0] or 0
        bare = asked.select("query_id", "project_id", "query_vector", "k")
        centres = self.blocks.withColumn("id", F.col("block"))
        _meet(centres, bare, ["project_id"], "query_id", _first_blocks, PAIRS).distinct().write.parquet(f"{work}/first")
        first = spark.read.parquet(f"{work}/first")
        search.best_per_query(_opened(self.vectors, self.blocks, asked, first, dimensions), most).write.parquet(f"{work}/first-rows")
        rows = spark.read.parquet(f"{work}/first-rows")

        # The k-th distance so far, if there are k, and the threshold, if there is one, limit what is still sought.
        worst = rows.groupBy("query_id").agg(F.count("*").alias("_found"), F.max("distance").alias("_worst"))
        full = (F.col("_found") >= F.col("k")) & ~F.isnan("_worst")
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("_worst"))))
        limits = [F.when(full, angle)]
        if "min_similarity" in asked.columns:
            floor = F.col("min_similarity")
            limits.append(F.when(floor.isNotNull() & ~F.isnan(floor), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), floor)))))
        limit = F.least(*limits) if len(limits) > 1 else limits[0]
        limited = asked.join(worst, "query_id", "left").select(
            "query_id", "project_id", "query_vector", "k",
            (limit + ANGLE_SLACK).alias("limit_angle"), (~F.coalesce(full, F.lit(False))).alias("open_loose"),
        )
        found = _meet(centres, limited, ["project_id"], "query_id", _further_blocks, PAIRS)
        found.join(first, ["query_id", "project_id", "block"], "left_anti").write.parquet(f"{work}/further")
        further = spark.read.parquet(f"{work}/further")
        better = _opened(self.vectors, self.blocks, asked, further, dimensions)
        with_k = rows.join(asked.select("query_id", "k"), "query_id").select("query_id", "id", "distance", "k")
        return search.best_per_query(with_k.unionByName(better), most), first.unionByName(further)


def search_pruned(documents: DataFrame, stored: VectorBlocks, requests: DataFrame, dimensions: int, work: str) -> DataFrame:
    """``search_batch`` over stored blocks: the same rows, with only the blocks read that may hold one.

    ``documents`` gives the hit columns of the stored ids. Requests without a direction open all blocks of their project.
    """
    pairs, _ = stored.nearest_pairs(requests, dimensions, work)
    return (
        search.hit_columns(documents)
        .join(pairs, "id")
        .select("query_id", "vector_rank", *search.HIT_COLUMNS, round10(similarity(F.col("distance"))).alias("similarity"))
    )


def opened_share(stored: VectorBlocks, requests: DataFrame, opened: DataFrame) -> DataFrame:
    """(blocks, opened, rows, opened_rows) over all requests: what a search could have opened, and what it did."""
    sizes = stored.blocks.groupBy("project_id").agg(F.count("*").alias("_blocks"), F.sum("n").alias("_rows"))
    could = requests.join(sizes, "project_id").agg(F.sum("_blocks").alias("blocks"), F.sum("_rows").alias("rows"))
    did = opened.join(stored.blocks.select("project_id", "block", "n"), ["project_id", "block"]).agg(
        F.count("*").alias("opened"), F.sum("n").alias("opened_rows")
    )
    return could.crossJoin(did).select("blocks", "opened", "rows", "opened_rows")

"""What several operators need of the session: shared folders, bounded filters, components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of a key filter: 2**22 bits are half a megabyte in every task, whatever the number of keys.
FILTER_SLOTS = 1 << 22
#: Rows of text, and bytes of them, that a Python worker is handed at once.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20
#: Spark's setting for removing an action's shuffle files when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a single machine without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions on frames made inside remove their shuffle files when they end, instead of when the driver collects its garbage.

    An operator of many short steps holds the files of one step at a time, not of all. The session's own setting comes back afterwards.
    """
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from the shared folder, so that a lost executor costs no more than a read; the shuffles that made them are removed."""
    shared_folder(frame.sparkSession)
    with shuffles_removed(frame.sparkSession):
        return frame.select("*").checkpoint()


def small_batches(frame: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands Python workers at most BATCH_ROWS rows or about BATCH_BYTES at once.

    Texts are long: Spark's own limits, 10,000 rows or 64 MB, would be held several times over in each worker. The settings stay, as rows
    are made only later; lower ones of the caller are left as they are. A single text is never divided.
    """
    conf = frame.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return frame


#: glibc's own call for it; elsewhere the allocator is left alone.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def release_memory() -> None:
    """Gives the pages of freed arrays back to the system.

    A Python worker outlives its tasks, and the allocators keep what a task freed: each worker would hold the largest arrays of every step that it
    once ran, beside those of the next one.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def slot_of(key: F.Column, slots: int = FILTER_SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def key_slots(keys: DataFrame, column: str, slots: int = FILTER_SLOTS) -> np.ndarray:
    """Which slots some key falls in: a filter of fixed size that lets every key pass, and few others."""
    with shuffles_removed(keys.sparkSession):
        found = keys.select(slot_of(F.col(column).cast("long"), slots).alias("slot")).distinct().toArrow()
    bits = np.zeros(slots, bool)
    bits[found.column("slot").to_numpy()] = True
    return np.packbits(bits)


#: Bits a key of a sized bit table, the most bits of one (16 MB), and the bits that one task packs.
BITS_A_KEY = 16
MOST_SLOTS = 1 << 27
PACKED_SLOTS = 1 << 15


def slots_for(keys: int) -> int:
    """Bits of a table for so many keys: a power of two, `BITS_A_KEY` for each key or more, up to `MOST_SLOTS`."""
    slots = PACKED_SLOTS
    while slots < min(MOST_SLOTS, BITS_A_KEY * keys):
        slots *= 2
    return slots


def bit_table(keys: DataFrame, column: str, slots: int) -> np.ndarray:
    """One bit for the low bits of each key (a long); packed by tasks, so that the driver gets slots / 8 bytes at most."""

    def pack(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bits = np.zeros(PACKED_SLOTS, bool)
        bits[rows.column("slot").to_numpy() % PACKED_SLOTS] = True
        return pa.table({"part": pa.array([group[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    packed = (
        keys.select(F.col(column).bitwiseAND(F.lit(slots - 1)).alias("slot"))
        .distinct()
        .withColumn("part", F.floor(F.col("slot") / PACKED_SLOTS))
        .groupBy("part")
        .applyInArrow(pack, "part long, bits binary")
        .toArrow()
    )
    table = np.zeros((slots // PACKED_SLOTS, PACKED_SLOTS // 8), np.uint8)
    for part, bits in zip(packed.column("part").to_pylist(), packed.column("bits").to_pylist(), strict=True):
        table[part] = np.frombuffer(bits, np.uint8)
    return table.reshape(-1)


def passing(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7))) & 1 == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that an edge names: the smallest id that its edges reach.

    Each round links every node to the smallest of its neighbours and itself, first from its larger
    neighbours, then from its smaller ones, until every node is linked to its smallest alone. Rows stay within twice the
    edges; minima are taken within each task before they are shuffled, so a node with a third
    of all edges is no more work than others. An edge from an id to itself names the id.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = cut(both)
    while True:
        # Larger neighbours are linked to the smallest neighbour.
        around = state.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(
            state.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        larger = (
            around.filter("y >= x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Smaller neighbours and the node itself are linked to the smallest of them.
        smallest = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(smallest, "u")
        state = cut(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(smallest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        if _settled(state):
            return state.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _settled(state: DataFrame) -> bool:
    """Whether every id has one row at most, and every id that others are linked to is linked to itself: another round changes nothing."""
    rows = state.select(F.col("u").alias("id"), F.lit(1).alias("own"), F.expr("u = v").alias("root"), F.lit(False).alias("named"))
    ends = state.select(F.col("v").alias("id"), F.lit(0).alias("own"), F.lit(False).alias("root"), F.lit(True).alias("named"))
    each = rows.unionAll(ends).groupBy("id").agg(F.sum("own").alias("own"), F.max("root").alias("root"), F.max("named").alias("named"))
    with shuffles_removed(state.sparkSession):
        return each.filter("own > 1 or (named and not root)").isEmpty()


def _marked(documents: DataFrame, ids: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """The documents with `_held`, true where a filter of fixed size holds the id back, and the distinct ids."""
    bits = small_batches(documents).sparkSession.sparkContext.broadcast(key_slots(ids, id_column))

    @F.arrow_udf("boolean")
    def held_back(slots: pa.Array) -> pa.Array:
        return pa.array(passing(bits.value, slots.to_numpy(zero_copy_only=False)))

    key = F.col(f"`{id_column}`").cast("long")
    held = key.isNotNull() & held_back(slot_of(F.coalesce(key, F.lit(0))))
    listed = ids.select(F.col(id_column).cast("long").alias("_listed")).filter("_listed is not null").distinct()
    return documents.withColumn("_held", held), listed


def told_by_ids(documents: DataFrame, ids: DataFrame, id_column: str, flag: str) -> DataFrame:
    """The documents with a boolean `flag`: whether the id (a whole number) is among `ids`, a column of the same name; false for null.

    Ids are kept as bits, in blocks of PACKED_SLOTS neighbouring ids, which every task looks up, so no text is moved. Where there are more
    blocks than MOST_SLOTS bits hold, as with ids that are far apart, the documents are joined instead.
    """
    spark = small_batches(documents).sparkSession
    shift = PACKED_SLOTS.bit_length() - 1
    listed = ids.select(F.col(id_column).cast("long").alias("_listed")).filter("_listed is not null").distinct()
    listed = listed.withColumn("block", F.shiftright("_listed", shift))
    if listed.select("block").distinct().count() > MOST_SLOTS // PACKED_SLOTS:
        found = documents.join(listed.select("_listed", F.lit(True).alias(flag)), F.col(id_column).cast("long") == F.col("_listed"), "left")
        return found.drop("_listed").withColumn(flag, F.col(flag).isNotNull())

    def pack(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bits = np.zeros(PACKED_SLOTS, bool)
        bits[rows.column("_listed").to_numpy() & (PACKED_SLOTS - 1)] = True
        return pa.table({"block": pa.array([group[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    packed = listed.groupBy("block").applyInArrow(pack, "block long, bits binary").orderBy("block").toArrow()
    bits = np.frombuffer(b"".join(packed.column("bits").to_pylist()), np.uint8)
    share = spark.sparkContext.broadcast((packed.column("block").to_numpy(), bits))

    @F.arrow_udf("boolean")
    def among(keys: pa.Array) -> pa.Array:
        blocks, bits = share.value
        key = keys.fill_null(0).to_numpy(zero_copy_only=False)
        found = np.zeros(len(key), bool)
        if len(blocks):
            at = np.minimum(np.searchsorted(blocks, key >> shift), len(blocks) - 1)
            held = blocks[at] == key >> shift
            found[held] = passing(bits, (at[held] << shift) + (key[held] & (PACKED_SLOTS - 1)))
        return pa.array(found & keys.is_valid().to_numpy(zero_copy_only=False))

    return documents.withColumn(flag, among(F.col(f"`{id_column}`").cast("long")))


def with_ids(documents: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The documents whose id is among `ids` (a column of the same name). Only those, and a few more, are moved."""
    marked, listed = _marked(documents, ids, id_column)
    held = marked.filter("_held").drop("_held")
    return held.join(listed, held[id_column].cast("long") == listed["_listed"], "left_semi")


def without_ids(documents: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The documents whose id is not among `ids` (a column of the same name), null ids included.

    Most rows are let through by the filter; only those that it holds back are moved to be joined.
    """
    marked, listed = _marked(documents, ids, id_column)
    held = marked.filter("_held").drop("_held")
    kept = held.join(listed, held[id_column].cast("long") == listed["_listed"], "left_anti")
    return marked.filter("not _held").drop("_held").unionByName(kept)

"""N-gram Jaccard join over a token-group matrix: which texts share most of their word shingles.

The sets of texts are joined exactly, without a pair for each two copies:

1. Texts of the same set become one class, represented by the smallest id.
2. Classes that share one of their smallest shingles form a *group* about one of them, its leader, divided into parts of
   bounded size. A class is also compared with its leaders; those links give first components.
3. The token-group matrix holds, for each part of a group, the union of its members' rarest shingles (one row a shingle
   and part). A class whose overlap with a part's union is below what a linked member would
   force is not compared with that part. The bound is the prefix one: of two sets that overlap in at
   least `o` shingles, the first `n - o + t` in any common order share at least `t`. Of two classes, the one whose component
   has fewer classes asks for the other: most of a large group of near copies is one component already, and asks for nothing.
4. Only parts that reach the bound are opened: a part of few members by pairs, a larger one in one task
   that counts the overlaps of all its members with a share of the classes that opened it.

The common order puts shingles that recur within a task's share of the texts last, read from a table
of fixed size; the order decides how much is compared, never what is found.

Sets are sets of 64-bit hashes, so an unequal pair of shingles counts as equal with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.shared import FILTER_SLOTS, components, cut, key_slots, passing, release_memory, shuffles_removed, slot_of, small_batches
from sparkseek.llm.words import U64, mix, pieces, shingle_sets

#: Entries of the table that orders shingles; a byte each, broadcast once.
ORDER_SLOTS = 1 << 22
#: Shingles of a task that are counted together when looking for recurring ones.
COUNTED_AT_ONCE = 4_000_000
#: The overlap that a class must show with a group's union, over the bound's own prefix.
PREFIX_OVERLAP = 3
#: Smallest shingles of a class by which it meets leaders.
SMALLEST = 4
#: Members of a part of a group, and classes that meet a part in one task.
PART_MEMBERS = 512
PART_QUERIES = 512
#: Up to so many members, a part is opened by pairs.
FEW = 8

SCAN_SCHEMA = "doc_id long, n int, f long, g long, low array<long>, token long, times int"
DOC = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int32()), ("f", pa.int64()), ("g", pa.int64()), ("low", pa.list_(pa.int64())),
     ("token", pa.int64()), ("times", pa.int32())]
)


def _needed(n: np.ndarray | int, percent: int):
    """The smallest overlap with any partner of a set of n that is similar enough."""
    return -(-percent * n // 100)


def _scan(words: int):
    """One narrow row a text, and a row for each shingle that recurs among the texts of a task."""

    def recurring(tokens: np.ndarray) -> pa.RecordBatch:
        tokens.sort()
        # Where runs of equal shingles begin and end; runs of one are never listed.
        again = np.r_[False, tokens[1:] == tokens[:-1], False]
        first, last = np.flatnonzero(~again[:-1] & again[1:]), np.flatnonzero(again[:-1] & ~again[1:])
        tokens, times = tokens[first], last - first + 1
        empty = pa.nulls(len(tokens))
        columns = [*[empty] * 5, pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [c.cast(f.type) for c, f in zip(columns, DOC, strict=True)], schema=DOC
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = np.zeros(0, U64), 0
        for batch in batches:
            for piece in pieces(batch):
                sets = list(shingle_sets(piece.column("text"), words))
                n = np.array([len(s) for s in sets], np.int32)
                f = np.array([s.sum(dtype=U64) for s in sets], U64)
                g = np.array([mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) for s in sets], U64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(f.view(np.int64)),
                        pa.array(g.view(np.int64)), pa.array([s[:SMALLEST].view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int32()),
                    ],
                    schema=DOC,
                )
                for s in sets:
                    if held + len(s) > len(kept):
                        kept.resize(max(held + len(s), min(2 * len(kept), COUNTED_AT_ONCE)), refcheck=False)
                    kept[held : held + len(s)] = s
                    held += len(s)
                if held >= COUNTED_AT_ONCE:
                    yield recurring(kept[:held])
                    held = 0
        if held:
            yield recurring(kept[:held])
        del kept
        release_memory()

    return run


def _order_table(found: DataFrame) -> np.ndarray:
    """How often shingles recur, as a power of two, for each slot of a hash."""
    slot = F.pmod(F.col("token"), F.lit(ORDER_SLOTS)).cast("int")
    with shuffles_removed(found.sparkSession):
        levels = (
            found.filter("token is not null")
            .groupBy("token")
            .agg(F.sum("times").alias("times"))
            .groupBy(slot.alias("slot"))
            .agg(F.max(F.ceil(F.log2("times"))).cast("byte").alias("level"))
            .toArrow()
        )
    table = np.zeros(ORDER_SLOTS, np.uint8)
    table[levels.column("slot").to_numpy()] = levels.column("level").to_numpy()
    return table


def _prefixes(words: int, percent: int, table):
    """The first shingles of every text in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for s in shingle_sets(piece.column("text"), words):
                    size = len(s) - _needed(len(s), percent) + min(PREFIX_OVERLAP, _needed(len(s), percent))
                    order = np.lexsort((s, level[(s % U64(ORDER_SLOTS)).astype(np.int64)]))
                    rows.append(s[order[:size]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                    names=["doc_id", "tokens"],
                )
        release_memory()

    return run


def _sets(words: int, bits):
    """The whole sets of the texts whose ids pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = passing(bits.value, batch.column("slot").to_numpy())
            for piece in pieces(batch.filter(pa.array(wanted))):
                rows = [s.tobytes() for s in shingle_sets(piece.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "tokens"]
                )
        release_memory()

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(t.as_buffer(), U64) for t in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _whole_sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, tokens) of the texts with these ids, and some others. Only their texts leave the scan."""
    bits = texts.sparkSession.sparkContext.broadcast(key_slots(ids, "doc_id"))
    marked = texts.withColumn("slot", slot_of(F.col("doc_id"), FILTER_SLOTS))
    return marked.mapInArrow(_sets(words, bits), "doc_id long, tokens binary")


def _verified(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the whole sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))
    sets = _whole_sets(texts, ids, words)
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_similar(percent), "a long, b long")
    )


def _open_part(percent: int):
    """One link from each class to each component among a part's members that it is similar enough to."""

    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if asked.num_rows and members.num_rows:
            sets = [np.frombuffer(t.as_buffer(), U64) for t in members["tokens"]]
            sizes = np.array([len(x) for x in sets])
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            theirs = members["component"].to_numpy()
            for own, binary in zip(asked["component"].to_pylist(), asked["tokens"], strict=True):
                mine = np.frombuffer(binary.as_buffer(), U64)
                low, high = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, side="right")
                count = high - low
                places = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                both = np.bincount(owner[places], minlength=len(sets))
                similar = 100 * both >= percent * (len(mine) + sizes - both)
                found += [(own, int(c)) for c in np.unique(theirs[similar]) if c != own]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _opened_whole(texts: DataFrame, asked: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components, from parts that are opened in one task each.

    A part that very many classes open is met by shares of them, each with the part's members.
    """
    shares = asked.groupBy("group", "part").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("class_id"), "shares").cast("int").alias("share")
    mine = asked.join(shares, ["group", "part"]).select("class_id", "component", "group", "part", share)
    theirs = placed.join(shares, ["group", "part"]).select(
        "class_id", "component", "group", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    )
    mine, theirs = cut(mine), cut(theirs)
    ids = mine.select(F.col("class_id").alias("doc_id")).unionAll(theirs.select("class_id"))
    sets = _whole_sets(texts, ids, words).withColumnRenamed("doc_id", "class_id").dropDuplicates(["class_id"])
    keys = ["group", "part", "share"]
    shown = [*keys, "component", "tokens"]
    sides = [side.join(sets, "class_id").select(*[F.col(c).alias(c) for c in shown]).groupBy(*keys) for side in (mine, theirs)]
    return sides[0].cogroup(sides[1]).applyInArrow(_open_part(percent), "a long, b long")


def jaccard_groups(
    documents: DataFrame, words: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id, component_id.

    Two documents link when their sets of distinct `words`-word shingles have a Jaccard similarity of at
    least `percent` / 100. class_id is the smallest id of the same set, component_id the smallest id
    that links reach, the document itself included. A text with fewer words is one shingle. A null or
    empty text, or one without words, has 0 shingles and links with nothing. Ids must be unique:
    of rows with the same id one is returned for each row, and they are taken as one document if their
    texts agree. Rows with a null id are returned with null class and component. Other columns are ignored.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    spark = small_batches(documents).sparkSession
    scan = cut(texts.mapInArrow(_scan(words), SCAN_SCHEMA))
    rows = scan.filter("token is null").select("doc_id", "n", "f", "g", "low")
    table = spark.sparkContext.broadcast(_order_table(scan))

    # 1. Classes of equal sets.
    first = (
        rows.filter("n > 0 and doc_id is not null")
        .groupBy("n", "f", "g")
        .agg(F.min("doc_id").alias("class_id"), F.first("low").alias("low"))
    )
    classes = cut(first)

    # 2. Groups about leaders, and components by verified links with them.
    bucket = classes.select("class_id", "n", "low", F.posexplode("low").alias("place", "token"))
    leader = bucket.groupBy("place", "token").agg(
        F.min_by(F.struct("class_id", "n", "low"), F.xxhash64("class_id", "place")).alias("to"),
        F.count("*").alias("members"),
    )
    near = (
        bucket.join(leader.filter("members > 1"), ["place", "token"])
        .filter("class_id <> to.class_id")
        .filter(F.least("n", "to.n") * 100 >= F.greatest("n", "to.n") * percent)
        .filter(F.size(F.array_intersect("low", "to.low")) >= F.least(F.lit(2), F.size("low"), F.size("to.low")))
        .select("class_id", F.col("to.class_id").alias("leader"))
        .distinct()
    )
    near = cut(near)
    a_pair = (F.least("class_id", "leader").alias("a"), F.greatest("class_id", "leader").alias("b"))
    links = cut(_verified(texts, near.select(*a_pair).distinct(), words, percent))
    linked = components(links).withColumnRenamed("id", "class_id")
    led = near.groupBy("class_id").agg(F.min("leader").alias("group"))
    led = led.unionAll(led.select(F.col("group"), F.col("group")).distinct()).groupBy("class_id").agg(F.min("group").alias("group"))
    members = classes.select("class_id", "n").join(linked, "class_id", "left").join(led, "class_id", "left")
    members = members.select(
        "class_id", "n", F.coalesce("component", "class_id").alias("component"), F.coalesce("group", "class_id").alias("group")
    )
    members = cut(members)
    sizes = members.groupBy("component").agg(F.count("*").alias("classes"))
    members = members.join(sizes, "component")
    parts = members.groupBy("group").agg(F.ceil(F.count("*") / PART_MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("class_id"), "parts").cast("int").alias("part")
    placed = cut(members.join(parts, "group").select("class_id", "n", "component", "classes", "group", part))

    # 3. The token-group matrix and the parts whose union reaches the bound. Of two sets, the one of the smaller component asks.
    prefix = (
        texts.mapInArrow(_prefixes(words, percent, table), "doc_id long, tokens array<long>")
        .withColumnRenamed("doc_id", "class_id")
        .join(placed, "class_id")
        .dropDuplicates(["class_id"])
        .select("class_id", "n", "component", "classes", "group", "part", F.explode("tokens").alias("token"))
        .repartition("token")  # once, for the matrix and for the join with it
    )
    matrix = prefix.groupBy("token", "group", "part").agg(
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.max(F.struct("classes", "component")).alias("largest"),
    )
    opened = (
        prefix.drop("group", "part")
        .join(matrix, "token")
        .filter("struct(classes, component) < largest")
        .filter(f"n * 100 >= least * {percent} and most * 100 >= n * {percent}")
        .groupBy("class_id", "n", "component", "classes", "group", "part")
        .agg(F.count("*").alias("overlap"), F.min("least").alias("least"))
        .filter(F.col("overlap") >= F.least(F.lit(PREFIX_OVERLAP), F.ceil(F.least("n", "least") * percent / 100)))
    )
    held = placed.groupBy("group", "part").agg(F.count("*").alias("held"))
    opened = cut(opened.join(held, ["group", "part"]))

    # 4. Qualifying parts are opened.
    others = placed.select(
        "group", "part", F.col("class_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("classes").alias("others")
    )
    pairs = (
        opened.filter(F.col("held") <= FEW)
        .join(others, ["group", "part"])
        .filter("struct(classes, component) < struct(others, other)")
        .filter(f"least(n, m) * 100 >= greatest(n, m) * {percent}")
        .select(F.col("class_id").alias("a"), "b")
    )
    few = cut(_verified(texts, cut(pairs), words, percent))
    many = cut(_opened_whole(texts, opened.filter(F.col("held") > FEW), placed, words, percent))
    own = members.select(F.col("class_id").alias("a"), F.col("component").alias("b"))
    found = components(own.unionAll(few).unionAll(many))
    found = found.withColumnRenamed("id", "class_id").withColumnRenamed("component", "component_id")

    named = classes.select("n", "f", "g", "class_id").join(found, "class_id")
    return rows.join(named, ["n", "f", "g"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )

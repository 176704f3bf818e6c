"""Near duplicates by SuperMinHash signatures: bands, verification on whole sets, and groups of linked documents.

A SuperMinHash signature gives each element of a set a permutation of the places 0 to m - 1 and keeps for each place the smallest
rank that an element has there. As an element has each rank once, the places of a signature vary less between sets than
with independent minima. Once all places are taken after the ranks up to j, later ranks cannot win and are not drawn
(early stopping): a large set costs about one draw an element, a small one m * log(m) draws.

1. Texts of the same set become one class, represented by the smallest id; copies cost no more than a row.
2. `BANDS` bands of `ROWS` places each: classes that agree in a band meet in its bucket. Two sets that are similar enough by 0.8 miss each
   other in all bands with a chance of (1 - 0.8**5)**40, about 1.2e-7.
3. Each class is verified with the smallest class of its buckets; links give first components.
4. A bucket that lies in one component is done. In others, the classes outside of the bucket's largest component are verified with all
   of other components: in small buckets pair by pair, in larger ones by parts of bounded size, in tasks that return links
   only. Buckets with the same largest component are opened as one, so that a large group of near copies, which most bands show
   again, is moved once.
5. Components of all links.

Links are always verified on whole sets of 64-bit shingle hashes, of which two different ones agree with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.shared import bit_table, components, cut, passing, slots_for, small_batches
from sparkseek.llm.words import PLACES, U64, mix, pieces, shingle_sets

BANDS, ROWS = 40, 5
#: Members up to which a bucket is opened by pairs; members of a part of a larger bucket, and askers that meet a part in one task.
FEW = 8
PART_MEMBERS = 512
PART_ASKERS = 512

DRAWS = 0x9E3779B97F4A7C15
EMPTY = U64(0xFFFFFFFFFFFFFFFF)
LOW = U64(0xFFFFFFFF)
HALF = U64(32)
SCAN_SCHEMA = "doc_id long, n int, f long, g long, bands array<long>"


def signatures(elements: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash signature of each set; a set's elements are 64-bit hashes from one of `begins` to the next.

    A value holds the rank in its high 32 bits and a draw below, which stands for the fraction. An empty set has EMPTY everywhere.
    """
    sets = len(begins) - 1
    found = np.full(sets * size, EMPTY, U64)
    owner = np.repeat(np.arange(sets), np.diff(begins))
    places = None
    for rank in range(size):
        draw = mix(elements + U64((rank + 1) * DRAWS % (1 << 64)))
        at = rank + (((draw >> HALF) * U64(size - rank)) >> HALF).astype(np.int64)
        each = np.arange(len(elements))
        if places is None:
            place = at
        else:
            place = places[each, at].astype(np.int64)
            places[each, at] = places[:, rank]
        np.minimum.at(found, owner * size + place, (U64(rank) << HALF) | (draw & LOW))
        open_ = (found.reshape(sets, size) == EMPTY).any(axis=1)[owner]
        if not open_.any():
            break
        elements, owner, at = elements[open_], owner[open_], at[open_]
        if places is None:
            places = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
            places[np.arange(len(elements)), at] = 0
        else:
            places = places[open_]
    return found.reshape(sets, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    return mix((parts * PLACES[:rows]).sum(axis=2, dtype=U64) + PLACES[8] * np.arange(1, bands + 1, dtype=U64))


def _scan(words: int, bands: int, rows: int):
    """One row a text: the size and two checksums of its set, and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = list(shingle_sets(piece.column("text"), words))
                n = np.array([len(s) for s in sets], np.int32)
                begins = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                keys = band_keys(signatures(np.concatenate([*sets, np.zeros(0, U64)]), begins, bands * rows), bands, rows)
                f = np.array([s.sum(dtype=U64) for s in sets], U64)
                g = np.array([mix(s ^ U64(0x5C5C5C5C5C5C5C5C)).sum(dtype=U64) for s in sets], U64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n", "f", "g", "bands"],
                )

    return run


def _sets(words: int, slots: int, bits):
    """The whole sets of the texts whose ids pass the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            slot = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64) & (slots - 1)
            for piece in pieces(batch.filter(pa.array(passing(bits.value, slot), pa.bool_()))):
                rows = [s.tobytes() for s in shingle_sets(piece.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary())], names=["class_id", "tokens"]
                )

    return run


def _whole_sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(class_id, tokens) of the texts with these ids, and a few others. Only their sets leave the scan."""
    ids = ids.distinct()
    slots = slots_for(ids.count())
    bits = texts.sparkSession.sparkContext.broadcast(bit_table(ids, ids.columns[0], slots))
    return texts.mapInArrow(_sets(words, slots, bits), "class_id long, tokens binary")


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


def verified(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    sets = _whole_sets(texts, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")), words)
    return (
        pairs.join(sets.select(F.col("class_id").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("class_id").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_similar(percent), "a long, b long")
    )


def _met(percent: int):
    """One link from each asker to each other component of a part's members that has a similar enough set."""

    def run(askers: pa.Table, members: pa.Table) -> pa.Table:
        links: set[tuple[int, int]] = set()
        if askers.num_rows and members.num_rows:
            sets = [np.frombuffer(t.as_buffer(), U64) for t in members["tokens"]]
            sizes = np.array([len(s) for s in sets])
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            theirs = members["component"].to_numpy()
            for own, binary in zip(askers["component"].to_pylist(), askers["tokens"], strict=True):
                mine = np.frombuffer(binary.as_buffer(), U64)
                low, high = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, side="right")
                many = high - low
                places = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both = np.bincount(owner[places], minlength=len(sets))
                similar = 100 * both >= percent * (len(mine) + sizes - both)
                links |= {(own, int(c)) for c in np.unique(theirs[similar]) if c != own}
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _opened(texts: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the buckets of `placed` (key, class_id, component, asks), each part in one task a share of askers."""
    sized = placed.groupBy("key").agg(
        F.ceil(F.count("*") / PART_MEMBERS).cast("int").alias("parts"),
        F.ceil(F.sum(F.col("asks").cast("int")) / PART_ASKERS).cast("int").alias("shares"),
    )
    known = placed.join(sized, "key")
    part, share = (F.pmod(F.xxhash64("class_id", F.lit(c)), c).cast("int") for c in ("parts", "shares"))
    each = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(n) for c, n in (("parts", "part"), ("shares", "share"))]
    askers = cut(known.filter("asks").select("key", "class_id", "component", share.alias("share"), each[0]))
    members = cut(known.select("key", "class_id", "component", part.alias("part"), each[1]))
    sets = _whole_sets(texts, members.select("class_id"), words).dropDuplicates(["class_id"])
    keys = ["key", "part", "share"]
    sides = [
        side.join(sets, "class_id").select(*[F.col(c).alias(c) for c in [*keys, "component", "tokens"]]).groupBy(*keys)
        for side in (askers, members)
    ]
    return sides[0].cogroup(sides[1]).applyInArrow(_met(percent), "a long, b long")


def near_duplicates(
    documents: DataFrame,
    words: int = 4,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id, component_id, kept.

    Two documents link when their sets of distinct `words`-word shingles have a Jaccard similarity of at least `percent` / 100;
    `bands` and `rows` must suit it. class_id is the smallest id of the same set, component_id the smallest id that links reach, and kept
    says that this is the document's own id. A text with fewer words is one shingle; a null or empty one, or one without words, has 0
    and links with nothing. Ids should be unique: of rows with the same id one is returned for each, and they are one document if their
    texts agree. Rows with a null id come back with null class, component and kept. Other columns are ignored; an empty table gives an
    empty result. A task holds one text, its shingles and, of a set of less than about `20 * bands * rows` shingles, their permutations.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scan = cut(small_batches(texts).mapInArrow(_scan(words, bands, rows), SCAN_SCHEMA))
    classes = cut(
        scan.filter("n > 0 and doc_id is not null")
        .groupBy("n", "f", "g")
        .agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"))
    )
    similar_size = "least(n, m) * 100 >= greatest(n, m) * " + str(percent)

    # Buckets of several classes, with the smallest class of each.
    banded = classes.select("class_id", "n", F.explode("bands").alias("key"))
    first = (
        banded.groupBy("key")
        .agg(F.min(F.struct("class_id", "n")).alias("first"), F.count("*").alias("members"))
        .filter("members > 1")
        .select("key", F.col("first.class_id").alias("a"), F.col("first.n").alias("m"))
    )
    buckets = cut(banded.join(first, "key"))
    stars = buckets.filter("class_id <> a").filter(similar_size).select("a", F.col("class_id").alias("b")).distinct()
    links = cut(verified(texts, cut(stars), words, percent))
    linked = components(links).withColumnRenamed("id", "class_id")

    # Buckets of several components. Those with the same largest component are opened together: they share most members.
    placed = cut(buckets.select("key", "class_id", "n").join(linked, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    several = (
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("held"))
        .groupBy("key")
        .agg(F.max(F.struct("held", "component")).alias("largest"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("key", F.col("largest.component").alias("main"))
    )
    grouped = placed.join(several, "key").select(F.col("main").alias("key"), "class_id", "n", "component").distinct()
    opened = cut(grouped.withColumn("asks", F.col("component") != F.col("key")))
    opened = opened.join(opened.groupBy("key").agg(F.count("*").alias("held")), "key")
    small = opened.filter(F.col("held") <= FEW)
    pairs = (
        small.join(small.select("key", F.col("class_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other")), "key")
        .filter("class_id < b and component <> other")
        .filter(similar_size)
        .select(F.col("class_id").alias("a"), "b")
        .distinct()
    )
    few = cut(verified(texts, cut(pairs), words, percent))
    many = cut(_opened(texts, opened.filter(F.col("held") > FEW), words, percent))
    own = classes.join(linked, "class_id", "left").select(F.col("class_id").alias("a"), F.coalesce("component", "class_id").alias("b"))
    found = components(own.unionAll(few).unionAll(many)).withColumnRenamed("id", "class_id")

    named = classes.select("n", "f", "g", "class_id").join(found, "class_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return scan.drop("bands").join(named, ["n", "f", "g"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )

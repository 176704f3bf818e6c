"""How the sources of each language differ in their words: an audit of all pairs of sources, and of each source's own words.

The counts of a source are the leaves of a segment tree over the language's term ids; an inner node is named by its two
children, so equal subtrees of counts, of any source, are one node (hash-consing). Two sources are priced by walking both trees
at once from their roots; a pair of nodes that is met again is priced once.

1. Terms are counted within each task and shuffled once by (language, term): a row for each term and share of a task, which holds
   the counts of all its sources. A term that every text has is so many rows as there are shares, however many documents there are.
2. The ids of a language are cut into segments of about `SEGMENT_TERMS` terms by a hash of the term, and its sources into blocks
   of about `BLOCK_SOURCES`. A task builds the trees of one segment for the sources of two blocks. The top of a tree, above the segments, is a
   plain sum, so a language with a third of all rows is many tasks.
3. Sums of the segments are ranked by source.

Probabilities are integers, p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); a term is worth floor((p - q)**2 / (p + q)).
All of it is exact as long as a language has fewer than 9 * 10**15 occurrences; while they are counted, terms go by 64-bit hashes, of
which two agree with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.llm.shared import new_folder, small_batches
from sparkseek.llm.words import LOWER, U64, flat, mix, pieces, span_hashes, word_spans

#: Terms are runs of letters A-Z, a-z and of all code points from U+0080 on; in UTF-8, those are the bytes from 0x80 on.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TURN = U64(0xA24BAED4963EE407)
#: A language keeps the terms of at least so many of its documents.
LEAST_DOCUMENTS = 10
#: Terms that are reported of each source.
TOP_TERMS = 10
SCALE = 1_000_000_000
SMOOTHING = 2
SEGMENT_TERMS = 4_096
BLOCK_SOURCES = 32
SALTS = 64
#: Counts that a task gathers before it passes them on, and terms of a batch.
GATHERED = 1_500_000
SHOWN_AT_ONCE = 20_000
#: The leaf beyond the last term of a segment.
NO_TERM = -1

COUNT_SCHEMA = "lang string, term string, docs long, sources array<string>, counts array<long>"
ROW_SCHEMA = "lang string, source string, part string, item string, value long"


class _Terms:
    """Counts of (group, term) that a task has gathered, with the bytes of each term; terms go by 64-bit hashes."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.texts: list[pa.Array] = []
        self.rows = 0

    def add(self, piece: pa.RecordBatch) -> None:
        data, begins = flat(piece.column("text"))
        data = np.where(TERM_BYTE[data], LOWER[data], np.uint8(0x20))
        starts, ends, firsts = word_spans(data, begins)
        places = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in places], np.int64)
        hashes = span_hashes(data, starts, ends)
        doc = np.repeat(np.arange(len(begins) - 1), np.diff(firsts))
        # Different terms of each document, then of each group.
        _, first, n = np.unique(mix(hashes + doc.astype(U64) * TURN), return_index=True, return_counts=True)
        group, hashes = group[doc[first]], hashes[first]
        _, at, which = np.unique(mix(hashes + group.astype(U64) * TURN), return_index=True, return_inverse=True)
        size = (ends - starts)[first[at]]
        upto = np.cumsum(size)
        letters = data[np.repeat(starts[first[at]] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        offsets = pa.py_buffer(np.r_[0, upto].astype(np.int64).tobytes())
        self.texts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(letters.tobytes())]))
        self.held.append((group[at], hashes[at], np.bincount(which, weights=n).astype(np.int64), np.bincount(which)))
        self.rows += len(at)

    def shown(self) -> Iterator[pa.RecordBatch]:
        """(lang, term, docs, sources, counts) of what is held, which is then forgotten."""
        if self.rows:
            group, hashes, n, docs = (np.concatenate(x) for x in zip(*self.held, strict=True))
            _, at, which = np.unique(mix(hashes + group.astype(U64) * TURN), return_index=True, return_inverse=True)
            n, docs = (np.bincount(which, weights=x).astype(np.int64) for x in (n, docs))
            names = list(self.groups)
            langs: dict[str, int] = {}
            lang_of = np.array([langs.setdefault(lang, len(langs)) for lang, _ in names])
            group, lang = group[at], lang_of[group[at]]
            order = np.lexsort((hashes[at], lang))
            first = np.flatnonzero(np.r_[True, (np.diff(lang[order]) != 0) | (np.diff(hashes[at][order]) != 0)])
            sources = pa.array([source for _, source in names], pa.string()).take(pa.array(group[order]))
            texts = pa.chunked_array(self.texts).combine_chunks()
            offsets = np.r_[first, len(order)].astype(np.int32)
            columns = [
                pa.array(list(langs), pa.string()).take(pa.array(lang[order][first])),
                texts.take(pa.array(at[order][first])).cast(pa.large_string()).cast(pa.string()),
                pa.array(np.add.reduceat(docs[order], first)),
                pa.ListArray.from_arrays(pa.array(offsets), sources),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(n[order])),
            ]
            whole = pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "sources", "counts"])
            for begin in range(0, whole.num_rows, SHOWN_AT_ONCE):
                yield whole.slice(begin, SHOWN_AT_ONCE)
        self.__init__()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs, sources, counts) of the texts of a task, in shares of bounded size."""
    terms = _Terms()
    for batch in batches:
        for piece in pieces(batch):
            terms.add(piece)
            if terms.rows >= GATHERED:
                yield from terms.shown()
    yield from terms.shown()


def kept_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, source, n, total, leading) of the terms that their language keeps; leading marks one row of each term."""
    rows = small_batches(texts).mapInArrow(_counted, COUNT_SCHEMA).repartition("lang", "term")
    each = rows.select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("place", "at"))
    counts = each.groupBy("lang", "term", F.col("at.sources").alias("source")).agg(
        F.sum("at.counts").alias("n"), F.sum(F.when(F.col("place") == 0, F.col("docs")).otherwise(0)).alias("docs")
    )
    term = Window.partitionBy("lang", "term")
    return (
        counts.withColumns(
            {
                "all_docs": F.sum("docs").over(term),
                "total": F.sum("n").over(term),
                "leading": F.min("source").over(term) == F.col("source"),
            }
        )
        .filter(F.col("all_docs") >= LEAST_DOCUMENTS)
        .select("lang", "term", "source", "n", "total", "leading")
    )


def probability(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / whole), by long division in three steps."""
    rest, result = count + SMOOTHING, np.zeros(np.broadcast_shapes(np.shape(count), np.shape(whole)), np.int64)
    for _ in range(3):
        rest = rest * 1000
        result = result * 1000 + rest // whole
        rest = rest % whole
    return result + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Trees:
    """Segment trees over the rows of a table of counts, in which equal subtrees are one node."""

    def __init__(self, counts: np.ndarray):
        width = 1
        while width < counts.shape[1]:
            width *= 2
        leaves = np.full((len(counts), width), NO_TERM, np.int64)
        leaves[:, : counts.shape[1]] = counts
        self.leaves, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(leaves.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            many = int(nodes.max()) + 1
            made, named = np.unique(nodes[:, ::2] * many + nodes[:, 1::2], return_inverse=True)
            nodes = named.reshape(len(counts), -1)
            self.children.append((made // many, made % many))
        self.roots = nodes[:, 0]

    def priced(self, one: int, others: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """What the terms of tree `one` and each other tree are worth together; `whole` has N + 2 * V of each tree."""
        which, a, b = np.arange(len(others)), np.full(len(others), self.roots[one]), self.roots[others]
        ways = []
        for left, right in reversed(self.children):
            twice = np.concatenate([which, which])
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            many = int(max(a.max(), b.max())) + 1
            met, again = np.unique((twice * many + a) * many + b, return_inverse=True)
            ways.append((again[: len(which)], again[len(which) :]))
            which, a, b = met // many // many, met // many % many, met % many
        x, y = self.leaves[a], self.leaves[b]
        value = np.where(x == NO_TERM, 0, price(probability(x, whole[one]), probability(y, whole[others[which]])))
        for left, right in reversed(ways):
            value = value[left] + value[right]
        return value


def _own_terms(counts: np.ndarray, totals: np.ndarray, terms: list[str], whole: int, whole_lang: int) -> list[tuple[str, int]]:
    """The terms of a segment by which a source stands out most from its language."""
    at = np.flatnonzero(counts > 0)
    p, q = probability(counts[at], whole), probability(totals[at], whole_lang)
    at, value = at[p > q], price(p, q)[p > q]
    if len(value) > TOP_TERMS:
        best = value >= np.partition(value, len(value) - TOP_TERMS)[-TOP_TERMS]
        at, value = at[best], value[best]
    found = sorted(zip(value.tolist(), (terms[i] for i in at), strict=True), key=lambda x: (-x[0], x[1].encode()))
    return [(term, v) for v, term in found[:TOP_TERMS]]


def _audited(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums of one segment for the pairs of two blocks of sources, and the terms of each source of a block met with itself."""
    lang, _, first, second = (k.as_py() for k in key)
    marks = rows.filter(pc.is_null(rows["term"]))
    cells = rows.filter(pc.is_valid(rows["term"]))
    sources = marks["source"].to_pylist()
    block = marks["block"].to_numpy()
    v, width, n_lang = (marks[c][0].as_py() for c in ("v", "width", "total"))
    whole = np.maximum(marks["n"].to_numpy() + SMOOTHING * v, 1)
    ids = cells["term"].combine_chunks().dictionary_encode() if cells.num_rows else None
    terms = ids.dictionary.to_pylist() if ids is not None else []
    counts = np.zeros((len(sources), width), np.int64)
    totals = np.zeros(width, np.int64)
    if ids is not None:
        at = ids.indices.to_numpy()
        place = {s: i for i, s in enumerate(sources)}
        counts[[place[s] for s in cells["source"].to_pylist()], at] = cells["n"].to_numpy()
        totals[at] = cells["total"].to_numpy()
    trees = Trees(counts)
    found: list[tuple[str, str, str, int]] = []
    for i, source in enumerate(sources):
        if first == second:
            others = np.arange(i + 1, len(sources))
            own = _own_terms(counts[i], totals, terms, int(whole[i]), max(n_lang + SMOOTHING * v, 1))
            found += [(source, "term", term, value) for term, value in own]
        else:
            others = np.flatnonzero(block == second) if block[i] == first else np.zeros(0, np.int64)
        if len(others):
            for j, value in zip(others.tolist(), trees.priced(i, others, whole).tolist(), strict=True):
                found += [(source, "pair", sources[j], value), (sources[j], "pair", source, value)]
    columns = list(zip(*found, strict=True)) if found else [[]] * 4
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table(
        [pa.array([lang] * len(found), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
        names=["lang", "source", "part", "item", "value"],
    )


def audit(
    documents: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by which terms.

    Part `pair` has each other source of the language, with the sum over all kept terms (0 if none is kept); part `term` the
    `TOP_TERMS` terms in which a source is most above its language. Ranks go from 1, by falling value, then item.
    Null text, lang and source are empty; sources without terms take part. A repeated row counts each time. A text is held in
    memory whole, with its distinct terms. Other columns are ignored. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    texts = documents.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))]
    )
    folder = new_folder(spark, "term-counts")
    kept_counts(texts).write.parquet(folder)
    kept = spark.read.parquet(folder)

    groups = texts.select("lang", "source").distinct().join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left"
    )
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = kept.groupBy("lang").agg(F.sum(F.col("leading").cast("long")).alias("v"))
    langs = (
        groups.groupBy("lang")
        .agg(F.sum("n").alias("total"), F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
        .join(sizes, "lang", "left")
        .select("lang", "total", "blocks", F.coalesce("v", F.lit(0)).alias("v"))
        .withColumn("segments", F.greatest(F.lit(1), F.ceil(F.col("v") / SEGMENT_TERMS)).cast("int"))
    )
    # Terms meet their language's numbers in `SALTS` shares, so that a large language is not one task's.
    salted = langs.drop("total").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = kept.withColumn("salt", F.pmod(F.xxhash64("term", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    segment = F.pmod(F.xxhash64("term"), F.col("segments")).cast("int")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    shown = ["lang", "segment", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
             "block", "source", "term", "n", "total", "v", "width"]
    none = F.lit(0).cast("long")
    cells = (
        sized.select("lang", segment.alias("segment"), block.alias("block"), "source", "term", "n", "total", none.alias("v"), none.alias("width"), other)
        .select(*shown)
    )
    widths = (
        sized.filter("leading")
        .groupBy("lang", segment.alias("segment"))
        .agg(F.count("*").alias("width"))
    )
    marks = (
        groups.join(langs, "lang")
        .withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
        .join(widths, ["lang", "segment"], "left")
        .withColumn("width", F.coalesce("width", F.lit(0)))
        .select("lang", "segment", block.alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "total", "v", "width", other)
        .select(*shown)
    )
    found = cells.unionByName(marks).groupBy("lang", "segment", "first", "second").applyInArrow(_audited, ROW_SCHEMA)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))

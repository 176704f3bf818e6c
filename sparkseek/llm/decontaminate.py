"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question with other parameters
has the same template. Windows of five template words are joined by hash with the benchmark's; a document
that holds enough of an item's windows is reported if the values in the placeholders agree: within
one alignment of the two texts, each value of the item must always stand for the same value of the document.

Which words are names depends on their letter case and on what stands before them. So a window is also held
if its lowered words are the same, whatever they were taken for. A window with fewer than two literal words
says little as a template; it is compared with its values alone.

An item of three or four words is one window of its own length. A shorter one is only found in a document
that consists of it.

Only documents' windows that pass a filter of fixed size, made of the benchmark's windows, leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.shared import FILTER_SLOTS, cut, passing, small_batches
from sparkseek.llm.words import LOWER, U64, flat, mix, pieces, shingle_hashes, span_hashes, word_spans

#: Words of a window, and of the shortest items that are looked for within documents.
WINDOW = 5
LEAST_WORDS = 3
#: The share of an item's windows that a document must hold, and the share of slots that must agree.
LEAST_COVERAGE = 0.8
LEAST_CONSISTENCY = 0.8
#: Literal words of a window that is compared as a template.
LEAST_LITERAL = 2

#: Words that are units after a number.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "meters", "metres", "kilometers", "kilometres", "inches", "feet", "miles",
    "mg", "g", "kg", "grams", "kilograms", "pounds", "tons", "ml", "l", "liters", "litres", "gallons",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "usd", "eur",
    "mph", "kmh", "degrees", "watts", "volts",
)

LITERAL, NUMBER, NAME, UNIT = range(4)
PLACEHOLDERS = mix(np.arange(5000, 5004, dtype=U64))

ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), ord("%")]] = True
NUMERAL = np.zeros(256, bool)
NUMERAL[0x30:0x3A] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[0x41:0x5B] = True
SMALL = np.zeros(256, bool)
SMALL[0x61:0x7B] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".?!:;|"]] = True

WINDOW_SCHEMA = "id long, place int, size int, window long, hash long, same boolean, slots array<long>"


def _unit_hashes() -> np.ndarray:
    data, begins = flat(pa.array(UNITS, pa.string()))
    return np.sort(span_hashes(data, begins[:-1], begins[1:]))


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals U+00C0 to U+00DE lowered."""
    out = LOWER[data]
    lead = np.r_[False, data[:-1] == 0xC3]
    out[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def template_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind and value of every word, and the index of each text's first word (one more at the end).

    A word's value is the hash of what lies between its first and last letter or digit, lowered; words
    without any are left out. A word that begins with a digit, after a sign or currency, is a number. A
    unit follows a number. A name begins with a capital, goes on with a small letter and does not begin
    its text, line or sentence.
    """
    starts, ends, firsts = word_spans(data, begins)
    at = np.flatnonzero(ALNUM[data])
    count = np.r_[0, np.cumsum(ALNUM[data])]
    kept = np.flatnonzero(count[ends] > count[starts])
    first_of = np.zeros(len(starts) + 1, bool)
    first_of[firsts] = True
    if len(kept) == 0:
        return np.zeros(0, np.int8), np.zeros(0, U64), np.zeros(len(begins), np.int64)
    core_a, core_b = at[count[starts[kept]]], at[count[ends[kept]] - 1] + 1
    values = span_hashes(lower_latin(data), core_a, core_b)

    kind = np.zeros(len(kept), np.int8)
    head = data[core_a]
    number = NUMERAL[head]
    after_number = np.r_[False, number[:-1]] & ~first_of[kept]
    units = _unit_hashes()
    unit = after_number & (units[np.minimum(np.searchsorted(units, values), len(units) - 1)] == values)

    second = data[np.minimum(core_a + 1, len(data) - 1)]
    longer = core_b - core_a > 1
    capital = CAPITAL[head] & longer & (SMALL[second] | (second >= 0x80))
    wide = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    capital |= wide & (core_b - core_a > 2)
    # Whether the word before, of any kind, ends a sentence or a line, or there is none.
    lines = np.r_[0, np.cumsum((data == 0x0A) | (data == 0x0D))]
    before = np.maximum(kept - 1, 0)
    opens = first_of[kept] | STOP[data[ends[before] - 1]] | (lines[starts[kept]] > lines[ends[before]])
    name = capital & ~opens & (core_a == starts[kept])

    kind[name], kind[unit], kind[number] = NAME, UNIT, NUMBER
    return kind, values, np.searchsorted(kept, firsts)


def template_windows(texts: pa.Array, sizes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Of all windows of all texts: the text, the place in it, the first word, the words, the hashes as a template and
    by values; and the kinds and values of all words.

    A text with fewer words is one window, as a whole; a text without words has none. `sizes` asks for windows of
    fewer words besides.
    """
    data, begins = flat(texts)
    kind, values, firsts = template_words(data, begins)
    template = np.where(kind == LITERAL, values, PLACEHOLDERS[kind])
    counts = np.diff(firsts)
    literal = np.r_[0, np.cumsum(kind == LITERAL)]
    parts = []
    for words in (WINDOW, *sizes):
        # Texts of just as many words as a smaller window are windows as a whole, below.
        long = np.flatnonzero(counts >= (words if words == WINDOW else words + 1))
        if len(long) == 0:
            continue
        where = np.concatenate([np.arange(firsts[i], firsts[i + 1] - words + 1) for i in long])
        exact = literal[where + words] - literal[where] < LEAST_LITERAL
        plain = shingle_hashes(values, words)[where]
        owner = np.repeat(long, counts[long] - words + 1)
        hashes = np.where(exact, plain, shingle_hashes(template, words)[where])
        parts.append((owner, where, np.full(len(where), words), hashes, plain))
    for i in np.flatnonzero((counts > 0) & (counts < WINDOW)):
        a, b = firsts[i], firsts[i + 1]
        plain = shingle_hashes(values[a:b], WINDOW)
        hashes = plain if literal[b] - literal[a] < LEAST_LITERAL else shingle_hashes(template[a:b], WINDOW)
        parts.append((np.array([i]), np.array([a]), np.array([b - a]), hashes, plain))
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2]
    owner, where, size, hashes, plain = (np.concatenate(x) for x in zip(*parts, strict=True))
    return owner, where - firsts[owner], where, size, hashes, plain, kind, values


def _windows(bits, sizes: tuple[int, ...] = ()):
    """The windows whose hashes pass the filter (all without one), each with the values of its slots in order.

    A row for each window's hash as a template (`window`), and one for that of its values (`same`) if it is another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                owner, place, where, size, windows, plain, kind, values = template_windows(piece.column("text"), sizes)
                other = np.flatnonzero(plain != windows)
                which = np.r_[np.arange(len(windows)), other]
                hashes, same = np.r_[windows, plain[other]], np.r_[windows == plain, np.ones(len(other), bool)]
                keep = np.arange(len(hashes))
                if bits is not None:
                    keep = np.flatnonzero(passing(bits.value, (hashes % U64(FILTER_SLOTS)).astype(np.int64)))
                which = which[keep]
                slots = [
                    values[a : a + n][kind[a : a + n] != LITERAL].view(np.int64)
                    for a, n in zip(where[which].tolist(), size[which].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id").take(pa.array(owner[which])),
                        pa.array(place[which].astype(np.int32)),
                        pa.array(size[which].astype(np.int32)),
                        pa.array(windows[which].view(np.int64)),
                        pa.array(hashes[keep].view(np.int64)),
                        pa.array(same[keep]),
                        pa.array(slots, pa.list_(pa.int64())),
                    ],
                    names=["id", "place", "size", "window", "hash", "same", "slots"],
                )

    return run


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    least_coverage: float = LEAST_COVERAGE,
    least_consistency: float = LEAST_CONSISTENCY,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, coverage, consistency, reworded.

    coverage is the share of the item's different windows that the document holds, as templates or word by word;
    consistency the share of
    slot values that stand for one value in each alignment, 1 without slots; reworded tells whether a slot
    holds another value than in the item. A null or empty text, or one without letters or digits, holds
    nothing and is held by nothing. A text of fewer than five words is one window, so an item of one or two words is
    found in a document that consists of it; one of three or four words is found anywhere. Rows with a null id are left out; rows that repeat an id are taken
    together. Other columns are ignored; without documents or items there are no rows.
    """
    spark = small_batches(documents).sparkSession
    items = benchmark.filter(F.col(item_column).isNotNull()).select(
        F.col(item_column).cast("long").alias("id"), F.col(item_text_column).alias("text")
    )
    texts = documents.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    asked = cut(items.mapInArrow(_windows(None), WINDOW_SCHEMA).distinct())
    bits = spark.sparkContext.broadcast(_hash_slots(asked))
    short = asked.filter((F.col("size") >= LEAST_WORDS) & (F.col("size") < WINDOW)).select("size").distinct()
    sizes = tuple(sorted(r["size"] for r in short.collect()))
    held = texts.mapInArrow(_windows(bits, sizes), WINDOW_SCHEMA).select(F.col("id").alias("doc_id"), "place", "hash", "slots")
    total = asked.groupBy("id").agg(F.count_distinct("window").alias("windows"))

    wanted = asked.select(
        F.col("id").alias("item_id"), F.col("place").alias("at"), "window", "hash", "same", F.col("slots").alias("asked")
    )
    # Rows of the join are cut before it fans out again: both the shares and the slots are read from them.
    # Where all words are the same, so are the values, whatever the document's words were taken for.
    met = held.join(wanted, "hash").withColumn("slots", F.when(F.col("same"), F.col("asked")).otherwise(F.col("slots")))
    met = cut(met.drop("same", "hash"))
    coverage = (
        met.groupBy("doc_id", "item_id")
        .agg(F.count_distinct("window").alias("found"))
        .join(total.withColumnRenamed("id", "item_id"), "item_id")
        .withColumn("coverage", F.col("found") / F.col("windows"))
        .filter(F.col("coverage") >= least_coverage)
        .select("doc_id", "item_id", "coverage")
    )
    values = met.join(coverage.select("doc_id", "item_id"), ["doc_id", "item_id"]).select(
        "doc_id",
        "item_id",
        (F.col("place") - F.col("at")).alias("shift"),
        F.explode(F.arrays_zip(F.col("asked").alias("theirs"), F.col("slots").alias("ours"))).alias("slot"),
    )
    agreement = (
        values.select("doc_id", "item_id", "shift", "slot.theirs", "slot.ours")
        .distinct()
        .groupBy("doc_id", "item_id", "shift", "theirs")
        .agg(F.count("*").alias("meanings"), F.max((F.col("theirs") != F.col("ours")).cast("int")).alias("other"))
        .groupBy("doc_id", "item_id")
        .agg((F.count("*") / F.sum("meanings")).alias("consistency"), (F.max("other") == 1).alias("reworded"))
    )
    return (
        coverage.join(agreement, ["doc_id", "item_id"], "left")
        .withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
        .withColumn("reworded", F.coalesce("reworded", F.lit(False)))
        .filter(F.col("consistency") >= least_consistency)
    )


def _hash_slots(asked: DataFrame) -> np.ndarray:
    """The filter of the benchmark's windows, by the remainder of the hash: at most FILTER_SLOTS numbers."""
    found = asked.select(F.pmod("hash", F.lit(FILTER_SLOTS)).cast("int").alias("slot"))
    bits = np.zeros(FILTER_SLOTS, bool)
    bits[found.distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits)

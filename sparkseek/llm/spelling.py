"""Spelling variants of a corpus: words one edit apart, and the frequent form that each rare word leads to.

The method is reduced-alphabet generation:

1. The vocabulary is counted over all texts, and each word's letters are hashed to a few symbols (`SYMBOLS`). Words that
   are at most one edit apart have reduced words that are at most one edit apart.
2. The one-edit neighbourhood of each reduced word is generated: over few symbols it is small. Two neighbours are in each
   other's neighbourhood, so each such pair is generated from one end only: a shorter word from the longer, and of two words
   of one length from the one with the smaller symbol. Neighbours are 64-bit hashes, found from running sums over a
   word, so that a word of any length takes room in proportion to its letters.
3. The generated hashes are joined with the reduced vocabulary. A bit table, sized by the vocabulary and of at most
   16 MB, spares the join most of those that no word has.
4. Both ends of what is left are verified on the original strings. Nothing is missed: hashes only add candidates.

A reduced word has at most as many partners as its neighbourhood has members, so no key of the join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.shared import bit_table, cut, passing, slots_for
from sparkseek.llm.words import U64, mix

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the reduced alphabet. More symbols mean larger neighbourhoods and fewer candidates a word.
SYMBOLS = 8
#: Shortest word, and occurrences that it needs.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs so many times as often as its variant, at least.
FORM_FACTOR = 10
#: One occurrence in so many loses a letter (see `thinned`).
THINNED = 31
#: Letters whose neighbourhoods are generated at once.
PIECE_LETTERS = 1 << 16

SYMBOL_VALUES = mix(np.arange(7001, 7001 + 256, dtype=U64)) | U64(1)
BASE = U64(0x9E6C63D0876A9A47)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def thinned(doc_id: F.Column, run: F.Column) -> F.Column:
    """The lower-cased run, without one letter where the checksum of id and run is a multiple of `THINNED`.

    This plants misspellings that anybody can plant again. A null id counts as an empty one.
    """
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (checksum % F.length(run)).cast("int")
    return F.when(
        checksum % THINNED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    ).otherwise(run)


def vocabulary(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", thin: bool = True) -> DataFrame:
    """(word, n) of the words of all texts with `LEAST_LENGTH` letters and `LEAST_COUNT` occurrences or more.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lowered. `thin` plants variants.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    runs = documents.select(
        F.col(id_column).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run")
    )
    runs = runs.filter(F.length("run") >= LEAST_LENGTH)
    run = F.translate("run", UPPER, LOWER)
    words = runs.select((thinned(F.col("doc_id"), run) if thin else run).alias("word"))
    counted = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def symbols_of(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words one after the other, and where each word begins (one more at the end)."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=begins[1:])
    return (letters % symbols).astype(np.int64), begins


def neighbourhoods(found: np.ndarray, begins: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each reduced word; of all generated neighbours, the index of their word and their hash.

    Generated are the word itself, each different word with one symbol left out, and each with one symbol replaced by a larger one.
    """
    lengths = np.diff(begins)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    powers = np.full(max(int(lengths.max(initial=0)), 1), BASE, U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U64)[np.arange(len(found)) - begins[owner]]
    sums = np.zeros(len(found) + 1, U64)
    np.cumsum(SYMBOL_VALUES[found] * powers, out=sums[1:])
    first, end = sums[begins[:-1]], sums[begins[1:]]
    whole = end - first
    # In a run of one symbol, leaving out any gives the same word.
    repeats = np.zeros(len(found), bool)
    repeats[1:] = (found[1:] == found[:-1]) & (owner[1:] == owner[:-1])
    at = np.flatnonzero(~repeats)
    shorter = (sums[at] - first[owner[at]]) + (end[owner[at]] - sums[at + 1]) * INVERSE
    owners, hashes = [np.arange(len(lengths)), owner[at]], [whole, shorter]
    for symbol in range(1, symbols):
        at = np.flatnonzero(found < symbol)
        owners.append(owner[at])
        hashes.append(whole[owner[at]] + (SYMBOL_VALUES[symbol] - SYMBOL_VALUES[found[at]]) * powers[at])
    return mix(whole).view(np.int64), np.concatenate(owners), mix(np.concatenate(hashes)).view(np.int64)


def _in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lengths = np.cumsum([len(w) for w in batch.column("word").to_pylist()])
    first = 0
    while first < batch.num_rows:
        before = lengths[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(lengths, before + PIECE_LETTERS, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _reduced(symbols: int):
    """The words with the hash of their reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _in_pieces(batch):
                found, begins = symbols_of(piece.column("word").to_pylist(), symbols)
                keys, _, _ = neighbourhoods(found, begins, 0)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(keys)], names=[*piece.schema.names, "key"])

    return run


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys.view(U64) & U64(slots - 1)).astype(np.int64)


def _generated(symbols: int, slots: int, bits):
    """(key, other): the neighbours of each reduced word that the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _in_pieces(batch):
                found, begins = symbols_of(piece.column("word").to_pylist(), symbols)
                keys, owners, others = neighbourhoods(found, begins, symbols)
                known = passing(bits.value, _slot(others, slots))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[owners[known]]), pa.array(others[known])], names=["key", "other"]
                )

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced, in time in proportion to the letters."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _verified(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(map(one_edit, a.to_pylist(), b.to_pylist()), pa.bool_())


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): each two words (columns word, n) that differ by one inserted, deleted or replaced code point, once."""
    spark = words.sparkSession
    reduced = cut(words.select("word", "n").mapInArrow(_reduced(symbols), "word string, n long, key long"))
    each = reduced.groupBy("key").agg(F.min("word").alias("word"))
    slots = slots_for(reduced.count())
    bits = spark.sparkContext.broadcast(bit_table(each, "key", slots))
    generated = each.select("word").mapInArrow(_generated(symbols, slots, bits), "key long, other long")
    others = reduced.select(F.col("key").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return (
        generated.join(others, "other")
        .join(reduced, "key")
        .filter("key <> other or word < near")
        .filter(F.arrow_udf(_verified, "boolean")("word", "near"))
        .select("word", "n", "near", "near_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles how far a word has followed its forms.

    A form occurs several times as often as its word, so no chain is longer than some twenty and there is no circle.
    """
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = state.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("on")
        )
        moved = cut(moved)
        state = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            return state


def spelling_forms(words: DataFrame, symbols: int = SYMBOLS, factor: int = FORM_FACTOR) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    `words` has distinct words and their counts n. n_near counts the words one edit away; the form is the one of those with the largest
    n (of equal ones the first in code-point order) if it occurs `factor` times as often as the word, else null. root is what the forms
    lead to in the end, the word itself if it has none. Other columns are ignored, null words dropped. An empty table gives an empty one.
    """
    words = cut(words.filter("word is not null").select("word", "n"))
    pairs = near_words(words, symbols)
    ends = F.explode(
        F.array(
            F.struct("word", "near", F.col("near_n").alias("near_n")),
            F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
    )
    best = (
        pairs.select(ends.alias("end"))
        .select("end.*")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    )
    joined = words.join(best, "word", "left")
    good = -F.col("best.rank") >= F.col("n") * factor
    found = joined.select(
        "word",
        F.when(good, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, -F.col("best.rank")).alias("form_n"),
    )
    found = cut(found)
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`spelling_forms` of the thinned `vocabulary` of all texts.

    A null or empty text has no words. Rows with the same id and text count as often as they are there. Other columns are ignored.
    """
    return spelling_forms(vocabulary(documents, id_column, text_column))

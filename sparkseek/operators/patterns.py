"""A table of wildcard patterns against a table of texts, narrowed by the letters that patterns hold.

A text matches a pattern only if it holds every run of plain letters of it. Each pattern is therefore looked for by one gram: up to three
neighbouring bytes of its lower-cased letters, the one that fewest texts hold. Texts give the grams that some pattern is looked for
by, the two meet in a join, and what is left is tried as ``ilike`` does, a text with the list of its candidates. A pattern without three letters in a row goes by two or one, and one of
wildcards alone by the gram that every text has.

There are under 17 million grams, so a bit table of all of them is 2 MB whatever the tables hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import filters

#: Codes: 0 stands for every text, then single bytes, pairs and triples.
SINGLE, PAIR, TRIPLE = 1, 1 + (1 << 8), 1 + (1 << 8) + (1 << 16)
GRAMS = TRIPLE + (1 << 24)
#: Bytes of text whose grams are taken at once.
PIECE_BYTES = 1 << 20
#: Patterns that are tried on a text in one row.
LIST_PATTERNS = 1_000

_PARTS = re.compile(rb"\\(.)|([%_])|([^\\%_]+)|(\\)", re.DOTALL)


def pattern_grams(pattern: bytes) -> list[int]:
    """Codes of the grams that a text must hold to match; the longest that the pattern has."""
    runs, run = [], b""
    for escaped, wild, plain, lone in _PARTS.findall(pattern):
        if wild:
            runs, run = [*runs, run], b""
        else:
            run += escaped or plain or lone
    found: set[int] = {0}
    for x in (np.frombuffer(r, np.uint8).astype(np.int64) for r in [*runs, run]):
        if len(x) >= 3:
            found |= set((TRIPLE + (x[:-2] << 16) + (x[1:-1] << 8) + x[2:]).tolist())
        elif len(x) == 2:
            found.add(PAIR + int(x[0] << 8) + int(x[1]))
        elif len(x) == 1:
            found.add(SINGLE + int(x[0]))
    for least in (TRIPLE, PAIR, SINGLE):
        if longest := [g for g in found if g >= least]:
            return sorted(longest)
    return [0]


def _text_grams(texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, gram) for the different grams of each text that are wanted (a table of bits), in that order; of null none."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    begins = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    x = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[begins[0] : begins[-1]].astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
    given = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False) & bool(wanted[0] & 1))
    pairs = [given * GRAMS]
    for size, first in ((1, SINGLE), (2, PAIR), (3, TRIPLE)):
        n = max(len(x) - size + 1, 0)
        code = np.full(n, first, np.int32)
        for place in range(size):
            code += x[place : n + place] << (8 * (size - 1 - place))
        keep = np.flatnonzero(wanted[code >> 3] >> (code & 7) & 1)
        keep = keep[owner[keep] == owner[keep + size - 1]]
        pairs.append(owner[keep].astype(np.int64) * GRAMS + code[keep])
    found = np.unique(np.concatenate(pairs))
    return found // GRAMS, found % GRAMS


def _pieces(lowered: pa.Array) -> Iterator[tuple[int, int]]:
    """Neighbouring rows that hold about PIECE_BYTES together, as (first, one after the last)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(lowered), 0).to_numpy())
    first = 0
    while first < len(lowered):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + PIECE_BYTES, side="right")))
        yield first, last
        first = last


def _sent(wanted: DataFrame) -> Broadcast:
    """The grams of the table `wanted` as bits; they are fewer than GRAMS, whatever it holds."""
    bits = np.zeros(GRAMS, bool)
    bits[wanted.select("gram").distinct().toArrow()["gram"].to_numpy()] = True
    return wanted.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))


def _frequency(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, _texts): how many rows of `texts` hold each gram of the table `wanted`, summed up by the batch first."""
    shared = _sent(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_text_grams(batch["lowered"].slice(a, b - a), shared.value)[1] for a, b in _pieces(batch["lowered"])]
            grams, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(counts, pa.int64())], names=["gram", "n"])

    return texts.select("lowered").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("_texts"))


def _grams_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, gram) of every text, for the grams of the table `wanted`."""
    shared = _sent(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _pieces(batch["lowered"]):
                piece = batch.slice(first, last - first)
                owner, grams = _text_grams(piece["lowered"], shared.value)
                yield pa.RecordBatch.from_arrays([piece["digest"].take(pa.array(owner)), pa.array(grams, pa.int32())], names=["digest", "gram"])

    return texts.select("digest", "lowered").mapInArrow(run, "digest binary, gram int")


@lru_cache(maxsize=LIST_PATTERNS)
def matcher(pattern: str) -> Callable[[str], bool]:
    """LIKE of one pattern, its pieces between ``%`` each looked for once from left to right."""
    # A piece is its characters; None stands for any one.
    pieces: list[list[str | None]] = [[]]
    for escaped, wild, plain, lone in _PARTS.findall(pattern.encode()):
        if wild == b"%":
            pieces.append([])
        else:
            pieces[-1] += [None] if wild else (escaped or plain or lone).decode()
    if len(pieces) == 3 and not pieces[0] and not pieces[2] and None not in pieces[1]:
        held = "".join(pieces[1])
        return lambda text: held in text
    first, *others = [re.compile("".join("." if c is None else re.escape(c) for c in x), re.DOTALL) for x in pieces]
    if not others:
        return lambda text: first.fullmatch(text) is not None
    middle, last, length = [x for x in others[:-1] if x.pattern], others[-1], len(pieces[-1])

    def holds(text: str) -> bool:
        found = first.match(text)
        for piece in middle:
            if found is None:
                return False
            found = piece.search(text, found.end())
        return found is not None and len(text) - length >= found.end() and last.match(text, len(text) - length) is not None

    return holds


def _matching(lowered: pa.Array, tried: pa.Array) -> pa.Array:
    """Those of the tried patterns that each text matches."""
    found = [[p for p in some if matcher(p)(text)] for text, some in zip(lowered.to_pylist(), tried.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.string()))


def match_patterns(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, id) for each row of ``values`` (id, value) that a row of ``patterns`` (pattern_id, pattern) matches.

    Patterns are those of the ``contains`` filters: ``*``, ``%`` and ``_`` are wildcards and case does not count. Ids are unique. A
    value or a pattern that repeats is looked at once. Null values and null patterns match nothing.
    """
    keyed = values.filter("value is not null").select("id", F.lower("value").alias("lowered"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("lowered", 256)))
    texts = keyed.groupBy("digest").agg(F.first("lowered").alias("lowered"))
    asked = patterns.filter("pattern is not null").select("pattern_id", F.lower(filters.wildcard_column(F.col("pattern"))).alias("pattern"))
    different = asked.select("pattern").distinct()
    # A text's candidates are tried in lists of about `LIST_PATTERNS` at most.
    lists = different.count() // LIST_PATTERNS + 1

    @F.arrow_udf("array<int>")
    def grams(lowered: pa.Array) -> pa.Array:
        return pa.array([pattern_grams(p.encode()) for p in lowered.to_pylist()], pa.list_(pa.int32()))

    tried = different.withColumn("gram", F.explode(grams("pattern")))
    # A gram that no text has rules its pattern out; it is the rarest.
    rarest = (
        tried.join(_frequency(keyed, tried), "gram", "left")
        .groupBy("pattern")
        .agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "gram")).alias("_rarest"))
        .filter("_rarest.n > 0")
        .select(F.col("_rarest.gram").alias("gram"), "pattern", F.pmod(F.xxhash64("pattern"), F.lit(lists)).alias("list"))
        .localCheckpoint()
    )
    candidates = (
        _grams_of(texts, rarest)
        .join(rarest, "gram")
        .groupBy("digest", "list")
        .agg(F.collect_list("pattern").alias("_tried"))
    )
    matched = candidates.join(texts, "digest").select("digest", F.arrow_udf(_matching, "array<string>")("lowered", "_tried").alias("_found"))
    pairs = matched.join(keyed.select("digest", "id"), "digest").select("id", F.explode("_found").alias("pattern"))
    return pairs.join(asked, "pattern").select("pattern_id", "id")

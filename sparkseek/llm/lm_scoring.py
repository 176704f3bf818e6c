"""Cross-entropy difference of documents under two matched language models.

A target and a background model, both bigram models with Dirichlet smoothing towards their
unigrams, share one vocabulary of 64-bit word hashes. The background's counts are scaled to the target's
total, so that smoothing weighs the same in both. A document's score is the mean over its words of the loss
under the target model less the loss under the background model, in nats: below zero, the document is more
like the target.

All words and pairs of all documents are counted, exactly; two share a hash with a chance of about 2**-64.
Words are counted first, within each task before anything is moved, into a table of Spark that grows with the
corpus. Pairs are counted where documents are scored, in one shuffle: a text sends a row for each of its
different pairs, and the rows of a pair meet. Most pairs occur in one text only. Each task therefore takes that for
granted, and only what differs comes back to the text. Rows are sorted by their key alone, and each task adds up some
ten thousand of them at a time; only the rows that meet by a word are sorted once more there, by their pair.

Two tables of bounded size are looked up within each task: the counts of at most HOT_WORDS words, the most frequent, and those of the
pairs of the most frequent of them, of which no row is moved. Rows of a less frequent word meet by the word instead of the pair, so that
its count is found there too. Two hot words are told by their ranks, which take fewer bytes than a hash. A key of the shuffle is thus a pair with a word that is not among the isqrt(HOT_PAIRS) most
frequent, or a word that is not among HOT_WORDS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.shared import new_folder, small_batches
from sparkseek.llm.words import LOWER, U64, flat, mix, pieces, span_hashes, word_spans

#: Words of the vocabulary at least, seen or not.
WORD_SLOTS = 1 << 18
#: Words, and pairs, whose counts every task is handed at most.
HOT_WORDS = 1 << 20
HOT_PAIRS = 1 << 20
#: Words that a task counts at once.
COUNTED_AT_ONCE = 2_000_000
#: Rows of pairs that a task adds up at once, 32 bytes each; more only where one key has more. Where the scored texts are also counted,
#: no key has more rows than the words counted divided by isqrt(HOT_PAIRS), as a more frequent word's pairs are looked up.
MET_AT_ONCE = 1 << 16
#: Added to each word's count, and the weight of the unigram model in words seen.
WORD_SMOOTHING = 0.1
PAIR_SMOOTHING = 50.0
START = mix(np.array([77], U64))
TURN = U64(0xD6E8FEB86659FD93)
#: What a row of text is for, added up.
TARGET, BACKGROUND, ASKED = 1, 2, 4
#: Where a pair's row holds, above 32 bits of its number in the text: whether it ends the text, the text's roles, its word's rank plus 1.
LAST_BIT, ROLE_BIT, RANK_BIT = 32, 33, 36
#: The key of two hot words is their ranks, so many bits each, which is shorter than a hash; other keys are hashes with HASHED set.
KEY_BITS = 24
HASHED = U64(1 << 63)


@dataclass
class MatchedModels:
    """Counts of words, (word, target, background), and the rows of text that the models are learned from, with their roles.

    words, starts: all words and all documents with a word, by model. The background's counts are not scaled yet.
    """

    counts: DataFrame
    words: tuple[int, int]
    starts: tuple[int, int]
    vocabulary: int
    sources: list[tuple[DataFrame, Column]]
    text_column: str

    @property
    def scales(self) -> tuple[float, float]:
        return 1.0, self.words[0] / self.words[1] if self.words[1] else 1.0

    @property
    def totals(self) -> tuple[float, float]:
        """All words and the smoothing of all words."""
        return tuple(max(n * scale, 1.0) + WORD_SMOOTHING * self.vocabulary for n, scale in zip(self.words, self.scales, strict=True))


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: the hash of the word before (START at a start) and its own; and where texts begin."""
    data, begins = flat(texts)
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, begins)
    hashes = span_hashes(data, starts, ends)
    before = np.r_[START, hashes[:-1]][: len(hashes)]
    before[np.unique(firsts[:-1][np.diff(firsts) > 0])] = START[0]
    return before, hashes, firsts


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * TURN + words)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where neighbours that are alike in all columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _rows(sources: list[tuple[DataFrame, Column]], text_column: str) -> DataFrame:
    made = [small_batches(f).select(F.col(text_column).alias("text"), roles.cast("int").alias("roles")) for f, roles in sources]
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionAll(more)
    return rows


def _counted(rows: DataFrame, keys: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(word, target, background): how often each key occurs. `keys` gives the keys of some words, and which word each is of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def added(found: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.argsort(found)
            found = found[order]
            first = _firsts(found)
            return found[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in counts)

        def merged() -> None:
            held[:] = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def made() -> Iterator[pa.RecordBatch]:
            columns = held.pop()
            for a in range(0, len(columns[0]), 100_000):
                some = [pa.array(x[a : a + 100_000].view(np.int64)) for x in columns]
                yield pa.RecordBatch.from_arrays(some, names=["word", "target", "background"])

        for batch in batches:
            for piece in pieces(batch):
                before, words, firsts = word_pairs(piece.column("text"))
                roles = np.repeat(piece.column("roles").to_numpy(), np.diff(firsts))
                found, of = keys(before, words)
                held.append(added(found, *((roles[of] & role > 0).astype(np.int64) for role in (TARGET, BACKGROUND))))
                size += len(held[-1][0])
                if size >= COUNTED_AT_ONCE:
                    merged()
                    size = len(held[0][0])
                    if size >= COUNTED_AT_ONCE // 2:
                        yield from made()
                        size = 0
        if held:
            merged()
            yield from made()

    counted = rows.mapInArrow(count, "word long, target long, background long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("target", "background")])


def _stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows from Parquet files in the shared folder."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _signed(hashes: np.ndarray) -> int:
    return int(hashes.view(np.int64)[0])


def _words_and_starts(before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(before == START[0])
    return np.r_[words, before[starts]], np.r_[np.arange(len(words)), starts]


def _fit(sources: list[tuple[DataFrame, Column]], text_column: str) -> MatchedModels:
    counts = _stored(_counted(_rows(sources, text_column), _words_and_starts), "lm-words")
    zeros = [F.coalesce(F.sum(c), F.lit(0)) for c in ("target", "background")]
    starts = counts.filter(F.col("word") == _signed(START)).agg(*zeros).first()
    counts = counts.filter(F.col("word") != _signed(START))
    words = counts.agg(*zeros, F.count("*")).first()
    return MatchedModels(counts, tuple(words[:2]), tuple(starts), max(WORD_SLOTS, words[2]), sources, text_column)


def fit(target: DataFrame, background: DataFrame, text_column: str = "text") -> MatchedModels:
    """Both models, each from all documents of its corpus. Null texts count as empty."""
    return _fit([(target, F.lit(TARGET)), (background, F.lit(BACKGROUND))], text_column)


def fit_within(documents: DataFrame, target: Column, text_column: str = "text") -> MatchedModels:
    """The same where the target is a part of the background, told by a condition; null is false. Texts are read once instead of twice."""
    return _fit([(documents, F.when(target, TARGET | BACKGROUND).otherwise(BACKGROUND))], text_column)


def _least_hot(counts: DataFrame) -> int:
    """The smallest count from which on there are at most HOT_WORDS words."""
    sizes = counts.groupBy((F.col("target") + F.col("background")).alias("n")).count().toArrow()
    n, count = (sizes.column(c).to_numpy() for c in ("n", "count"))
    order = np.argsort(-n)
    fits = int(np.searchsorted(np.cumsum(count[order]), HOT_WORDS, side="right"))
    return int(n[order][fits - 1]) if fits else int(n.max(initial=0)) + 1


@dataclass
class Ranks:
    """Hashes in order, and the rank of each by frequency. Hashes spread evenly, so their first bits tell nearly where each is."""

    known: np.ndarray
    ranks: np.ndarray
    begins: np.ndarray

    @staticmethod
    def of(known: np.ndarray, ranks: np.ndarray) -> Ranks:
        bits = max(len(known).bit_length() - 1, 1)
        begins = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((known >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), out=begins[1:])
        return Ranks(known, ranks, begins)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash; -1 if it is not among them."""
        slot = (hashes >> U64(65 - len(self.begins).bit_length())).astype(np.int64)
        found = np.full(len(hashes), -1)
        at, end = self.begins[slot].astype(np.int64), self.begins[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, hashes = at[left], end[left], hashes[left]
        while len(left):
            same = self.known[at] == hashes
            found[left[same]] = self.ranks[at[same]]
            more = np.flatnonzero(~same & (at + 1 < end))
            left, at, end, hashes = left[more], at[more] + 1, end[more], hashes[more]
        return found


def _table(counts: DataFrame, *more: tuple[int, int, int]) -> tuple[Ranks, np.ndarray]:
    """The ranks of hashes by frequency, and the counts in the order of ranks, by model."""
    found = counts.toArrow()
    columns = [np.r_[found.column(c).to_numpy(), np.array([row[i] for row in more], np.int64)] for i, c in enumerate(found.column_names)]
    order = np.lexsort((columns[0], -(columns[1] + columns[2])))
    columns = [x[order] for x in columns]
    ranks = np.argsort(columns[0].view(U64)).astype(np.int32)
    return Ranks.of(columns[0].view(U64)[ranks], ranks), np.stack(columns[1:])


def _whole_keys(batches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Columns of numbers, in the order of the first, in parts of about MET_AT_ONCE that hold each value of the first whole."""
    held, size = [], 0
    for batch in batches:
        if size >= MET_AT_ONCE:
            cut = int(np.searchsorted(batch[0], held[-1][0, -1], side="right"))
            if cut < batch.shape[1]:
                yield np.concatenate([*held, batch[:, :cut]], axis=1)
                held, size, batch = [], 0, batch[:, cut:]
        if batch.shape[1]:
            held.append(batch)
            size += batch.shape[1]
    if held:
        yield np.concatenate(held, axis=1)


def score(documents: DataFrame, models: MatchedModels, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, target_loss, background_loss, difference (nats a word).

    A null or empty text, or one without words, has 0 words and null losses. Texts of any length are scored
    whole, each within one task, as some tens of bytes a character. Repeated rows and null ids are rows of their own; further columns are
    left out; no documents give no rows. When nothing was counted, all words are as likely and the difference is 0.
    """
    spark = small_batches(documents).sparkSession
    seen = F.col("target") + F.col("background")
    known, counts = _table(models.counts.filter(seen >= _least_hot(models.counts)), (_signed(START), *models.starts))
    often = isqrt(HOT_PAIRS)
    frequent = Ranks.of(known.known[known.ranks < often], known.ranks[known.ranks < often])
    among = lambda hashes: frequent.find(hashes) >= 0

    def frequent_pairs(before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(among(words))
        at = at[among(before[at])]
        return pair_hashes(before[at], words[at]), at

    pairs, pair_counts = _table(_counted(_rows(models.sources, models.text_column), frequent_pairs))
    share = spark.sparkContext.broadcast((known, pairs, pair_counts))
    scales, totals = models.scales, models.totals

    def smoothed(model: int, counts: np.ndarray) -> np.ndarray:
        """What the unigram model adds to the count of a pair that ends in a word of such a count."""
        return PAIR_SMOOTHING * (counts * scales[model] + WORD_SMOOTHING) / totals[model]

    tables = spark.sparkContext.broadcast([(smoothed(m, counts[m]), np.log(counts[m] * scales[m] + PAIR_SMOOTHING)) for m in (0, 1)])
    text = pa.struct([("id", pa.int64()), ("n", pa.int64()), ("t", pa.float64()), ("b", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, pair_counts = share.value
        start = int(known.find(START)[0])
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces(batch):
                before, words, firsts = word_pairs(piece.column("text"))
                texts, sizes = len(firsts) - 1, np.diff(firsts)
                owner, row = np.repeat(np.arange(texts), sizes), made + np.arange(texts)
                made += texts
                roles = piece.column("roles").to_numpy().astype(np.int64)
                at = known.find(words)
                at_before = np.r_[start, at[:-1]][: len(at)]
                at_before[firsts[:-1][sizes > 0]] = start
                last = np.zeros(len(words), bool)
                last[firsts[1:][sizes > 0] - 1] = True
                pair = pair_hashes(before, words)
                looked = (at >= 0) & (at < often) & (at_before >= 0) & (at_before < often)
                # The other pairs of each text, once each, in the order of one number: the text, and as many bits of the pair as there is
                # room for. Should two pairs share those, one may be sent in parts, which add up to the same.
                rest = np.flatnonzero(~looked)
                bits = texts.bit_length()
                rest = rest[np.argsort(owner[rest].astype(U64) << U64(64 - bits) | pair[rest] >> U64(bits))]
                first = _firsts(pair[rest], owner[rest])
                n = np.diff(np.r_[first, len(rest)])
                ends = np.add.reduceat(last[rest].astype(np.int64), first) if len(first) else n
                one = rest[first]
                of, hot = owner[one], at[one] >= 0
                # What is known of each text here, as if no other held its other pairs.
                losses, found = [], pairs.find(pair[looked])
                for model, (single, context) in enumerate(tables.value):
                    loss = np.zeros(len(words))
                    follows = at_before >= 0
                    loss[follows] = context[at_before[follows]]
                    both = np.r_[pair_counts[model], 0][found] * scales[model]
                    loss[looked] -= np.log(both + single[at[looked]])
                    own = np.where(roles[of] & (1 << model) > 0, n, 0) * scales[model]
                    loss[one[hot]] -= n[hot] * np.log(own[hot] + single[at[one[hot]]])
                    losses.append(np.bincount(owner, weights=loss, minlength=texts).astype(float))
                asked = np.flatnonzero(roles & ASKED)
                both_hot = hot & (at_before[one] >= 0)
                hashed = np.where(hot, pair[one], words[one]) | HASHED
                key = np.where(both_hot, ((at_before[one] << KEY_BITS) | at[one]).view(U64), hashed)
                what = n | (ends << LAST_BIT) | (roles[of] << ROLE_BIT) | (np.where(both_hot, 0, at[one] + 1) << RANK_BIT)
                about = [piece.column("id").take(pa.array(asked)), pa.array(sizes[asked]), *[pa.array(x[asked]) for x in losses]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[key, mix(row[asked]) | HASHED].view(np.int64)),
                        pa.array(np.r_[row[of], row[asked]]),
                        pa.array(np.r_[what, np.full(len(asked), ASKED << ROLE_BIT)]),
                        pa.array(np.r_[pair[one], np.zeros(len(asked), U64)].view(np.int64), mask=np.r_[hot, np.ones(len(asked), bool)]),
                        pa.concat_arrays([pa.nulls(len(one), text), pa.StructArray.from_arrays(about, fields=list(text))]),
                    ],
                    names=["key", "row", "what", "sub", "text"],
                )

    def corrections(rows: np.ndarray, rare: bool) -> pa.RecordBatch:
        """What the rows of each pair, and of a rare word, change for the texts that are asked for. Equal pairs are neighbours."""
        key, row, what, sub = rows
        n, roles = what & 0xFFFFFFFF, what >> ROLE_BIT
        own = np.stack([np.where(roles & (1 << model) > 0, n, 0) for model in (0, 1)])

        def total(first: np.ndarray) -> np.ndarray:
            return np.repeat(np.add.reduceat(own, first, axis=1), np.diff(np.r_[first, len(key)]), axis=1)

        both = total(_firsts(key, sub))
        out = roles & ASKED > 0 if rare else (roles & ASKED > 0) & (both != own).any(axis=0)
        alone = total(_firsts(key))[:, out] if rare else None
        key, row, what, n, own, both = key[out], row[out], what[out], n[out], own[:, out], both[:, out]
        at = np.where(key >= 0, key & ((1 << KEY_BITS) - 1), (what >> RANK_BIT) - 1)
        losses = []
        for model, (single, _) in enumerate(tables.value):
            scale = scales[model]
            if rare:
                weight = smoothed(model, alone[model])
                loss = (n - (what >> LAST_BIT & 1)) * np.log(alone[model] * scale + PAIR_SMOOTHING)
            else:
                weight = single[at]
                loss = n * np.log(own[model] * scale + weight)
            losses.append(pa.array(loss - n * np.log(both[model] * scale + weight)))
        numbers = [pa.nulls(len(row), pa.int64()), pa.array(np.zeros(len(row), np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(row), *numbers, *losses], names=["row", "id", "n", "t", "b"])

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []

        def numbers() -> Iterator[np.ndarray]:
            for batch in batches:
                about = batch.column("text").is_valid()
                if about.true_count:
                    found = batch.filter(about)
                    columns = [found.column("row"), *found.column("text").flatten()]
                    texts.append(pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "t", "b"]))
                columns = [batch.column(c).fill_null(0).to_numpy() for c in ("key", "row", "what", "sub")]
                yield np.stack(columns)[:, ~about.to_numpy(zero_copy_only=False)]

        for rows in _whole_keys(numbers()):
            yield from texts
            texts.clear()
            key = rows[0]
            new = np.r_[True, key[1:] != key[:-1], True]
            rare = (key < 0) & (rows[2] >> RANK_BIT == 0)
            # A pair that one text holds alone changes nothing.
            yield corrections(rows[:, ~(rare | new[:-1] & new[1:])], False)
            some = rows[:, rare]
            yield corrections(some[:, np.lexsort((some[3], some[0]))], True)
        yield from texts

    own = F.col(id_column).cast("long").alias("id")
    *earlier, (frame, roles) = models.sources
    if text_column == models.text_column and documents.sameSemantics(frame):
        parts = [(f, r, F.lit(None)) for f, r in earlier] + [(documents, roles.bitwiseOR(F.lit(ASKED)), own)]
    else:
        parts = [(f, r, F.lit(None)) for f, r in models.sources] + [(documents, F.lit(ASKED), own)]
    rows = None
    for f, r, i in parts:
        named = text_column if f is documents else models.text_column
        some = f.select(i.cast("long").alias("id"), F.col(named).alias("text"), r.cast("int").alias("roles"))
        rows = some if rows is None else rows.unionAll(some)
    sent = rows.mapInArrow(run, "key long, row long, what long, sub long, text struct<id: long, n: long, t: double, b: double>")
    # One shuffle: a key's rows lie together. Sorting by one long is much cheaper for Spark than by two.
    met = sent.repartition("key").sortWithinPartitions("key")
    back = met.mapInArrow(corrected, "row long, id long, n long, t double, b double")
    sums = back.groupBy("row").agg(F.max("id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n", "t", "b")])
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    out = sums.select("doc_id", F.col("n").alias("n_words"), mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))

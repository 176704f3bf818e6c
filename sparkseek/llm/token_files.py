"""Token ids of whole texts in grammar-compressed files.

A shard holds the ids of consecutive documents, each ended by END_ID. Pairs of neighbouring ids
that are frequent in the shard are replaced by nonterminals, and the result again, until no pair is frequent
any more (Re-Pair, many pairs a round). The shard keeps the rules, the number of ids that each symbol stands
for, and where each document's symbols begin, so one document is decoded without the others.

The files are Parquet, a row a shard, so they can lie wherever Spark reads and writes:

    part, chunk        the shard's place in the order of documents
    doc_ids            one for each document, ascending
    begins             the first symbol of each document, and the number of symbols
    rules              pairs of symbols, 32 bits each; rule r defines symbol base + r
    lengths            ids that each rule's symbol stands for, 32 bits each
    symbols            the compressed ids, `width` bits each
    base, width, ids   ids below base are the tokenizer's; number of ids in the shard

Numbers in binary columns are little-endian and unsigned.

The tokenizer's pre-tokens are cut for a whole column at a time, and each different one is given to
the tokenizer's model once for a task's worker, from a bounded cache. Texts with characters for which that
cut is not plain (see `_plain`), or with an added token of the tokenizer, are encoded by the tokenizer as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.llm.shared import release_memory, small_batches
from sparkseek.llm.words import U64, flat, pieces, span_hashes

END_ID = 2
#: Ids of a shard, about; a document is never divided.
SHARD_IDS = 1_000_000
#: Pairs replaced in one round, and how often a pair occurs at least to be replaced.
RULES_A_ROUND = 5_000
LEAST_COUNT = 16
#: Slots of hashed pairs, 2**PAIR_BITS, that tell which pairs need counting.
PAIR_BITS = 18
#: Pairs that are counted at once.
COUNTED_PAIRS = 1 << 18
#: Pre-tokens that a worker remembers before it starts anew.
CACHED = 400_000
#: Bytes of text that are encoded at once.
ENCODED_AT_ONCE = 512 << 10

FILE_SCHEMA = (
    "part int, chunk int, doc_ids array<long>, begins binary, rules binary, lengths binary, symbols binary, "
    "base long, width int, ids long"
)
FILE = pa.schema(
    [("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("begins", pa.binary()), ("rules", pa.binary()),
     ("lengths", pa.binary()), ("symbols", pa.binary()), ("base", pa.int64()), ("width", pa.int32()), ("ids", pa.int64())]
)

LETTER, DIGIT, OTHER, SPACE = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = LETTER
KIND[[*range(ord("0"), ord("9") + 1)]] = DIGIT
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE


def _plain(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Texts of ASCII and the Latin letters U+00C0 to U+023F alone, without an apostrophe before a letter.

    Of the two-byte characters there, all but U+00D7 and U+00F7 are letters.
    """
    after = np.r_[data[1:], np.uint8(0)]
    odd = (data >= 0xC9) | (data == 0xC2)
    odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
    odd |= (data == ord("'")) & (KIND[after] == LETTER)
    count = np.r_[0, np.cumsum(odd)]
    return count[begins[1:]] == count[begins[:-1]]


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin.

    Runs of letters, of digits and of other characters are pre-tokens, with one blank before them if there
    is one. The rest of a run of white space is one; its last character, if no blank, is one of its own when
    something follows.
    """
    kind = KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    before = np.r_[np.uint8(255), kind[:-1]]
    before[first[:-1]] = 255
    after = np.r_[kind[1:], np.uint8(255)]
    after[first[1:]] = 255
    space, blank_before = kind == SPACE, np.r_[False, data[:-1] == 0x20]
    starts = ~space & (before != kind) & ((before != SPACE) | ~blank_before)
    starts |= space & ((before != SPACE) | ((after != SPACE) & (after != 255)))
    return np.flatnonzero(starts)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(0x100 + rest.index(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts by the tokenizer of a file, the same as its encode_batch gives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: What the library takes out of a text before it is cut.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.letters = byte_letters()
        split = repr(self.tokenizer.pre_tokenizer)
        self.by_parts = (
            self.tokenizer.normalizer is None and all(self.added) and "ByteLevel(add_prefix_space=False" in split and "use_regex=True" in split
        )
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.ids, self.used = np.zeros(0, U64), np.zeros((0, 2), np.int64), [], 0

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.known) + len(hashes) > CACHED:
            self.forget()
        # The bytes of the new pre-tokens one after the other, in the vocabulary's letters.
        ends = np.cumsum(size := ends - starts)
        text = data[np.repeat(starts - (ends - size), size) + np.arange(ends[-1])].tobytes()
        text, tokenize = text.decode("latin-1").translate(self.letters), self.tokenizer.model.tokenize
        found, at, a = [], np.zeros((len(hashes), 2), np.int64), 0
        for b in ends.tolist():
            found.append([t.id for t in tokenize(text[a:b])])
            a = b
        at[:, 1] = [len(x) for x in found]
        at[:, 0] = self.used + np.cumsum(at[:, 1]) - at[:, 1]
        found = list(chain.from_iterable(found))
        self.ids.append(np.array(found, np.int32))
        self.used += len(found)
        order = np.argsort(known := np.r_[self.known, hashes], kind="stable")
        self.known, self.at = known[order], np.r_[self.at, at][order]

    def _by_parts(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = _cuts(data, begins)
        ends = np.r_[starts[1:], len(data)]
        hashes, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        for retry in range(2):
            place = np.searchsorted(self.known, hashes)
            new = np.r_[self.known, U64(0)][place] != hashes if len(self.known) else np.ones(len(hashes), bool)
            new |= place >= len(self.known)
            if not new.any():
                break
            if retry == 0 and len(self.known) + int(new.sum()) > CACHED:
                self.forget()
                new[:] = True
            self._learn(data, hashes[new], starts[first[new]], ends[first[new]])
        place = np.searchsorted(self.known, hashes)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        begin, length = self.at[place][which].T
        counts = np.r_[0, np.cumsum(length)]
        ids = np.concatenate([*self.ids, np.zeros(0, np.int32)])[
            np.repeat(begin - counts[:-1], length) + np.arange(counts[-1])
        ]
        return ids, counts[np.searchsorted(starts, begins)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, END_ID after each text, and where each text's begin."""
        data, begins = flat(texts)
        plain = _plain(data, begins) & self.by_parts
        for content in self.added:
            plain &= ~np.array(pc.fill_null(pc.match_substring(texts, content), False))
        at = np.flatnonzero(~plain)
        whole = {}
        if len(at):
            given = [texts[int(i)].as_py() or "" for i in at]
            encoded = self.tokenizer.encode_batch_fast(given, add_special_tokens=False)
            whole = {int(i): np.array(e.ids, np.int32) for i, e in zip(at, encoded, strict=True)}
        if plain.any():
            kept = np.repeat(plain, np.diff(begins))
            own = np.r_[0, np.cumsum(np.where(plain, np.diff(begins), 0))]
            ids, starts = self._by_parts(data[kept], own)
        else:
            ids, starts = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lengths = np.diff(starts) + 1
        for i, e in whole.items():
            lengths[i] = len(e) + 1
        out_begins = np.r_[0, np.cumsum(lengths)]
        out = np.full(out_begins[-1], END_ID, np.int32)
        own = np.ones(out_begins[-1], bool)
        own[out_begins[1:] - 1] = False
        for i, e in whole.items():
            out[out_begins[i] : out_begins[i + 1] - 1] = e
            own[out_begins[i] : out_begins[i + 1] - 1] = False
        out[own] = ids
        return out, out_begins


def frequent_pairs(left: np.ndarray, right: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all pairs that occur `LEAST_COUNT` times, the index of each one's pair, and the pairs' counts.

    Exact: a slot of hashed pairs holds at least as many as each of its pairs, so smaller slots need no counting, and in most of the
    others all pairs are the same. Only those of mixed slots are sorted.
    """
    slots = 1 << PAIR_BITS
    slot = left * np.uint32(0x9E3779B1)
    slot += right * np.uint32(0x85EBCA6B)
    slot >>= np.uint32(32 - PAIR_BITS)
    total = np.zeros(slots, np.int64)
    for a in range(0, len(slot), COUNTED_PAIRS):  # bincount widens what it is given
        total += np.bincount(slot[a : a + COUNTED_PAIRS][allowed[a : a + COUNTED_PAIRS]], minlength=slots)
    large = total >= LEAST_COUNT
    at = np.flatnonzero(allowed & large[slot])
    slot, pair = slot[at], left[at].astype(U64)
    pair <<= U64(32)
    pair |= right[at]
    holds, mixed = np.zeros(slots, U64), np.zeros(slots, bool)
    holds[slot] = pair
    mixed[slot[holds[slot] != pair]] = True
    several = mixed[slot]
    _, which, counts = np.unique(pair[several], return_inverse=True, return_counts=True)
    often = counts >= LEAST_COUNT
    alone = total[large & ~mixed]
    index = (np.cumsum(large & ~mixed) - 1)[slot]
    index[several] = np.where(often, len(alone) + np.cumsum(often) - 1, -1)[which]
    chosen = index >= 0
    return at[chosen], index[chosen], np.r_[alone, counts[often]]


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs of symbols) and the number of ids that each rule's symbol stands for.

    Rounds go on until no pair occurs `LEAST_COUNT` times. No pair begins with a symbol that ends in END_ID, so none reaches over
    the end of a document.
    """
    symbols = ids.astype(np.uint32)
    rules, lengths = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)]
    made = 0
    every = np.ones(base, np.uint32)
    closes = np.arange(base) == END_ID
    while True:
        left, right = symbols[:-1], symbols[1:]
        matched, which, counts = frequent_pairs(left, right, ~closes[left])
        if len(counts) == 0:
            break
        best = np.argsort(-counts, kind="stable")[:RULES_A_ROUND]
        rule_of = np.full(len(counts), -1, np.int64)
        rule_of[best] = np.arange(len(best))
        matched, rule = matched[rule_of[which] >= 0], rule_of[which[rule_of[which] >= 0]]
        pairs = np.zeros((len(best), 2), np.uint32)
        pairs[rule] = np.stack([left[matched], right[matched]], axis=1)
        # Of pairs that overlap, every other one from the left.
        run = np.flatnonzero(np.r_[True, np.diff(matched) > 1])
        odd = (matched - np.repeat(matched[run], np.diff(np.r_[run, len(matched)]))) & 1
        matched, rule = matched[odd == 0], rule[odd == 0]
        # A pair that always stood second in an overlap gets no rule.
        used = np.bincount(rule, minlength=len(best)) > 0
        rule, pairs = (np.cumsum(used) - 1)[rule], pairs[used]
        rules.append(pairs)
        lengths.append(every[pairs[:, 0]] + every[pairs[:, 1]])
        every, closes = np.r_[every, lengths[-1]], np.r_[closes, closes[pairs[:, 1]]]
        keep = np.ones(len(symbols), bool)
        keep[matched + 1] = False
        symbols = symbols.copy()
        symbols[matched] = (base + made + rule).astype(np.uint32)
        symbols = symbols[keep]
        made += len(pairs)
    return symbols, np.concatenate(rules), np.concatenate(lengths)


def decompress(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    every = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)]
    begin = np.r_[0, np.cumsum(every)]
    table = np.arange(begin[-1], dtype=np.uint32)
    # Rules are in the order in which they were made, so each reads what stands before it.
    for r, (left, right) in enumerate(rules.tolist(), start=base):
        middle = begin[r] + every[left]
        table[begin[r] : middle] = table[begin[left] : begin[left + 1]]
        table[middle : begin[r + 1]] = table[begin[right] : begin[right + 1]]
    size = every[symbols]
    ends = np.cumsum(size)
    return table[np.repeat(begin[symbols] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _shard(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["symbols"], f"<u{row['width'] // 8}"),
        np.frombuffer(row["rules"], "<u4").reshape(-1, 2),
        np.frombuffer(row["lengths"], "<u4"),
        np.frombuffer(row["begins"], "<u4"),
    )


def document_ids(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, the end id included; other documents' symbols and rules are not expanded."""
    symbols, rules, _, begins = _shard(row)
    found, base = symbols[begins[k] : begins[k + 1]].astype(np.uint32), row["base"]
    while (made := found >= base).any():
        size = 1 + made
        first = np.cumsum(size) - size
        wider = np.repeat(found, size)
        pairs = rules[found[made] - base]
        wider[first[made]], wider[first[made] + 1] = pairs[:, 0], pairs[:, 1]
        found = wider
    return found


def write_token_files(documents: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the shards of all documents in ascending order of ids, null first; ties by text.

    A null text is an empty one: its ids are END_ID alone. Repeated rows are separate documents. No
    documents make no shard. `tokenizer` is the path of a tokenizer file on every executor.
    """
    rows = small_batches(documents).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part, chunk = TaskContext.get().partitionId(), 0
        ids, counts, docs, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            every = np.concatenate(ids)
            symbols, rules, lengths = compress(every, encoder.size)
            # No symbol reaches over a document's end, so each document begins with a symbol.
            size = np.r_[np.ones(encoder.size, np.uint32), lengths][symbols]
            before = np.cumsum(size, dtype=np.int64) - size
            begins = np.searchsorted(before, np.r_[0, np.cumsum(np.concatenate(counts))])
            width = 16 if encoder.size + len(rules) <= 1 << 16 else 32
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(
                    (part, chunk, np.concatenate(docs).tolist(), begins.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
                     lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width // 8}").tobytes(), encoder.size, width, len(every)),
                    FILE, strict=True)],
                schema=FILE,
            )

        for batch in batches:
            for piece in pieces(batch, size=ENCODED_AT_ONCE):
                found, begins = encoder.encode(piece.column("text"))
                ids.append(found)
                counts.append(np.diff(begins))
                docs.append(np.array(piece.column("doc_id").to_pylist(), object))
                held += len(found)
                if held >= SHARD_IDS:
                    release_memory()
                    yield shard()
                    chunk += 1
                    ids, counts, docs, held = [], [], [], 0
        if docs:
            release_memory()
            yield shard()
        ids, counts, docs = [], [], []
        release_memory()

    ordered.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept from one task to the next for what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the checksum of the document's ids as
    little-endian unsigned 32-bit integers. Decoded a shard at a time; only narrow rows are moved.
    """
    shards = small_batches(spark.read.schema(FILE_SCHEMA).parquet(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, lengths, begins = _shard(row)
                ids = decompress(symbols, rules, lengths, row["base"])
                size = np.r_[np.ones(row["base"], np.uint32), lengths][symbols]
                at = np.r_[0, np.cumsum(size, dtype=np.int64)][begins]
                raw = memoryview(ids.astype("<u4").tobytes())
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                place = [pa.array(np.full(len(checks), row[c], np.int32)) for c in ("part", "chunk")]
                columns = [pa.array(row["doc_ids"], pa.int64()), *place, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "chunk", "inner", "n_tokens", "ids_crc32"])
        release_memory()

    decoded = shards.mapInArrow(run, "doc_id long, part int, chunk int, inner long, n_tokens long, ids_crc32 long")
    # The sums run over shards, not documents: within a part, then over parts.
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "chunk", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("parts_before"))
    chunks = sizes.withColumn("chunks_before", earlier(Window.partitionBy("part").orderBy("chunk")))
    before = chunks.join(parts, "part").select("part", "chunk", (F.col("parts_before") + F.col("chunks_before")).alias("before"))
    return decoded.join(before, ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")

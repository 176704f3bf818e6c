"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier a bit tells from byte n-grams on which side of
the bit a text's language lies. A text goes to the language whose codeword loses least against the
classifiers' margins, each weighted by how well its classifier does on the sample; the text is
ambiguous when the second language loses about as little.

Each classifier is a log-odds score, averaged over all n-grams of the whole text, with a slope and an
intercept fitted by logistic regression on that average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm.shared import release_memory, small_batches
from sparkseek.llm.words import flat, pieces

UNKNOWN = "und"
#: Lengths of the byte n-grams, and the buckets that they are hashed into.
NGRAMS = (2, 3, 4)
BUCKETS = 1 << 16
#: Labelled texts of each language that the classifiers are fitted on, and languages at most.
SAMPLE_PER_LANGUAGE = 300
MAX_LANGUAGES = 200
#: Bytes of text that are scored at once; each of its n-grams takes a row of the weights.
SCORED_AT_ONCE = 128 << 10
#: Added to every n-gram's count.
SMOOTHING = 0.5
#: Below this difference of probability to the second language, a prediction is ambiguous.
AMBIGUOUS_BELOW = 0.2


@dataclass
class LanguageCodes:
    """languages; codewords of -1 and 1; n-gram weights (bucket, bit); slope, intercept and weight of each bit."""

    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray
    intercepts: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1, far from each other, with no constant, repeated or complementary column.

    Up to 7 languages every distinct division is a bit; beyond, the best of a number of random codes.
    """
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        divisions = np.arange(1, 1 << (n - 1))
        return np.vstack([np.ones(len(divisions)), *[1 - 2 * ((divisions >> i) & 1) for i in range(n - 1)]]).astype(np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    random, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (n, bits))
        code[0] = 1
        agreement = code.astype(np.int32) @ code.T
        np.fill_diagonal(agreement, -bits)
        least = int((bits - agreement.max()) // 2)
        if least > distance and (np.abs(code.sum(axis=0)) < n).all():
            best, distance = code, least
    return best


def ngram_buckets(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the buckets of all n-grams within a text, and the text of each."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    wide = data.astype(np.uint32)
    for n in NGRAMS:
        if len(data) < n:
            continue
        packed = wide[: len(data) - n + 1].copy()
        for i in range(1, n):
            packed = (packed << np.uint32(8)) | wide[i : len(data) - n + 1 + i]
        inside = owner[: len(packed)] == owner[n - 1 :]
        hashed = (packed * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)
        yield (hashed >> np.uint32(16)).astype(np.int64)[inside], owner[: len(packed)][inside]


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def mean_weights(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text, the mean of its n-grams' weights; 0 without n-grams."""
    data, begins = flat(lowered(texts))
    total = np.zeros((len(texts), weights.shape[1]))
    count = np.zeros(len(texts))
    for buckets, owner in ngram_buckets(data, begins):
        if len(buckets) == 0:
            continue
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total[owner[first]] += np.add.reduceat(weights[buckets], first, axis=0, dtype=np.float32)
        count[owner[first]] += np.diff(np.r_[first, len(owner)])
    return total / np.maximum(count, 1)[:, None]


def sample(labelled: DataFrame, id_column: str, text_column: str, lang_column: str, per_language: int) -> DataFrame:
    """(text, lang): of each language, the texts whose ids have the smallest hashes; null and empty ones never."""
    rows = labelled.filter(F.col(lang_column).isNotNull() & (F.length(text_column) > 0)).select(
        F.col(id_column).alias("sample_id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("sample_id"), "sample_id")
    chosen = (
        rows.select("sample_id", "lang")
        .withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= per_language)
        .select("sample_id", "lang")
        .distinct()
    )
    # At most MAX_LANGUAGES * per_language ids.
    return rows.join(F.broadcast(chosen), ["sample_id", "lang"]).select("lang", "text")


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageCodes:
    """Classifiers from a bounded sample of the labelled rows: per_language texts of each language, by a hash of the id.

    A language is a non-null value of lang_column. Only n-gram counts of each language and mean weights of
    each sampled text reach the driver.
    """
    chosen = sample(small_batches(labelled), id_column, text_column, lang_column, per_language)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                for piece in pieces(own):
                    for buckets, _ in ngram_buckets(*flat(lowered(piece.column("text")))):
                        total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        total += np.bincount(buckets, minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                names=["lang", "bucket", "n"],
            )

    grams = chosen.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(grams.column("lang").to_pylist()), key=lambda x: x.encode())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES}")
    counts = np.zeros((len(languages), BUCKETS))
    at = {lang: i for i, lang in enumerate(languages)}
    counts[[at[x] for x in grams.column("lang").to_pylist()], grams.column("bucket").to_numpy()] = grams.column("n").to_numpy()
    code = codewords(len(languages))
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def log_share(side: np.ndarray) -> np.ndarray:
        total = counts[side].sum()
        mean = share[side].mean(axis=0) * total
        return np.log((mean + SMOOTHING) / (total + SMOOTHING * BUCKETS))

    weights = np.stack([log_share(bit > 0) - log_share(bit < 0) for bit in code.T], axis=1) if code.shape[1] else np.zeros((BUCKETS, 0))
    weights = weights.astype(np.float32)
    table = chosen.sparkSession.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                scores = mean_weights(piece.column("text"), table.value)
                yield pa.RecordBatch.from_arrays([piece.column("lang").cast(pa.string()), pa.array(list(scores), pa.list_(pa.float64()))], names=["lang", "scores"])

    if code.shape[1] == 0:
        none = np.zeros(0)
        return LanguageCodes(languages, code, weights, none, none, none)
    seen = chosen.mapInArrow(margins, "lang string, scores array<double>").toArrow()
    rows = np.array([at[x] for x in seen.column("lang").to_pylist()])
    scores = np.stack(seen.column("scores").to_numpy())
    order = np.lexsort((*scores.T[::-1], rows))
    rows, scores = rows[order], scores[order]
    balance = 1.0 / np.bincount(rows, minlength=len(languages))[rows]
    fits = [logistic(scores[:, b], code[rows, b] > 0, balance) for b in range(code.shape[1])]
    slopes, intercepts = (np.array(x) for x in zip(*fits, strict=True))
    right = ((scores * slopes + intercepts > 0) == (code[rows] > 0)).astype(float)
    accuracy = np.clip((right * balance[:, None]).sum(axis=0) / balance.sum(), 0.51, 0.999)
    trust = np.log(accuracy / (1 - accuracy))
    return LanguageCodes(languages, code, weights, slopes, intercepts, trust / trust.sum())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression on one number, by Newton's method."""
    scale = max(float(np.sqrt(np.average(x**2, weights=weight))), 1e-12)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = weight / weight.sum()
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def decode(codes: LanguageCodes, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of mean weights: the language's index, its probability, and that of the second one.

    A language loses log(1 + exp(-codeword * margin)) at each bit, weighted by the bit's trust; the
    probabilities are a softmax of the losses over all bits.
    """
    margins = scores * codes.slopes + codes.intercepts
    if len(codes.languages) == 1:
        one = np.ones(len(scores))
        return np.zeros(len(scores), np.int64), one, 0 * one
    loss = np.einsum("b,rlb->rl", codes.trust, np.logaddexp(0, -margins[:, None, :] * codes.codewords[None, :, :]))
    likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * codes.codewords.shape[1])
    likely /= likely.sum(axis=1, keepdims=True)
    order = np.argsort(-likely, axis=1, kind="stable")
    each = np.arange(len(scores))
    return order[:, 0], likely[each, order[:, 0]], likely[each, order[:, 1]]


def identify(
    documents: DataFrame, codes: LanguageCodes, id_column: str = "doc_id", text_column: str = "text", ambiguous_below: float = AMBIGUOUS_BELOW
) -> DataFrame:
    """The documents with lang_pred, score (0 to 1) and ambiguous; whole texts, one row for each row.

    A null text, one without letters, and any text when nothing was learned is `und` with score 0, and not
    ambiguous. Given columns of those names are replaced.
    """
    share = small_batches(documents).sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in batches:
            for piece in pieces(batch, text_column, SCORED_AT_ONCE):
                texts = piece.column(text_column)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                letters &= bool(known.languages)
                pred, score, doubt = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if letters.any():
                    best, likely, second = decode(known, mean_weights(texts, known.weights))
                    score = np.where(letters, likely, 0.0)
                    doubt = letters & (likely - second < ambiguous_below)
                    pred = [known.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], pa.array(pred, pa.string()), pa.array(score), pa.array(doubt)],
                    names=[*kept, "lang_pred", "score", "ambiguous"],
                )
        release_memory()

    documents = documents.drop("lang_pred", "score", "ambiguous")
    kept = documents.columns
    more = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    schema = T.StructType([*documents.schema.fields, *[T.StructField(name, kind) for name, kind in more]])
    return documents.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the remainder of its id's checksum by 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))

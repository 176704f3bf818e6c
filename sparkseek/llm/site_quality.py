"""Quality of documents by hierarchical empirical Bayes.

A classifier of whole texts gives each document evidence for a label. The evidence, or the label where one is
known, is summed by path and by host. A host's posterior rate is shrunk toward the global rate and a path's
toward its host's, by as much as the rates of hosts, and of paths within hosts, vary beyond chance. A
document's probability joins its own evidence with the posterior of its path, leaving its own share out.

The classifier is a logistic regression on the words and beginnings of words that a text holds and on the shares of pairs of character
shapes, as far as they tell the label beyond chance, fitted on a bounded sample of labelled rows. Slope and shift of its log odds are set by
parts of the sample that were left out. All else is grouped sums over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.shared import cut, small_batches
from sparkseek.llm.words import LOWER, U64, flat, pieces, span_hashes, word_spans

#: Bytes of the beginnings of longer words, which count as words of their own.
PREFIXES = (4, 5, 6)
#: Slots of words, kinds of character shapes, and features in all.
WORD_SLOTS = 1 << 17
SHAPES = 40
FEATURES = WORD_SLOTS + SHAPES * SHAPES
#: Labelled rows of each value that the classifier is fitted on, by a hash of the id.
SAMPLE_PER_VALUE = 2_000
#: Weight of the shapes' shares, which are small, beside the words.
SHAPE_SCALE = 30.0
#: Sampled texts that hold a word, below which it has no weight.
LEAST_TEXTS = 3
#: Parts of the sample that are left out in turn, to set the log odds by texts that no weight was fitted on.
FOLDS = 5
#: Toxicity from which a document is not kept; low, as a toxic document costs more than a lost one.
TOXIC_FROM = 0.2
#: Shares in which a site's documents are joined with its posterior.
SALTS = 64
#: Limits of a concentration, in documents.
CONCENTRATION = (1.0, 10_000.0)

SHAPE = np.full(256, 4, np.uint8)
SHAPE[ord("a") : ord("z") + 1] = 0
SHAPE[ord("A") : ord("Z") + 1] = 1
SHAPE[ord("0") : ord("9") + 1] = 2
SHAPE[0x80:] = 0
SHAPE[ord(" ")] = 3
SHAPE[[0x09, 0x0A, 0x0D]] = 5
SHAPE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 6 + np.arange(32)

INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class TextClassifier:
    """weights of all features; the log odds of a text are intercept + features @ weights."""

    weights: np.ndarray
    intercept: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), by text: 1 for each word and beginning it holds, the root of the share of each pair of shapes."""
    data, begins = flat(texts)
    lowered = np.where(INSIDE[data], LOWER[data], np.uint8(0x20))
    starts, ends, firsts = word_spans(lowered, begins)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(firsts))
    held = []
    for size in (0, *PREFIXES):
        chosen = ends - starts > size
        upto = starts[chosen] + size if size else ends[chosen]
        slots = (span_hashes(lowered, starts[chosen], upto) + U64(size)) % U64(WORD_SLOTS)
        held.append(owner[chosen] * WORD_SLOTS + slots.astype(np.int64))
    words = np.unique(np.concatenate(held))

    size = np.diff(begins)
    shape = SHAPE[data].astype(np.int64)
    of = np.repeat(np.arange(len(begins) - 1), size)
    inside = of[1:] == of[:-1]
    pairs = (of[:-1] * SHAPES + shape[:-1]) * SHAPES + shape[1:]
    pairs, times = np.unique(pairs[inside], return_counts=True)
    text = np.r_[words // WORD_SLOTS, pairs // (SHAPES * SHAPES)]
    feature = np.r_[words % WORD_SLOTS, WORD_SLOTS + pairs % (SHAPES * SHAPES)]
    value = np.r_[np.ones(len(words)), SHAPE_SCALE * np.sqrt(times / np.maximum(size[pairs // (SHAPES * SHAPES)] - 1, 1))]
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


def labelled_sample(labels: DataFrame, label: str, id_column: str, per_value: int) -> DataFrame:
    """(id, label): per_value ids of each of the values 0 and 1, those with the smallest hashes."""
    rows = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("id is not null").withColumn("h", F.xxhash64("id"))
    return (
        rows.filter("label = 1").orderBy("h", "id").limit(per_value)
        .unionAll(rows.filter("label = 0").orderBy("h", "id").limit(per_value))
        .select("id", "label")
    )


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    per_value: int = SAMPLE_PER_VALUE,
    ridge: float = 1e-3,
    steps: int = 500,
) -> TextClassifier:
    """A classifier of the column `label` (0 or 1) of `labels`, by at most 2 * per_value sampled texts.

    Both values weigh the same, so its log odds are those against even odds. With texts of one value or
    none, it gives even odds for all texts.
    """
    chosen = F.broadcast(labelled_sample(labels, label, id_column, per_value))
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text, feature, value = features(piece.column("text"))
                at = np.searchsorted(text, np.arange(piece.num_rows + 1))
                lists = [
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
                    for x in (feature.astype(np.int32), value.astype(np.float32))
                ]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("label"), *lists], names=["id", "label", "features", "values"]
                )

    seen = (
        texts.join(chosen, "id").select("id", "label", "text")
        .mapInArrow(run, "id long, label int, features array<int>, values array<float>")
        .toArrow().sort_by("id").combine_chunks()
    )
    y = seen.column("label").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return TextClassifier(np.zeros(FEATURES, np.float32), 0.0)
    feature, value = (
        np.concatenate([np.zeros(0), *seen.column(c).to_numpy()]) for c in ("features", "values")
    )
    feature = feature.astype(np.int64)
    row = np.repeat(np.arange(len(y)), [len(x) for x in seen.column("features").to_numpy()])
    w, b = regression(row, feature, value, y, ridge, steps)
    slope, shift = calibration(*held_out_odds(row, feature, value, y, ridge, steps))
    return TextClassifier((slope * w).astype(np.float32), float(slope * b + shift))


def beyond_chance(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features have a weight: those that tell the label better than the best of as many would by chance.

    Words by the likelihood ratio of the texts of either label that hold them, shapes by the squared difference of their means in
    standard errors; both against twice the logarithm of how many are tried.
    """
    n, n1 = len(y), (y == 1).sum()
    sides = [(y[row] == label, size) for label, size in ((1, n1), (0, n - n1))]
    held = [np.bincount(feature[side], minlength=FEATURES).astype(float) for side, _ in sides]
    texts = held[0] + held[1]
    ratio, gap, error = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for times, (side, size), sign in zip(held, sides, (1, -1), strict=True):
        for a, expected in ((times, texts * size / n), (size - times, size - texts * size / n)):
            ratio += 2 * a * np.log(np.maximum(a, 1e-9) / np.maximum(expected, 1e-9))
        mean = np.bincount(feature[side], value[side], minlength=FEATURES) / size
        gap += sign * mean
        error += (np.bincount(feature[side], value[side] ** 2, minlength=FEATURES) / size - mean**2) / size
    ratio[WORD_SLOTS:] = (gap**2 / np.maximum(error, 1e-12))[WORD_SLOTS:]
    chosen = texts >= LEAST_TEXTS
    for part in (slice(0, WORD_SLOTS), slice(WORD_SLOTS, FEATURES)):
        chosen[part] &= ratio[part] >= 2 * np.log(max(2, chosen[part].sum()))
    return chosen


def regression(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, ridge: float, steps: int
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression in which both labels weigh the same. Rows of `y` that are NaN take no part."""
    used = ~np.isnan(y)
    keep = used[row]
    row, feature, value = (np.cumsum(used) - 1)[row[keep]], feature[keep], value[keep]
    y = y[used]
    chosen = beyond_chance(row, feature, value, y)
    keep = chosen[feature]
    places = np.cumsum(chosen) - 1
    row, feature, value, size = row[keep], places[feature[keep]], value[keep], int(chosen.sum())
    balance = 0.5 / np.where(y == 1, (y == 1).sum(), (y == 0).sum())

    # Adam on the weighted loss with a ridge; the data are a few million numbers at most.
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        logit = np.bincount(row, value * w[feature], minlength=len(y)) + b
        error = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        g = np.bincount(feature, value * error[row], minlength=size) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        rate = 0.03 / (1 + step / 100)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros(FEATURES)
    whole[chosen] = w
    return whole, b


def held_out_odds(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, ridge: float, steps: int
) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of sampled texts by regressions that have not seen them, and their labels; none if a label is too rare to be left out."""
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    if min((y == 1).sum(), (y == 0).sum()) < 2 * FOLDS:
        return np.zeros(0), np.zeros(0)
    found = np.zeros(len(y))
    for k in range(FOLDS):
        w, b = regression(row, feature, value, np.where(fold == k, np.nan, y), ridge, steps)
        found[fold == k] = (np.bincount(row, value * w[feature], minlength=len(y)) + b)[fold == k]
    return found, y


def calibration(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log odds of unseen texts true, against even odds; 1 and 0 without any. By Newton's method.

    Labels count as a little less than sure, as if there were one more text of either label.
    """
    if not len(y):
        return 1.0, 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = 0.5 / np.where(y == 1, n1, n0)
    x = np.stack([logit, np.ones(len(y))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        slope = x @ (weight * (target - p)) - 1e-6 * at
        curve = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return float(max(at[0], 0.0)), float(at[1])


def log_odds(documents: DataFrame, classifiers: dict[str, TextClassifier], text_column: str = "text") -> DataFrame:
    """The documents without their text, with one column of log odds a classifier; a text without features has 0."""
    share = documents.sparkSession.sparkContext.broadcast(list(classifiers.values()))
    kept = [c for c in documents.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in batches:
            for piece in pieces(batch, text_column):
                text, feature, value = features(piece.column(text_column))
                some = np.bincount(text, minlength=piece.num_rows) > 0
                odds = [
                    np.where(some, np.bincount(text, value * c.weights[feature], minlength=piece.num_rows) + c.intercept, 0.0)
                    for c in known
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], *map(pa.array, odds)], names=[*kept, *classifiers]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name in kept]
    return documents.mapInArrow(run, ", ".join([*fields, *[f"`{c}` double" for c in classifiers]]))


def odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def concentration(centre: Column, groups_fixed: Column) -> Column:
    """By moments: how many documents the centre is worth, from how the rates s / n scatter about it."""
    n, s = F.col("n"), F.col("s")
    scatter = F.sum(n * (s / n - centre) * (s / n - centre))
    noise = F.sum("s") / F.sum("n") * (1 - F.sum("s") / F.sum("n"))
    spare = F.sum("n") - F.sum(n * n) / F.sum("n")
    between = (scatter - (F.count("*") - groups_fixed) * noise) / F.greatest(spare, F.lit(1e-9))
    low, high = map(F.lit, CONCENTRATION)
    return F.greatest(low, F.least(high, noise / F.greatest(between, F.lit(1e-12)) - 1))


def site_posteriors(evidence: DataFrame, share: str = "p") -> DataFrame:
    """(host, path, n, s, path_weight, host_rate, path_rate) from one row a document with host and path.

    `share` is a document's label or its classifier's probability; host and path must not be null. A weight
    is the number of documents that the rate above counts for.
    """
    paths = cut(
        evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(share).alias("s"))
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rate = F.lit(hosts.agg(F.sum("s") / F.sum("n")).first()[0])
    host_weight = F.lit(hosts.agg(concentration(rate, F.lit(1))).first()[0])
    hosts = hosts.select(
        "host",
        (F.col("s") / F.col("n")).alias("own_rate"),
        ((F.col("s") + host_weight * rate) / (F.col("n") + host_weight)).alias("host_rate"),
    )
    both = paths.join(hosts, "host")
    path_weight = F.lit(both.agg(concentration(F.col("own_rate"), F.count_distinct("host"))).first()[0])
    shrunk = (F.col("s") + path_weight * F.col("host_rate")) / (F.col("n") + path_weight)
    return both.select("host", "path", "n", "s", path_weight.alias("path_weight"), "host_rate", shrunk.alias("path_rate"))


def with_posterior(evidence: DataFrame, logit: str, share: str, result: str) -> DataFrame:
    """The rows with `result`: the probability by the document's log odds and its path's posterior without itself."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sites = site_posteriors(evidence, share=share).withColumn("salt", salts)
    # A site with a third of all rows meets its posterior in `SALTS` shares.
    salted = evidence.withColumn("salt", F.pmod(F.xxhash64("doc_id", logit), F.lit(SALTS)).cast("int"))
    joined = salted.join(sites, ["host", "path", "salt"]).drop("salt")
    others = (F.col("s") - F.col(share) + F.col("path_weight") * F.col("host_rate")) / (
        F.col("n") - 1 + F.col("path_weight")
    )
    return joined.withColumn(result, chance(F.col(logit) + odds(others))).drop(
        "n", "s", "host_rate", "path_rate", "path_weight"
    )


def judge(
    documents: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    good_from: float = 0.5,
    toxic_from: float = TOXIC_FROM,
) -> DataFrame:
    """One row a document: doc_id, host, path, quality, toxicity (0 to 1), keep.

    labels has the id, `quality` and `toxic` (0, 1 or null; the highest where an id repeats). A document is
    kept if its quality is good_from or more and its toxicity below toxic_from. A null host or path is an empty
    one. A null, empty or unreadable text has only its site's evidence. Without labels of both values, texts
    give no evidence. Repeated rows are separate documents. Other columns are ignored.
    """
    rows = small_batches(documents).select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.col(text_column).alias("text"),
    )
    known = labels.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(
        F.max(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    known = cut(known)
    texts = rows.select("doc_id", "text")
    classifiers = {f"{c}_logit": fit(texts, known, c, "doc_id") for c in ("quality", "toxic")}
    base = known.agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")).first()
    evidence = log_odds(rows, classifiers).join(known, "doc_id", "left")
    for c in ("quality", "toxic"):
        prior = 0.5 if base[c] is None else min(max(base[c], 1e-3), 1 - 1e-3)
        guess = chance(F.col(f"{c}_logit") + F.lit(float(np.log(prior / (1 - prior)))))
        evidence = evidence.withColumn(f"{c}_share", F.coalesce(F.col(c).cast("double"), guess))
    evidence = cut(evidence.drop("quality", "toxic"))
    judged = with_posterior(evidence, "quality_logit", "quality_share", "quality")
    judged = with_posterior(judged, "toxic_logit", "toxic_share", "toxicity")
    return judged.select(
        "doc_id", "host", "path", "quality", "toxicity", ((F.col("quality") >= good_from) & (F.col("toxicity") < toxic_from)).alias("keep")
    )


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address; null if it has none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.regexp_extract(path, r"^/([^/]*)", 1)

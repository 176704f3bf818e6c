"""Language codes, language models, templates, sites, secrets and chat on small tables."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.llm import chat, decontaminate, language_id, lm_scoring, secrets, site_quality
from sparkseek.llm import words as w
from tests.conftest import tuples
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


# Language identification


def test_held_out_languages_are_recognised(spark):
    documents = table(spark, "documents")
    held = language_id.held_out(F.col("doc_id"))
    codes = language_id.fit(documents.filter(~held))
    found = language_id.identify(documents.filter(held), codes).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(spark):
    documents = table(spark, "documents")
    codes = language_id.fit(documents, per_language=20)
    rows = [(1, None, 5), (1, "", 5), (2, "123 !?", 6), (3, "the of and in", 7), (3, "the of and in", 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score long")
    found = tuples(language_id.identify(odd, codes).select("doc_id", "lang_pred", "score").orderBy("doc_id"))
    assert found[:3] == [(1, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)]
    assert found[3] == found[4] and found[3][1] == "en"
    assert language_id.identify(odd.limit(0), codes).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    rows = spark.createDataFrame([(1, "some words", "xx"), (2, None, "yy"), (3, "others", None)], "doc_id long, text string, lang string")
    one = language_id.fit(rows)
    assert one.languages == ["xx"]
    assert tuples(language_id.identify(rows, one).select("lang_pred").orderBy("doc_id")) == [("xx",), ("und",), ("xx",)]
    none = language_id.fit(rows.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(rows, none).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 4, 7, 12, 60])
def test_codewords_are_apart(n):
    code = language_id.codewords(n).astype(int)
    distance = (code.shape[1] - code @ code.T) // 2
    np.fill_diagonal(distance, 999)
    assert distance.min() >= (2 ** (n - 2) if n <= 7 else 3)
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_a_text_between_two_languages_is_ambiguous():
    code = language_id.codewords(2)
    codes = language_id.LanguageCodes(["a", "b"], code, np.zeros((1, 1)), np.ones(1), np.zeros(1), np.ones(1))
    best, likely, second = language_id.decode(codes, np.array([[0.05], [9.0], [-9.0]]))
    assert likely[0] - second[0] < language_id.AMBIGUOUS_BELOW < likely[1] - second[1]
    assert best.tolist() == [0, 0, 1]


# Language models


def test_losses_equal_plain_counts(spark):
    rows = [(1, "a b a b", True), (2, "a c", False), (3, None, True), (4, "", False), (5, "B a", None), (5, "zz a c", True)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, wanted boolean").withColumn("target", F.lit(1))
    fitted = lm_scoring.fit(documents.filter("wanted"), documents)
    found = {(r[0], r[1]): r for r in tuples(lm_scoring.score(documents, fitted))}

    def model(texts, scale=1.0):
        alone, both, starts = {}, {}, 0
        for text in texts:
            before = None
            for word in plain.words((text or "").lower()):
                alone[word] = alone.get(word, 0) + scale
                both[before, word] = both.get((before, word), 0) + scale
                starts += scale * (before is None)
                before = word
        return alone, both, starts

    target = model([t for _, t, good in rows if good])
    everything = model([t for _, t, _ in rows])
    scale = sum(target[0].values()) / sum(everything[0].values())
    models = [target, model([t for _, t, _ in rows], scale)]
    for doc_id, text, _ in rows:
        words = plain.words((text or "").lower())
        got = found[doc_id, len(words)]
        if not words:
            assert got[1:] == (0, None, None, None)
            continue
        losses = []
        for alone, both, starts in models:
            total, loss, before = sum(alone.values()), 0.0, None
            for word in words:
                p = (alone.get(word, 0) + lm_scoring.WORD_SMOOTHING) / (total + lm_scoring.WORD_SMOOTHING * lm_scoring.WORD_SLOTS)
                context = starts if before is None else alone.get(before, 0)
                pair = both.get((before, word), 0)
                loss -= math.log((pair + lm_scoring.PAIR_SMOOTHING * p) / (max(context, pair) + lm_scoring.PAIR_SMOOTHING))
                before = word
            losses.append(loss / len(words))
        assert got[2:] == pytest.approx((*losses, losses[0] - losses[1]), rel=1e-5)


def test_more_words_and_pairs_than_a_fixed_table_holds(spark):
    # One text repeats a pair; 400,000 others hold 2,000,000 words and pairs that occur once.
    base = spark.range(400_000, numPartitions=4)
    word = lambda k: F.concat(F.lit("w"), (F.col("id") * 5 + k).cast("string"))
    single = base.select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[word(k) for k in range(5)]).alias("text"))
    common = spark.createDataFrame([(-1, "red green " * 50), (-2, "w0 w1 w2 w3 w4")], "doc_id long, text string")
    documents = single.unionAll(common)
    models = lm_scoring.fit(common, documents)
    assert models.words == (105, 2_000_105) and models.starts == (2, 400_002)
    assert models.vocabulary == models.counts.count() == 2_000_002 > 1 << 20
    few = spark.createDataFrame([(1, "w7 w8"), (2, "w7 w9"), (3, "w7 never")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm_scoring.score(few, models).collect()}
    scale = 105 / 2_000_105

    def loss(pairs):
        out = 0.0
        for both, alone, context in pairs:
            p = (alone * scale + lm_scoring.WORD_SMOOTHING) / (105 + lm_scoring.WORD_SMOOTHING * 2_000_002)
            out -= math.log((both * scale + lm_scoring.PAIR_SMOOTHING * p) / (max(context, both) * scale + lm_scoring.PAIR_SMOOTHING))
        return out / len(pairs)

    w7 = (0, 1, 400_002)
    for doc_id, last in ((1, (1, 1, 1)), (2, (0, 1, 1)), (3, (0, 0, 1))):
        assert found[doc_id]["background_loss"] == pytest.approx(loss([w7, last]), rel=1e-9)


def test_losses_do_not_depend_on_which_pairs_are_hot(spark, monkeypatch):
    documents = table(spark, "documents").select("doc_id", "text").limit(200).cache()
    models = lm_scoring.fit(documents.filter("doc_id % 2 = 0"), documents)
    whole = sorted(tuples(lm_scoring.score(documents, models)))
    for most in (0, 100):
        monkeypatch.setattr(lm_scoring, "HOT_PAIRS", most)
        for got, wanted in zip(sorted(tuples(lm_scoring.score(documents, models))), whole, strict=True):
            assert got == pytest.approx(wanted, rel=1e-9)


def test_losses_do_not_depend_on_which_words_are_hot(spark, monkeypatch):
    documents = table(spark, "documents").select("doc_id", "text").limit(200).cache()
    models = lm_scoring.fit(documents.filter("doc_id % 2 = 0"), documents)
    whole = sorted(tuples(lm_scoring.score(documents, models)))
    within = lm_scoring.fit_within(documents, F.col("doc_id") % 2 == 0)
    assert (within.words, within.starts, within.vocabulary) == (models.words, models.starts, models.vocabulary)
    for most, pairs in ((1 << 20, 1 << 20), (0, 0), (100, 1 << 20), (5_000, 100)):
        monkeypatch.setattr(lm_scoring, "HOT_WORDS", most)
        monkeypatch.setattr(lm_scoring, "HOT_PAIRS", pairs)
        for got, wanted in zip(sorted(tuples(lm_scoring.score(documents, within))), whole, strict=True):
            assert got == pytest.approx(wanted, rel=1e-9)


def test_losses_of_a_pair_in_more_texts_than_a_task_adds_up_at_once(spark, monkeypatch):
    n = lm_scoring.MET_AT_ONCE + 5_000
    text = F.concat(F.lit("red green w"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " red green").otherwise(""))
    documents = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"))
    models = lm_scoring.fit_within(documents, F.col("doc_id") % 2 == 0)
    columns = ("n_words", "target_loss", "background_loss", "difference")
    whole = lm_scoring.score(documents, models).orderBy("doc_id").toArrow()
    for words, pairs in ((1 << 20, 0), (0, 0)):
        monkeypatch.setattr(lm_scoring, "HOT_WORDS", words)
        monkeypatch.setattr(lm_scoring, "HOT_PAIRS", pairs)
        found = lm_scoring.score(documents, models).orderBy("doc_id").toArrow()
        assert found.num_rows == n
        for c in columns:
            np.testing.assert_allclose(found.column(c).to_numpy(), whole.column(c).to_numpy(), rtol=1e-9, atol=1e-12)


def test_rows_of_pairs_are_sorted_by_one_long_and_not_windowed(spark):
    # Two windows over rows sorted by two columns were the query's slowest step.
    documents = table(spark, "documents").select("doc_id", "text")
    plan = lm_scoring.score(documents, lm_scoring.fit_within(documents, F.col("doc_id") % 2 == 0))._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert "Window" not in plan and sorts and all(line.count("ASC") == 1 for line in sorts)


def test_parts_hold_each_key_whole():
    rng = np.random.default_rng(7)
    most = lm_scoring.MET_AT_ONCE
    key = np.sort(np.r_[rng.integers(-50_000, 50_000, 4 * most), np.full(2 * most, 17)])
    rows = np.stack([key, np.arange(len(key))])
    batches = [rows[:, a : a + 1_000] for a in range(0, len(key), 1_000)]
    parts = list(lm_scoring._whole_keys(iter([batches[0][:, :0], *batches, batches[0][:, :0]])))
    assert (np.concatenate(parts, axis=1) == rows).all() and len(parts) >= 3
    assert all(a[0, -1] < b[0, 0] for a, b in zip(parts[:-1], parts[1:], strict=True))
    assert list(lm_scoring._whole_keys(iter([]))) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1_000])
def test_ranks_found_by_the_first_bits_of_hashes(n):
    rng = np.random.default_rng(n)
    known = np.unique(np.r_[rng.integers(0, 1 << 63, n - n // 4), (1 << 62) + np.arange(n // 4)].astype(np.uint64) << np.uint64(1))
    ranks = rng.permutation(len(known)).astype(np.int32)
    asked = np.r_[known, known + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)]
    held = dict(zip(known.tolist(), ranks.tolist(), strict=True))
    assert lm_scoring.Ranks.of(known, ranks).find(asked).tolist() == [held.get(h, -1) for h in asked.tolist()]


def test_a_text_of_the_target_loses_less_under_it(spark):
    rows = [(i, "red green blue red green", True) for i in range(20)] + [(100 + i, "one two three one two", False) for i in range(20)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, wanted boolean")
    found = {r["doc_id"]: r["difference"] for r in lm_scoring.score(documents, lm_scoring.fit(documents.filter("wanted"), documents)).collect()}
    assert found[0] < 0 < found[100]
    empty = documents.limit(0)
    assert lm_scoring.score(empty, lm_scoring.fit(empty, empty)).count() == 0


# Templates


def contamination(spark, documents, items, **options):
    documents = spark.createDataFrame(documents, "doc_id long, text string, hash long, id string")
    items = spark.createDataFrame(items, "item_id long, text string, place long")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contamination(documents, items, **options).collect()}


QUESTION = "If a train with 120 passengers leaves the old station at noon and 30 passengers get off how many are left"


def test_copies_and_other_parameters_are_found(spark):
    reworded = QUESTION.replace("120", "75").replace("30", "12")
    docs = [
        (1, f"Some text before. {QUESTION.upper()} and after it.", 0, ""),
        (2, f"Before\n{reworded}?\nAfter", 0, ""),
        (3, "A train leaves the station at noon and nobody counts the passengers on it.", 0, ""),
        (4, None, 0, ""), (5, "", 0, ""), (6, "!! ... 7", 0, ""),
        (7, reworded, 0, ""), (7, reworded, 0, ""), (None, QUESTION, 0, ""),
    ]
    found = contamination(spark, docs, [(1, QUESTION, 0), (2, None, 0), (3, "", 0), (None, QUESTION, 0)])
    assert set(found) == {(1, 1), (2, 1), (7, 1)}
    assert not found[1, 1]["reworded"] and found[2, 1]["reworded"] and found[7, 1]["consistency"] == 1


def test_slots_must_agree(spark):
    item = "Take 5 red apples and 5 green apples then give 5 to a friend and count the 5 that stay on the table"
    same = item.replace("5", "8")
    mixed = "Take 1 red apples and 2 green apples then give 3 to a friend and count the 4 that stay on the table"
    found = contamination(spark, [(1, same, 0, ""), (2, mixed, 0, "")], [(1, item, 0)])
    assert set(found) == {(1, 1)}
    assert set(contamination(spark, [(2, mixed, 0, "")], [(1, item, 0)], least_consistency=0.0)) == {(2, 1)}


def test_tables_of_numbers_are_compared_by_value(spark):
    item = "1 2 3 4 5 6 7 8 9 10"
    found = contamination(spark, [(1, "11 12 13 14 15 16 17 18 19 20", 0, ""), (2, f"so {item}", 0, "")], [(1, item, 0)])
    assert set(found) == {(2, 1)}


def test_names_units_and_short_items(spark):
    item = "Yesterday the farmer Peter walked for 3 hours to the market and sold 4 kg of plums"
    doc = "Yesterday the farmer Maria walked for 5 days to the market and sold 9 pounds of plums"
    found = contamination(spark, [(1, doc, 0, ""), (2, "Too short", 0, ""), (3, "Too short, it seems", 0, "")], [(1, item, 0), (2, "too short!", 0)])
    assert set(found) == {(1, 1), (2, 2)} and found[1, 1]["reworded"]
    assert contamination(spark, [], [(1, item, 0)]) == {} and contamination(spark, [(1, doc, 0, "")], []) == {}


def test_verbatim_copies_are_found_in_any_case_and_place(spark):
    long = "Yesterday the farmer Peter walked for 3 hours to the market and sold 4 kg of plums"
    items = [(1, long, 0), (2, "Rivers carry sand towards distant seas", 0), (3, "Seven blue swans", 0), (4, "blue Peter Swan sails", 0)]
    docs = [
        (1, long.upper(), 0, ""), (2, f"Before it. {long.lower()} and after it", 0, ""),
        (3, "they say Rivers carry sand towards distant seas and more", 0, ""),
        (4, "there were seven blue Swans on the lake that day", 0, ""), (5, "Seven blue swans swim", 0, ""),
        (6, "then the BLUE PETER SWAN SAILS away", 0, ""), (7, "seven blue and white swans on the lake", 0, ""),
    ]
    found = contamination(spark, docs, items)
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)}
    assert all(r["coverage"] == r["consistency"] == 1 and not r["reworded"] for r in found.values())


def test_planted_passages_are_found_and_nothing_else(spark):
    documents, benchmark = table(spark, "documents"), table(spark, "benchmark")
    texts = {r["doc_id"]: plain.shingles(r["text"], 5) for r in documents.collect()}
    items = {r["item_id"]: plain.shingles(r["text"], 5) for r in benchmark.collect()}
    expected = {(d, i) for d, s in texts.items() for i, t in items.items() if len(s & t) >= 0.95 * len(t)}
    none = {(d, i) for d, s in texts.items() for i, t in items.items() if len(s & t) <= 0.3 * len(t)}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(documents, benchmark).collect()}
    assert expected <= found and not found & none


# Sites


def test_toxic_and_poor_documents_are_told(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.filter("doc_id % 2 = 0")
    judged = site_quality.judge(documents, known, F.col("source"), F.col("lang"))
    rows = judged.join(labels.filter("doc_id % 2 = 1").withColumnRenamed("quality", "good"), "doc_id").collect()
    assert sum((r["quality"] >= 0.5) == (r["good"] == 1) for r in rows) > 0.93 * len(rows)
    assert sum((r["toxicity"] >= 0.5) == (r["toxic"] == 1) for r in rows) > 0.93 * len(rows)


def test_sparse_paths_shrink_to_their_host_and_hosts_to_the_world(spark):
    rows = [("a", "x", 1.0)] * 200 + [("a", "y", 0.0)] + [("b", "x", 0.0)] * 200 + [("c", "z", 1.0)]
    evidence = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p double")
    found = {(r["host"], r["path"]): r for r in site_quality.site_posteriors(evidence, "p").collect()}
    assert found["a", "x"]["path_rate"] > 0.95 and found["b", "x"]["path_rate"] < 0.05
    assert found["a", "x"]["host_rate"] > found["c", "z"]["host_rate"] > 0.5 > found["b", "x"]["host_rate"]
    assert 0 < found["a", "y"]["path_rate"] < found["a", "x"]["path_rate"]


def plain_posteriors(rows):
    """(host, path) -> (path_weight, host_rate, path_rate), group by group."""
    paths, hosts = {}, {}
    for host, path, p in rows:
        for groups, key in ((paths, (host, path)), (hosts, host)):
            n, s = groups.get(key, (0, 0.0))
            groups[key] = n + 1, s + p

    def worth(groups, centre_of, fixed):
        n, s = sum(g[0] for g in groups.values()), sum(g[1] for g in groups.values())
        noise = s / n * (1 - s / n)
        scatter = sum(m * (t / m - centre_of(k)) ** 2 for k, (m, t) in groups.items())
        spare = n - sum(m * m for m, _ in groups.values()) / n
        between = (scatter - (len(groups) - fixed) * noise) / max(spare, 1e-9)
        return max(1.0, min(10_000.0, noise / max(between, 1e-12) - 1))

    rate = sum(p for *_, p in rows) / len(rows)
    weight = worth(hosts, lambda _: rate, 1)
    host_rate = {h: (s + weight * rate) / (n + weight) for h, (n, s) in hosts.items()}
    path_weight = worth(paths, lambda k: hosts[k[0]][1] / hosts[k[0]][0], len(hosts))
    return {k: (path_weight, host_rate[k[0]], (s + path_weight * host_rate[k[0]]) / (n + path_weight)) for k, (n, s) in paths.items()}


def test_posteriors_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(h := rng.choice("aaaabbc"), p := rng.choice("xyz"), float(rng.random() < (0.2 + 0.3 * (h == "a") + 0.2 * (p == "x")))) for _ in range(400)]
    evidence = spark.createDataFrame([(i, *r, i / 100 - 2) for i, r in enumerate(rows)], "doc_id long, host string, path string, p double, logit double")
    expected = plain_posteriors(rows)
    found = site_quality.site_posteriors(evidence, "p").collect()
    assert len(found) == len(expected)
    for r in found:
        assert (r["path_weight"], r["host_rate"], r["path_rate"]) == pytest.approx(expected[r["host"], r["path"]])
    counts = {k: (sum(1 for r in rows if r[:2] == k), sum(r[2] for r in rows if r[:2] == k)) for k in expected}
    for r in site_quality.with_posterior(evidence, "logit", "p", "result").collect():
        weight, host_rate, _ = expected[r["host"], r["path"]]
        n, s = counts[r["host"], r["path"]]
        prior = min(max((s - r["p"] + weight * host_rate) / (n - 1 + weight), 1e-6), 1 - 1e-6)
        assert r["result"] == pytest.approx(1 / (1 + math.exp(-r["logit"] - math.log(prior / (1 - prior)))))


def test_words_beyond_chance_are_told_from_noise():
    rng = np.random.default_rng(5)
    y = (np.arange(400) < 40).astype(float)
    rows, found = [], []
    for text in range(400):
        words = set(rng.integers(0, 500, 60)) | ({1000 + int(rng.integers(4))} if y[text] else set())
        rows += [text] * len(words)
        found += sorted(words)
    row, feature = np.array(rows), np.array(found)
    chosen = np.flatnonzero(site_quality.beyond_chance(row, feature, np.ones(len(row)), y))
    assert {1000, 1001, 1002, 1003} <= set(chosen.tolist()) and len(chosen) <= 8
    logit, label = site_quality.held_out_odds(row, feature, np.ones(len(row)), y, 1e-3, 200)
    slope, shift = site_quality.calibration(logit, label)
    assert slope > 0 and ((slope * logit + shift > 0) == (label == 1)).mean() > 0.98


def test_odd_documents_and_labels(spark):
    documents = spark.createDataFrame(
        [(1, None, None, None), (2, "", "h", "p"), (2, "", "h", "p"), (3, "fine words", "h", None)],
        "doc_id long, text string, host string, quality string",
    )
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = site_quality.judge(documents, labels, F.col("host"), F.col("quality")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 2, 3]
    assert all(0 <= r["quality"] <= 1 and 0 <= r["toxicity"] <= 1 for r in found)
    assert site_quality.judge(documents, labels.limit(0), F.col("host"), F.col("quality")).count() == 4
    assert site_quality.judge(documents.limit(0), labels, F.col("host"), F.col("quality")).count() == 0


def test_site_of_an_address(spark):
    rows = spark.createDataFrame([("https://A.b.com/x/y?z=1",), ("nothing",), (None,)], "url string")
    assert tuples(rows.select(*site_quality.url_site(F.col("url")))) == [("a.b.com", "x"), (None, ""), (None, None)]


# Secrets

KEY = "AKIA" + "Q7" * 8
PARTS = [
    "password=hunter22", "Token : 'abc'", 'api_key":  "Zx9/+=._-"', "secret=token : abcdef12", "passwd=x", KEY, "AKIA123",
    "0123456789abcdef" * 2, "deadbeef", "é", " ", "\n", "word", "API-KEY=abcdefgh", "ſecret=abcdefgh", "secretsecret==abcdef",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_plain_spans_equal_their_definition(text):
    found = [s for s in secrets.text_spans(text.encode()) if s[0] in secrets.BASE_KINDS]
    assert found == plain.base_spans(text)


def test_weak_parts_need_their_complements(spark):
    weak, url = "q8Zk3LmN0pQr7StUvW2x", "https://vault.example.com/v1"
    rows = [
        (1, f"id {KEY} key {weak} at {url}"),
        (2, f"key {weak} at {url}"),
        (3, f"{KEY}\n\nkey {weak}"),
        (4, f"{KEY} at {url}"),
        (5, f"{KEY} {'x ' * 300} key {weak}"),
        (6, None), (7, ""), (7, ""),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit(1))
    found = {}
    for r in secrets.find_secrets(documents).collect():
        found.setdefault(r["doc_id"], []).append([s["kind"] for s in r["secrets"]])
    assert found[1] == [["access", "weak_secret", "endpoint"]]
    assert found[2] == [[]] and found[3] == found[4] == found[5] == [["access"]]
    assert found[6] == [[]] and found[7] == [[], []]


WEAK_PARTS = [
    KEY, "ASIA" + "B3" * 8, "q8Zk3LmN0pQr7StUvW2x", "A1b2C3d4E5f6G7h8I9j0Kq", "https://vault.example.com/v1", "db.example.org:5432", "user: anna",
    "client_id=abc-9", "password=hunter22", "0123456789abcdef" * 2, "word", "é", "\n\n", "\n \n", " ", " " * 60, "password=" + "deadbeef" * 4,
]


def plain_links(text, scope):
    """(kind, start, end) of linked weak parts, every part tried against every other."""
    base = plain.base_spans(text)
    free = lambda a, b, taken: all(y <= a or x >= b for _, x, y in taken)
    spans = lambda p: [tuple(len(text.encode()[:i].decode()) for i in m.span()) for m in p.finditer(text.encode())]
    named = [("identifier", a, b) for a, b in spans(secrets.OTHER) if free(a, b, base)]
    taken = base + named
    weak = [("weak_secret", a, b) for a, b in spans(secrets.WEAK) if secrets.random_looking(text[a:b].encode()) and free(a, b, taken)]
    ends = [("endpoint", a, b) for a, b in spans(secrets.ADDRESS) if free(a, b, taken)]
    paragraph = lambda i: sum(m.start() < len(text[:i].encode()) or m.start() == len(text[:i].encode()) for m in secrets.PARAGRAPH.finditer(text.encode()))

    def near(x, others):
        return any(y[1] <= x[2] + scope and y[2] + scope >= x[1] and paragraph(x[1]) == paragraph(y[1]) for y in others)

    access, assign, hexes = ([s for s in base if s[0] == k] for k in secrets.BASE_KINDS[1::-1] + secrets.BASE_KINDS[2:])
    told = [x for x in weak if near(x, access + named)]
    found = told + [x for x in named if near(x, assign + weak)]
    return sorted(found + [x for x in ends if near(x, assign + told + [h for h in hexes if near(h, access)])])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WEAK_PARTS), max_size=14).map(" ".join), st.sampled_from([5, 40, 400]))
def test_links_equal_those_of_all_pairs_of_parts(text, scope):
    found = [s for s in secrets.text_spans(text.encode(), scope) if s[0] not in secrets.BASE_KINDS]
    assert sorted(found) == plain_links(text, scope)


def test_any_complementary_kinds_link():
    kinds = lambda text: sorted(s[0] for s in secrets.text_spans(text.encode()))
    weak, url = "q8Zk3LmN0pQr7StUvW2x", "https://vault.example.com/v1"
    assert kinds(f"password=hunter22 at {url}") == ["assign", "endpoint"]
    assert kinds(f"ASIA{'B3' * 8} {weak} {url}") == ["endpoint", "identifier", "weak_secret"]
    assert kinds(f"user: anna password: hunter22") == ["assign", "identifier"]
    assert kinds(f"{'0a' * 20} {url}") == ["hex"] and kinds(f"{KEY} {'0a' * 20} {url}") == ["access", "endpoint", "hex"]
    assert kinds(f"user: anna {url}") == [] == kinds(f"ASIA{'B3' * 8}")
    # Inside of a long assignment with many hexadecimal spans, nothing is reported again.
    inside = "password=" + "+".join(["0123456789abcdef" * 2] * 7) + "+" + weak
    assert "weak_secret" not in kinds(f"{inside} {KEY}")


def test_digest_of_all_documents(spark):
    documents = table(spark, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = secrets.digest(secrets.find_secrets(documents)).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = plain.base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in secrets.BASE_KINDS]
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


# Chat

PIECES = [*chat.CONTROLS, "\\", " ", "a", "\n", "é", "<", "s>", "</", "[", "INST]"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), st.lists(st.sampled_from(PIECES), max_size=4).map("".join))
def test_a_turn_is_read_as_it_was_written(text, role):
    ((found_role, found, start, end),) = chat.parse(rendered := chat.render(role, text))
    assert (found_role, found, chat.unescape(rendered[start:end])) == (role, text, text)
    assert [t[:2] for t in chat.parse(rendered + chat.render("x", "y"))] == [(role, text), ("x", "y")]


@pytest.mark.parametrize("text", ["plain", "<s>", "<s>[ROLE] a [/ROLE][INST] b [/INST]", "<s>[ROLE] a [/ROLE][INST]b[/INST]</s>"])
def test_other_texts_are_not_in_the_grammar(text):
    assert chat.parse(text) is None


def test_conversations_are_read_back(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [
        (1, 1, "assistant", hard), (1, 0, "user", hard), (2, 0, "user", None), (3, 0, "assistant", None), (3, 1, None, "x"),
        (4, 0, "assistant", "b"), (4, 0, "assistant", "b"), (None, None, "user", "lost"),
    ]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("?"))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=str)
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        learned = "".join(text for _, role, text in turns if role == "assistant")
        got = found[conv]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"]) == (len(turns), digest, len(learned))
        assert got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_capitals_of_two_bytes_are_lowered():
    data, _ = w.flat(pa.array(["ÀÉÞ×ßé"]))
    assert decontaminate.lower_latin(data).tobytes().decode() == "àéþ×ßé"

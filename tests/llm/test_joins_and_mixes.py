"""The Jaccard join, the mix, the forest, components and the pipeline against plain versions."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm import ann, jaccard_join, mixing, shared
from sparkseek.llm.queries import op10_hash_forest
from tests.conftest import tuples
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# Components and memberships


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(few_partitions, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {i: i for e in edges for i in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = shared.components(few_partitions.createDataFrame(edges, "a long, b long"))
    assert dict(tuples(found)) == parent


def shuffles(spark) -> set[str]:
    """Numbers of the shuffles that have files."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name.split("_")[1] for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}


def test_steps_of_the_join_leave_no_shuffle_files(few_partitions):
    rng = random.Random(5)
    base = [rng.randrange(10**6) for _ in range(60)]
    rows = [(i, " ".join(map(str, base[: 60 - i % 3] if i % 2 else rng.sample(range(10**6), 30)))) for i in range(80)]
    before = shuffles(few_partitions)
    setting = few_partitions.conf.get(shared.REMOVE_SHUFFLES, None)
    groups = jaccard_join.jaccard_groups(few_partitions.createDataFrame(rows, "doc_id long, text string"))
    # Files are removed in the background; a stage that its action did not wait for, as a side met none, may write one later.
    end = time.time() + 20
    while len(shuffles(few_partitions) - before) > 3 and time.time() < end:
        time.sleep(0.2)
    assert len(shuffles(few_partitions) - before) <= 3
    assert few_partitions.conf.get(shared.REMOVE_SHUFFLES, None) == setting
    found = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert found == {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert len(set(found.values())) == 41 and all(found[i] == 1 for i in range(1, 80, 2))


@pytest.mark.parametrize(
    ("edges", "settled"),
    [
        ([(1, 1), (2, 1), (3, 1), (7, 7)], True),
        ([], True),
        ([(2, 1)], False),
        ([(1, 1), (2, 1), (3, 2)], False),
        ([(1, 1), (2, 2), (3, 1), (3, 2)], False),
    ],
)
def test_rounds_end_when_each_id_is_linked_to_its_smallest_alone(few_partitions, edges, settled):
    assert shared._settled(few_partitions.createDataFrame(edges, "u long, v long")) == settled


def test_membership_is_exact_whatever_the_filter_lets_through(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (9,), (None,)], "doc_id long")
    assert sorted(tuples(shared.with_ids(rows, ids, "doc_id").select("text"))) == [("b",), ("c",)]
    assert sorted(tuples(shared.without_ids(rows, ids, "doc_id").select("text"))) == [("a",), ("d",)]


# Jaccard join


def near_copies(rng, n=40):
    """Texts in groups: copies, texts with a few words changed, chains of changes, and short ones."""
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    texts = {}
    for i in range(n):
        if i and rng.random() < 0.6:
            words = texts[rng.randrange(len(texts))].split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 40, 80, 120]))]
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_components_equal_those_of_all_pairs(few_partitions, seed, words, percent):
    texts = near_copies(random.Random(seed))
    texts |= {100: None, 101: "", 102: " \n ", 103: texts[0].upper(), 104: texts[1] + "  "}
    rows = [(i, t, i, "x") for i, t in texts.items()]
    random.Random(seed).shuffle(rows)
    documents = few_partitions.createDataFrame(rows, "doc_id long, text string, n long, token string")
    found = {r["doc_id"]: r for r in jaccard_join.jaccard_groups(documents, words, percent).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == plain.linked(texts, words, percent)
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(plain.shingles(t, words)) for i, t in texts.items()}


def test_a_large_group_is_opened_in_parts(few_partitions, monkeypatch):
    """One text with few or many words changed each time: hardly any copy is similar enough to the leader."""
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    monkeypatch.setattr(jaccard_join, "PART_MEMBERS", 7)
    monkeypatch.setattr(jaccard_join, "PART_QUERIES", 5)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    texts = {}
    for i in range(70):
        words = list(base) if i % 3 else texts[rng.randrange(i)].split(" ") if i else list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        texts[i] = " ".join(words)
    documents = few_partitions.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(documents, 3, 90).collect()}
    expected = plain.linked(texts, 3, 90)
    assert found == expected and 5 < len(set(expected.values())) < 60


def test_empty_and_null_ids(few_partitions):
    empty = few_partitions.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_groups(empty).count() == 0
    rows = few_partitions.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    found = sorted(tuples(jaccard_join.jaccard_groups(rows)), key=str)
    assert found == [(3, 2, 3, 3), (3, 2, 3, 3), (None, 2, None, None)]


# Mix


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, None: 50, "d": 0}, {"x": 7}, {"a": 0}])
def test_targets_are_shared_until_none_is_above(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx(plain.water_fill(sizes, mixing.WEIGHTS, mixing.MOST_COPIES))


def test_mix_is_near_its_targets_and_repeats_itself(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", None, "d"]), "k") for i in range(3000)]
    rows += [(None, None, "a", "k"), (7, "", "e", "k"), (7, "", "e", "k")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed = mixing.mix(documents)
    found = tuples(mixed)
    assert len(found) == len(rows) and sorted(found, key=str) == sorted(tuples(mixing.mix(documents.repartition(7))), key=str)
    by = {}
    for _, size, source, source_size, target, copies, taken in found:
        assert taken == copies * size and copies <= 3
        total = by.setdefault(source, [source_size, target, 0, 0])
        total[2] += taken
        total[3] += size
    for source_size, target, taken, size in by.values():
        assert size == source_size and abs(taken - target) <= 40
    kept = mixing.mixed_documents(documents)
    assert kept.columns == documents.columns
    copies = sum(r[5] for r in found)
    assert kept.count() == copies


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_size_classes_keep_the_order_of_sizes(spark):
    sizes = [*range(200), *[2**k + d for k in range(8, 62) for d in (-1, 0, 1)]]
    frame = spark.createDataFrame([(s,) for s in sizes], "size long")
    classes = [r[0] for r in frame.select("size", mixing.size_class(F.col("size")).alias("c")).orderBy("size").select("c").collect()]
    assert classes == sorted(classes) and max(classes) < 1024 and len(set(classes)) > 170


# Forest


def brute(vectors, queries, k):
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], float)
    found = {}
    for q in queries:
        score = np.sqrt(((matrix - np.array(vectors[q], float)) ** 2).sum(axis=1))
        found[q] = [(i, s) for s, i in sorted(zip(score, ids, strict=True)) if i != q][:k]
    return found


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    exact = brute({r["vec_id"]: r["embedding"] for r in rows}, [r["vec_id"] for r in rows if r["vec_id"] % 100 == 0], 10)
    found = op10_hash_forest(spark, folder).collect()
    hits = sum(r["vec_id"] in {i for i, _ in exact[r["query_id"]]} for r in found)
    assert len(found) == 10 * len(exact) and hits >= 0.9 * len(found)


@pytest.mark.parametrize("options", [{}, {"share": 0.0, "enough": 40, "block_rows": 16}])
def test_copies_ties_and_vectors_that_take_no_part(spark, options):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=4).astype(np.float32).tolist() for i in range(60)}
    vectors |= {i: [1.0, 2.0, 3.0, 4.0] for i in range(100, 130)}
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan")] * 4), (204, [1.0]), (None, [1.0] * 4)]
    rows = [(i, v, 1) for i, v in [*vectors.items(), *odd, (5, vectors[5])]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry int")
    asked = [0, 5, 100, 129]
    found = {}
    for r in ann.search(frame, frame.filter(F.col("vec_id").isin(*asked, 201)), **options).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(asked)
    exact = brute(vectors, asked, 10)
    assert found[129] == [(i, 0.0) for i in range(100, 110)] and found[100] == [(i, 0.0) for i in range(101, 111)]
    if not options:
        for q in asked:
            assert [i for i, _ in found[q]] == [i for i, _ in exact[q]]
            assert [s for _, s in found[q]] == pytest.approx([s for _, s in exact[q]], rel=1e-12)


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert tuples(ann.search(frame, frame.filter("vec_id = 0"))) == [(0, 1, 1, 1.0)]
    assert ann.search(frame.limit(0), frame).count() == 0 and ann.search(frame, frame.limit(0)).count() == 0


# Pipeline


def test_pipeline_keeps_what_it_should(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r for r in documents.collect()}
    items = [plain.shingles(r["text"], 5) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = corpus_pipeline.identify_languages(spark, documents, FOLDER)
    assert kept.columns == documents.columns and kept.count() >= 0.98 * len(texts)
    unique = corpus_pipeline.drop_near_copies(spark, kept, FOLDER)
    known = {r["doc_id"]: r["text"] for r in kept.collect()}
    groups = plain.linked(known, corpus_pipeline.DEDUP_WORDS, corpus_pipeline.DEDUP_PERCENT)
    assert {r["doc_id"] for r in unique.collect()} == set(groups.values())
    clean = corpus_pipeline.drop_benchmark_copies(spark, unique, FOLDER)
    ids = {r["doc_id"] for r in clean.collect()}
    for i in set(groups.values()):
        most = max((len(plain.shingles(known[i], 5) & t) / len(t) for t in items if t), default=0)
        assert most <= 0.9 if i in ids else most >= 0.5
    mixed = corpus_pipeline.mix_sources(spark, clean, FOLDER)
    assert mixed.columns == documents.columns and {r["doc_id"] for r in mixed.collect()} <= ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "source_mix", "token_files"]
    written = corpus_pipeline.write_tokens(spark, mixed, FOLDER).collect()
    assert len(written) == mixed.count() and sum(r["start"] == 0 for r in written) == 1


def test_stages_take_odd_rows_and_other_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "row", "copies", "slot", "token", "hash", "secrets"]
    extra = (1, 2, 3, 4, 5, 6, 7)
    english, german = "the of and that is in thing", "der und die das nicht mit zu"
    rows = [
        (1, english, "en", "a", None, *extra), (1, english, "en", "a", None, *extra), (2, None, None, None, None, *extra),
        (3, "", "en", None, 0, *extra), (4, german, "de", None, 3, *extra), (None, english, "en", "b", 3, *extra),
        (6, " ".join([german] * 9000), "de", "b", 3, *extra), (7, "12 %", None, "b", 3, *extra),
    ]
    kinds = ["long", "string", "string", "string", "long", *["int"] * 7]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    docs = spark.createDataFrame(rows, schema)
    for start in (docs, docs.limit(0)):
        known = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            known = stage(spark, known, FOLDER)
            assert known.columns == names, name
            assert {tuple(r)[5:] for r in known.collect()} <= {extra}
        written = corpus_pipeline.write_tokens(spark, known, FOLDER)
        assert written.count() == known.count()
    kept = corpus_pipeline.identify_languages(spark, docs, FOLDER)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 4, 6]


def test_language_stage_leaves_out_only_texts_without_letters(spark, monkeypatch):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "12 %", None), (-2, None, None)], "doc_id long, text string, lang string")
    docs = documents.unionByName(odd)
    # Every prediction counts as ambiguous, as of bilingual texts.
    identify = corpus_pipeline.language_id.identify
    monkeypatch.setattr(corpus_pipeline.language_id, "identify", lambda *a: identify(*a, ambiguous_below=2.0))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, FOLDER).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_languages(spark, unlabelled, FOLDER).count() == docs.count()

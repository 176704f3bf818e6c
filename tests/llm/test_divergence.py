"""The source audit against a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkseek.llm import divergence
from tests.llm.plain import LOWER


def plain_audit(rows, least=10, top=10):
    counts, docs, places = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        places.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang, _ in places}
    total = defaultdict(Counter)
    for lang, source in places:
        total[lang].update(counts[lang, source])
    found = []

    def p(c, terms):
        n = sum(c[t] for t in terms)
        return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(terms)) for t in terms}

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    for lang, source in places:
        own, whole = p(counts[lang, source], kept[lang]), p(total[lang], kept[lang])
        pairs = []
        for _, other in (x for x in places if x[0] == lang and x[1] != source):
            theirs = p(counts[lang, other], kept[lang])
            pairs.append((other, sum(f(own[t], theirs[t]) for t in kept[lang])))
        terms = [(t, f(own[t], whole[t])) for t in kept[lang] if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            found += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(found)


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows_of(rng, n=260):
    words = [f"{a}{b}" for a in ("ab", "CD", "é", "x中") for b in ("", "e", "Fg", "ü", "zz")] + ["The", "of"] * 20
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(n)]
    return [*rows, (None, "en", "s9"), ("", "", "s1"), ("12 34", "lonely", "s1"), ("few words", "lonely", "s2"), ("one", "single", "s1"), rows[0], rows[0]]


@pytest.mark.parametrize(("terms", "sources", "gathered"), [(4096, 32, 200_000), (3, 2, 20)])
def test_audit_equals_the_plain_one_whatever_the_cuts(few_partitions, monkeypatch, terms, sources, gathered):
    monkeypatch.setattr(divergence, "SEGMENT_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    rows = rows_of(random.Random(5))
    table = few_partitions.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n long")
    assert sorted(tuple(r) for r in divergence.audit(table).collect()) == plain_audit(rows)


def test_an_empty_table_has_no_audit(few_partitions):
    table = few_partitions.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(table).count() == 0


def test_a_very_long_text(few_partitions):
    rows = [("alpha beta " * 300_000, "en", "a"), *[("alpha", "en", "b"), ("beta", "en", "c")] * 10]
    table = few_partitions.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(table).collect()) == plain_audit(rows)


def test_equal_subtrees_are_one_node():
    counts = np.array([[0, 0, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0]])
    trees = divergence.Trees(counts)
    # Leaves 0, 1, 2; above them (0, 0) and (1, 2); above those three different halves, and two roots.
    assert [len(left) for left, _ in trees.children] == [2, 2, 2]
    whole = np.array([20, 22])
    p, q = divergence.probability(counts[0], whole[0]), divergence.probability(counts[1], whole[1])
    assert trees.priced(0, np.array([1]), whole).tolist() == [int(divergence.price(p, q).sum())]


@pytest.mark.parametrize("count", [0, 7, 10**12, 9 * 10**14])
def test_probabilities_are_exact(count):
    whole = np.array([count + 4, 2 * count + 12345, 8 * 10**15])
    assert divergence.probability(np.array(count), whole).tolist() == [1 + 10**9 * (count + 2) // int(w) for w in whole]


def test_a_worker_that_imports_the_module_alone_has_all_it_calls(monkeypatch):
    """Workers import pyarrow, not its compute module; whether something else did must not matter."""
    key = tuple(pa.scalar(x) for x in ("en", 0, 0, 0))
    kinds = [("source", pa.string()), ("term", pa.string()), *[(c, pa.int64()) for c in ("n", "total", "v", "width", "block")]]
    marks = [("a", None, 3, 3, 1, 1, 0), ("b", None, 0, 3, 1, 1, 0), ("a", "x", 3, 3, 0, 0, 0)]
    rows = pa.Table.from_pylist([dict(zip([n for n, _ in kinds], r, strict=True)) for r in marks], pa.schema(kinds))
    expected = divergence._audited(key, rows).to_pydict()
    monkeypatch.delattr(pa, "compute", raising=False)
    assert divergence._audited(key, rows).to_pydict() == expected
    assert expected["part"].count("pair") == 2

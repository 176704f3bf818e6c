"""Spelling variants against a plain version that compares all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkseek.llm import shared, spelling
from sparkseek.llm.queries import op11_spelling_variants
from tests.llm.plain import LOWER


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocabulary):
    near = {w: [x for x in vocabulary if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in vocabulary}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 10 * vocabulary[w] else None
    rows = set()
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return rows


def documents_of(rng, n=300):
    letters = "abcdefghijklmnopqrstuvwxyzé×ßÉ"
    common = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 8, 9, 12]))) for _ in range(40)]
    rows = []
    for i in range(n):
        found = []
        for _ in range(60):
            word = common[min(int(rng.expovariate(0.15)), len(common) - 1)]
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("xyz") + word[at + 1 :], word[:at] + "q" + word[at:]])
            found.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i, " ".join(found)))
    return rows


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_equal_those_of_all_pairs(spark, symbols):
    rows = [*documents_of(random.Random(symbols)), (None, "Weathering weathering"), (7, None), (8, ""), (9, "1234 !?")]
    rows += [(5000 + i, "chainedword " * 3000 + "chainedwords " * 250 + "chainedwordsy " * 20 + "chainedxwordsy") for i in range(2)]
    expected = plain_variants(plain_vocabulary(rows))
    documents = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, word string, n long")
    found = {tuple(r) for r in spelling.spelling_forms(spelling.vocabulary(documents), symbols).collect()}
    assert found == expected
    assert any(form is not None and root != form for _, form, root, *_ in expected)


def test_the_neighbourhood_of_a_reduced_word_is_whole():
    """Every reduced word one edit away has one hash among the generated ones, or generates the word's own."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(200)})
    found, begins = spelling.symbols_of(words, 3)
    keys, owners, others = spelling.neighbourhoods(found, begins, 3)
    made = set(zip(owners.tolist(), others.tolist(), strict=True))
    assert len(made) == len(owners)
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            if a < b:
                assert ((a, int(keys[b])) in made) + ((b, int(keys[a])) in made) == one_edit(x, y)


def test_a_very_long_word_takes_room_in_proportion(spark):
    word = "ab" * 150_000
    documents = spark.createDataFrame([(1, word), (1, word), (2, word[1:]), (2, word[1:])], "doc_id long, text string")
    found = {len(r["word"]): r["n_near"] for r in spelling.spelling_forms(spelling.vocabulary(documents, thin=False)).collect()}
    assert found == {300_000: 1, 299_999: 1}


def test_an_empty_table_has_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_query_reads_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op11_spelling_variants(spark, folder).collect()} == plain_variants(plain_vocabulary(rows))


def test_the_bit_table_has_every_key(spark):
    keys = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)]
    table = shared.bit_table(spark.createDataFrame([(k,) for k in keys], "key long"), "key", 1 << 17)
    assert len(table) == (1 << 17) // 8
    assert shared.passing(table, spelling._slot(np.array(keys), 1 << 17)).all()

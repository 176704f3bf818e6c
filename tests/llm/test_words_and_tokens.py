"""Word hashes, token files and their grammar against plain Python and the tokenizers library."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.llm import shared
from sparkseek.llm import token_files as t
from sparkseek.llm import words as w
from sparkseek.llm.queries import tokenizer_path
from sparkseek.llm.shared import new_folder
from tests.llm.plain import shingles

TEXTS = [
    None,
    "",
    " ",
    "one",
    "One two\tTHREE\nfour",
    "ä Ö über  straße\r\n",
    "a b a b a b a b",
    "it's l'eau don't 'tis x'y",
    "tab\there \n\n new  lines \n",
    "漢字 and 😀 emoji nbsp  x",
    "12,5 % of 3kg... (really?!) <|endoftext|> #2 #",
    "x" * 5000,
    "end blank ",
    " \n \n",
    "À×÷ÿĀɏɐ",
]


@pytest.fixture(scope="module")
def encoder():
    return t.Encoder(tokenizer_path())


def plain_ids(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, t.END_ID]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets_have_the_size_and_overlap_of_plain_ones(k):
    found = list(w.shingle_sets(pa.array(TEXTS, pa.string()), k))
    plain = [shingles(x, k) for x in TEXTS]
    assert [len(x) for x in found] == [len(x) for x in plain]
    for a, x in zip(found, plain, strict=True):
        for b, y in zip(found, plain, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_hashes_do_not_depend_on_the_place_in_a_batch():
    texts = ["a b c d", "zz a b c d"]
    alone = list(w.shingle_sets(pa.array(texts[:1]), 3))[0]
    both = list(w.shingle_sets(pa.array(["x y", *texts]).slice(1), 3))
    assert (both[0] == alone).all() and np.isin(alone, both[1]).all()


def test_pieces_hold_every_row_once_and_long_texts_alone():
    batch = pa.record_batch({"id": list(range(6)), "text": ["a", "b" * 100, None, "", "c" * 5, "d" * 30]})
    parts = list(w.pieces(batch, "text", 20))
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(6))
    assert max(len(p) for p in parts) > 1
    assert list(w.pieces(batch.slice(0, 0))) == []


def test_whole_texts_get_the_ids_of_the_library(encoder):
    ids, begins = encoder.encode(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        assert ids[begins[i] : begins[i + 1]].tolist() == plain_ids(encoder, text), repr(text)


def test_added_tokens_get_the_ids_of_a_fresh_tokenizer(encoder):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    added = [x.content for x in fresh.get_added_tokens_decoder().values()]
    texts = [*TEXTS, *(f"{a}{x}{b}" for x in added for a in ("", "x ", "y") for b in ("", " y", x, "\n")), "plain <|endoftext |>"]
    ids, begins = encoder.encode(pa.chunked_array([pa.array(texts, pa.string())]).combine_chunks())
    for i, text in enumerate(texts):
        assert ids[begins[i] : begins[i + 1]].tolist() == [*fresh.encode(text or "", add_special_tokens=False).ids, t.END_ID]
    assert any(50256 in fresh.encode(x or "", add_special_tokens=False).ids for x in texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9é'ſ.\n\t \r×ÿß# 漢", max_size=25), max_size=5))
def test_any_texts_get_the_ids_of_the_library(texts):
    encoder = t._encoder(tokenizer_path())
    ids, begins = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[begins[i] : begins[i + 1]].tolist() == plain_ids(encoder, text)


def test_a_full_cache_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(t, "CACHED", 3)
    own = t.Encoder(tokenizer_path())
    for text in ["aa bb cc dd ee ff", "aa gg hh", "bb ii jj kk ll mm"]:
        ids, _ = own.encode(pa.array([text]))
        assert ids.tolist() == plain_ids(own, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(6, 20))
def test_grammar_round_trip(ids, base):
    ids = np.array(ids, np.int32)
    assert (t.decompress(*t.compress(ids, base), base) == ids).all()


def test_frequent_pairs_are_replaced_but_never_across_an_end():
    ids = np.tile([5, 6, 7, 8, t.END_ID], 200).astype(np.int32)
    symbols, rules, lengths = t.compress(ids, 10)
    assert len(symbols) < len(ids) / 2 and len(rules) == len(lengths) > 0
    for symbol in np.unique(symbols):
        expanded = t.decompress(np.array([symbol]), rules, lengths, 10).tolist()
        assert t.END_ID not in expanded[:-1]


def test_files_hold_all_documents_in_order(spark, encoder, monkeypatch):
    monkeypatch.setattr(t, "SHARD_IDS", 50)
    rows = [(i * 7 % 40, TEXTS[i % len(TEXTS)], "s") for i in range(40)] + [(3, "again", "s"), (None, "no id", "s")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    path = new_folder(spark, "test-tokens")
    t.write_token_files(documents, path, tokenizer_path())
    found = sorted(t.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    texts = {}
    for i, text, _ in rows:
        texts.setdefault(i, []).append(np.array(plain_ids(encoder, text), "<u4"))
    start = 0
    for r in found:
        assert r["start"] == start
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in texts[r["doc_id"]]]
        start += r["n_tokens"]
    shard = spark.read.parquet(path).orderBy("part", "chunk").collect()[-1].asDict()
    k = len(shard["doc_ids"]) - 1
    assert t.document_ids(shard, k).tolist() in [x.tolist() for x in texts[shard["doc_ids"][k]]]


def test_no_documents_make_no_shard(spark):
    path = new_folder(spark, "test-tokens")
    t.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path())
    assert t.read_documents(spark, path).count() == 0


def test_no_frequent_pair_is_left_and_counts_are_exact():
    """Also where many pairs share a slot, and more rules than 16 bits name are needed."""
    rng = np.random.default_rng(3)
    base = 60_000
    words = [rng.integers(10, base, rng.integers(2, 9)) for _ in range(2_500)]
    ids = np.concatenate([np.r_[np.concatenate([words[i] for i in rng.integers(0, len(words), 30)]), t.END_ID] for _ in range(2_500)]).astype(np.int32)
    symbols, rules, lengths = t.compress(ids, base)
    assert (t.decompress(symbols, rules, lengths, base) == ids).all()
    assert base + len(rules) > 1 << 16
    closes = {t.END_ID}
    for r, (_, right) in enumerate(rules.tolist()):
        if right in closes:
            closes.add(base + r)
    pairs = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
    assert max(n for (a, _), n in pairs.items() if a not in closes) < t.LEAST_COUNT
    assert len(symbols) < len(ids) / 3


@pytest.mark.parametrize("most", [1 << 27, 1 << 16])
def test_ids_tell_documents_near_and_far_apart(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "MOST_SLOTS", most)
    keys = [None, 0, 1, -1, 7, 7, 32_767, 32_768, -40_000, 10**15, -(2**63), 2**63 - 1]
    listed = [None, 1, 7, 7, 32_768, -40_000, 10**15 + 1, -(2**63)]
    documents = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in listed], "doc_id long")
    for given in (listed, []):
        found = shared.told_by_ids(documents, ids if given else ids.limit(0), "doc_id", "good")
        assert found.columns == ["doc_id", "text", "good"]
        wanted = sorted((str(k), k is not None and k in given) for k in keys)
        assert sorted((str(r["doc_id"]), r["good"]) for r in found.collect()) == wanted

"""Token counts by heap and linked list."""

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomsky.llm import token_counts as tc
from loomsky.llm.queries import QUERIES, vocabulary

from ..conftest import SF


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(vocabulary())
    return tc.Counter(vocabulary()), lambda texts: [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_against_the_library(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, len(d.text.encode()), n, n > 512) for d, n in zip(docs, both[1]([d.text for d in docs])))
    assert sorted(tuple(r) for r in QUERIES["op13_bpe_token_counts"](spark, SF).collect()) == want


def test_odd_texts(both):
    rng = random.Random(1)
    parts = [
        *"abcAZ09 \n\t'  !?<|>,.-_\r\v\f\x1c\x1f\x00", "<|endoftext|>", "'s", "'re", "'LL", "\x85", "\xa0", "　", "​", "᠎", "﻿", " ",
        "é", "é", "中", "文", "😀", "👨‍👩", "١", "²", "ﬃ", "\U000e0041", "don't", "ththth", "aaaa", "Ġ", "the", "ation",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(8000)]
    texts += ["1" + chr(i) + "!" + chr(i) + "a" for i in range(0, 0x110000, 97) if not 0xD800 <= i < 0xE000]
    texts += ["a" * 30_000, "ab" * 9_000, "中" * 5_000, " " * 5_000 + "x", "\n" * 3_000, "".join(rng.choices("abcdefgh", k=60_000)), " the" * 50_000]
    assert list(map(both[0], texts)) == both[1](texts)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_any_text(both, text):
    assert [both[0](text)] == both[1]([text])


def test_heap_takes_the_least_rank_and_then_the_first_place():
    """Against merging the least pair's first occurrence, found anew each time."""
    symbols = "abcd"
    merges = [("a", "b"), ("b", "c"), ("ab", "ab"), ("c", "d"), ("a", "a"), ("aa", "b"), ("bc", "d")]
    model = {"vocab": {s: i for i, s in enumerate([*symbols, *(a + b for a, b in merges)])}, "merges": [list(p) for p in merges]}
    counted = tc.Merges(model)
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choices(symbols, k=rng.randint(1, 14)))
        s = list(word)
        while pairs := [(merges.index(p), i) for i, p in enumerate(zip(s, s[1:])) if p in merges]:
            i = min(pairs)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        assert counted.count(word) == len(s)


def test_memory_is_bounded(both, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    counter = tc.Counter(vocabulary())
    texts = [f"number{i} of{i * 7} things {'y' * (i % 400)}" for i in range(500)]
    assert list(map(counter, texts)) == both[1](texts)
    assert len(counter.pieces) < 60 and len(counter.words) < 60 and max(map(len, counter.pieces)) <= tc.LONGEST


def test_edges_of_input(spark, both, tmp_path):
    rows = [(1, None, 1), (2, "", 1), (2, "twice twice", 1), (None, "<|endoftext|>é", 1), (4, "x " * 600, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = sorted((tuple(r) for r in tc.token_counts(df, vocabulary()).collect()), key=lambda r: (r[0] or 0, r[2]))
    n = both[1]([t or "" for _, t, _ in rows])
    assert got == [(None, 15, n[3], False), (1, 0, 0, False), (2, 0, 0, False), (2, 11, n[2], False), (4, 1200, n[4], True)] and n[4] > 512
    assert tc.token_counts(df.limit(0), vocabulary()).collect() == []
    with pytest.raises(ValueError):
        tc.Counter(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(vocabulary()))
    spec["model"]["ignore_merges"] = True
    (tmp_path / "odd.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tc.Counter(str(tmp_path / "odd.json"))

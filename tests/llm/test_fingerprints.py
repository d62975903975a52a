"""Fingerprints and token files."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomsky.llm import fingerprints as fp
from loomsky.llm import token_files as tf
from loomsky.llm.queries import QUERIES, vocabulary

from ..conftest import SF


def shingles(text, n=fp.SHINGLE):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in QUERIES["op6_one_permutation_fingerprints"](spark, SF).collect()}
    errors, by_text = [], {}
    for d, nxt in zip(docs, docs[1:] + docs[:1]):
        q = len(d.text) // 4
        edited = d.text[: len(d.text) - q] + nxt.text[:q]
        r = rows[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(shingles(d.text), shingles(edited)), r.near_next - jaccard(shingles(d.text), shingles(nxt.text))]
        by_text.setdefault(d.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len(rows) == len(docs) and abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_edges_of_input(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one two", "x"), (5, "ONE  two", "x"), (5, "other", "x"), (None, "abcd", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint_bins string")
    got = sorted(fp.edited_fingerprints(df).collect(), key=lambda r: (r.doc_id or 0, r.n_chars))
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5]
    none, one, two, three, four, other, five = got
    assert one.fingerprint == two.fingerprint == three.fingerprint == "" and one.near_next == 1.0 and three.near_next == 0.0
    assert four.fingerprint == five.fingerprint and len(four.fingerprint) == fp.BINS * fp.BITS // 4
    assert none.edited_sha256 == hashlib.sha256(b"abc").hexdigest()
    assert fp.edited_fingerprints(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fp.fingerprints(df, bins=100)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=300))
def test_packing_round_trip(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], np.uint32)
    assert (tf.unpack(tf.pack(ids, bits), bits, len(ids)) == ids).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "\n", "\t", "1", ".", "é", "'s", "\u3000", "\xa0", "<|endoftext|>", "中", "\x1c", "²", "<", "|", "  "]), max_size=16).map("".join))
def test_encoder_equals_the_library(text):
    assert test_encoder_equals_the_library.encode(text).tolist() == test_encoder_equals_the_library.library.encode(text, add_special_tokens=False).ids


test_encoder_equals_the_library.encode = tf.Encoder(vocabulary())
test_encoder_equals_the_library.library = Tokenizer.from_file(vocabulary())


def test_encoder_remembers_a_word_once(monkeypatch):
    encode, library = tf.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    texts = ["plain words of letters", "words, of letters.", "\nplain 12 <|x", "letters *** of words", "Ärger words,"]
    ids = lambda: [encode(t).tolist() for t in texts]
    assert ids() == [library.encode(t, add_special_tokens=False).ids for t in texts]
    held = [k for v in vars(encode).values() if isinstance(v, dict) for k in v]
    assert len(held) == len(set(held)) and {"words", "words,", ","} < set(held)
    monkeypatch.setattr(tf, "REMEMBERED", 3)
    assert ids() == [library.encode(t, add_special_tokens=False).ids for t in texts] and len(encode.pieces) < 5


def test_query_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in QUERIES["op7_packed_token_ids"](spark, SF).collect()}
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for d in docs:
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 2]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert len(rows) == len(docs)


def test_shards_blocks_and_access(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900), i) for i in range(300)] + [(None, "none", 0), (7, "seven", 0), (8, None, 0)], "doc_id long, text string, start long")
    shards = tf.write_tokens(docs, vocabulary(), parts=3, shard_ids=20_000)
    listed = shards.orderBy("part", "piece").collect()
    assert len(listed) > 4 and sum(s.n_docs for s in listed) == 303
    library = Tokenizer.from_file(vocabulary())
    shard = tf.Shard(listed[0].path)
    assert not shard.known[0] and shard.document(0).tolist() == [*library.encode("none").ids, 2]
    assert shard.bits == 16 and shard.ids(3, 3).tolist() == []
    for s in listed:
        opened = tf.Shard(s.path)
        i = s.n_docs - 1
        text = "word " * (int(opened.doc_ids[i]) * 37 % 900)
        if opened.doc_ids[i] not in (7, 8):
            assert opened.document(i).tolist() == [*library.encode(text).ids, 2]
    read = tf.read_tokens(shards).orderBy("start").collect()
    assert [r.start for r in read] == [0, *np.cumsum([r.n_tokens for r in read])[:-1]]
    assert read[0].doc_id is None
    assert [r.doc_id for r in read][1:] == sorted([*range(300), 7, 8])
    assert tf.read_tokens(tf.write_tokens(docs.limit(0), vocabulary())).collect() == []


def test_blocks_longer_than_one(tmp_path):
    ids = [np.arange(tf.BLOCK * 2 + 5, dtype=np.uint32) % 50257, np.array([2], np.uint32)]
    path = tmp_path / "s.bin"
    path.write_bytes(tf.shard_bytes([1, 2], ids, 16))
    shard = tf.Shard(f"file://{path}")
    assert (shard.document(0) == ids[0]).all() and shard.document(1).tolist() == [2]
    assert (shard.ids(tf.BLOCK - 3, tf.BLOCK + 4) == ids[0][tf.BLOCK - 3 : tf.BLOCK + 4]).all()
    path.write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        tf.Shard(f"file://{path}")

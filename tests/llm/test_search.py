"""Block-Max MaxScore search."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from loomsky.llm import search as s
from loomsky.llm.oracles import SEARCH_SQL
from loomsky.llm.queries import QUERIES

from ..conftest import SF


def brute(docs, items, k=20):
    """(item number, rank, doc_id, score), scored document by document."""
    words = lambda t: re.findall(s.TERM, (t or "").translate(str.maketrans(s.UPPER, s.LOWER)))
    each = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in each), sum(c.total() for _, c in each)
    df = Counter(w for _, c in each for w in c)
    out = []
    for number, text in enumerate(items):
        scores = []
        for d, c in each:
            m = 75 + 25 * c.total() * n_docs // n_terms if n_terms else 0
            total = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m))
                for w in words(text) if w in c
            )
            if total > 0:
                scores.append((-total, d is None, d or 0, d))
        out += [(number, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return out


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string")
    q = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, shard int")
    return sorted(tuple(r) for r in s.search(s.write_index(d, **options), q).collect())


def test_query_against_duckdb(spark):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = duck.execute(SEARCH_SQL).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op11_block_max_search"](spark, SF).collect()) == sorted(want) and len(want) == 800


@pytest.mark.parametrize("shard_bytes", [300, 5_000, 1 << 30])
def test_against_brute_force_with_ties_and_repeats(spark, monkeypatch, shard_bytes):
    rng = random.Random(shard_bytes)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 60])))) for i in range(300)]
    docs += docs[:40] + [(1000 + i, docs[7][1]) for i in range(50)]  # rows with the same doc_id, and equal texts
    rng.shuffle(docs)
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 8, 30]))) for _ in range(40)]
    monkeypatch.setattr(s, "ITEMS", 10)  # several groups of items
    assert searched(spark, docs, items, shard_bytes=shard_bytes) == sorted(brute(docs, items))


def test_edges_of_input(spark):
    docs = [
        (1, None), (2, ""), (3, " \n--"), (4, "Über ÜBER über"), (5, "a-b_c 中文x A"), (None, "a a a"), (7, "a " * 40_000), (8, "\x85a　b"),
        (-9, "zzz"), (9, "zzz"), (9, "zzz"), (None, "zzz"),
    ]
    items = ["a", "über", "ÜBER", None, "", "...", "nowhere", "B c 中文X a a", "zzz zzz", "zzz" * 5000]
    got = searched(spark, docs, items)
    assert got == sorted(brute(docs, items), key=lambda r: r[:2]) and [r[2] for r in got if r[0] == 8] == [-9, 9, 9, None]
    assert searched(spark, [], ["a"]) == searched(spark, docs, []) == searched(spark, [(1, None)], ["a"]) == []
    # items that share an id are ranked each by itself
    both = spark.createDataFrame([(1, "zzz"), (1, "über"), (None, "zzz")], "item_id long, text string")
    index = s.write_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter((r.item_id, r["rank"]) for r in s.search(index, both).collect())[1, 1] == 2


def lists_of(rng, n_docs, sizes, weights):
    """Postings over ``n_docs`` documents of 10 to 2,000 terms."""
    lengths = rng.integers(10, 2000, n_docs)
    docs = [np.sort(rng.choice(n_docs, size, replace=False)) for size in sizes]
    tfs = [rng.integers(1, 300, len(d)) for d in docs]
    batch = s.postings(
        0, [b"%d" % i for i in range(len(docs))], np.repeat(np.arange(len(docs)), list(map(len, docs))), np.concatenate(docs), np.concatenate(tfs), lengths
    )
    made = [s.Postings(len(d), *(batch.column(c)[i].as_py() for c in ("heads", "body")), lengths, n_docs, int(lengths.sum())) for i, d in enumerate(docs)]
    total = np.zeros(n_docs, np.int64)
    for d, tf, w in zip(docs, tfs, weights):
        total[d] += w * s.impact(tf, lengths[d], n_docs, int(lengths.sum()))
    return [(p, w) for p, w in zip(made, weights)], total, list(zip(docs, tfs))


def test_codec_and_pruning():
    rng = np.random.default_rng(3)
    weights = [9000, 5000, 700, 90, 10]
    lists, total, raw = lists_of(rng, 200_000, [300, 900, 60_000, 120_000, 199_000], weights)
    want = np.lexsort((np.arange(len(total)), -total))[:20]
    top, scores = s.best(lists, 200_000, 20)
    assert top.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    # rare lists decide: most blocks of the frequent ones were never decompressed
    assert all(p.done.mean() < 0.5 for p, w in lists if w <= 700)
    for (p, _), (docs, tf) in zip(lists, raw):
        p.decompress(np.arange(len(p.heads)))
        assert (p.docs == docs).all() and (p.impacts == s.impact(tf, p.lengths[docs], *p.of)).all()
        assert all(b >= p.impacts[i * s.BLOCK : (i + 1) * s.BLOCK].max() for i, b in enumerate(p.bounds))


def test_wide_gaps_and_counts():
    lengths = np.full(1 << 20, 2_000_000)
    docs, tf = np.array([0, 1, 300, 70_000, (1 << 20) - 1]), np.array([1, 70_000, 255, 256, 1_000_000])
    batch = s.postings(5, [b"x"], np.zeros(5, int), docs, tf, lengths)
    p = s.Postings(5, batch.column("heads")[0].as_py(), batch.column("body")[0].as_py(), lengths, 1 << 20, 1 << 40)
    p.decompress(np.array([0]))
    assert p.docs.tolist() == docs.tolist() and p.impacts.tolist() == s.impact(tf, lengths[docs], 1 << 20, 1 << 40).tolist()

"""Near-duplicates, line deduplication and their parts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.llm import line_dedup, linking, near_dup
from loomsky.llm.common import components
from loomsky.llm.fingerprints import with_next
from loomsky.llm.linking import linked_components
from loomsky.llm.queries import QUERIES

from ..conftest import SF


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def word_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n):
    sets = {i: word_set(t, n) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return closure(sets, links), {i: len(s) for i, s in sets.items()}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected, sizes = brute(texts, 2)
    rows = QUERIES["op5_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_hot_group_of_edited_copies(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    texts = {}
    for i in range(150):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8])):
            t[r.randrange(60)] = r.choice(words)
        texts[i] = " ".join(t)
    expected, _ = brute(texts, 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(df, shingle_words=2).collect()}
    assert got == expected and len(set(expected.values())) > 3


def test_edges_of_input(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "one", 3), (4, "ONE", 4), (5, " \t\n", 5), (6, "a b c", 6), (6, "d e f", 7), (None, "a b c", 8), (7, "d e f", 9), (8, "x" * 300_000, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, shingle_words=2).collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False), (8, 1, 8, True)]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        near_dup.near_duplicates(df, bits=20)


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({n for e in clean for n in e}, clean)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_linking_loses_no_pair_of_a_bucket(spark):
    r = random.Random(4)
    sets = {}
    for i in range(120):
        size = r.randrange(3, 12)
        sets[i] = sorted(r.sample(range(14), size))
    met = spark.createDataFrame([(0, i, 120) for i in sets], "key long, rep long, members long")
    table = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    got = {x.node: x.component for x in linked_components(met, table, 80).collect()}
    s = {i: set(v) for i, v in sets.items()}
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    expected = closure(s, links)
    assert {i: got.get(i, i) for i in s} == expected


def test_small_buckets_need_no_centre(spark, monkeypatch):
    r = random.Random(5)
    sets = {i: sorted({*range(k := i // 4 * 3, k + 12), *r.sample(range(200), i % 4)}) for i in range(80)}
    rows = [(i // 8 if i < 64 else 100 + i % 3, i, 8 if i < 64 else 5 + (i % 3 < 1)) for i in sets]
    met = spark.createDataFrame([*rows, (200, 0, 2), (200, 79, 2)], "key long, rep long, members long")
    table = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    monkeypatch.setattr(linking, "compared", None)  # what compares with centres
    got = {x.node: x.component for x in linked_components(met, table, 80).collect()}
    s, key = {i: set(v) for i, v in sets.items()}, {i: k for k, i, _ in rows}
    links = [(a, b) for a in s for b in s if a < b and (key[a] == key[b] or (a, b) == (0, 79)) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    expected = closure(s, links)
    assert links and {i: got.get(i, i) for i in s} == expected


def test_near_copies_in_small_buckets_are_compared_in_proportion_to_members(spark, monkeypatch):
    r = random.Random(13)
    sets = {i: sorted({*range(100)} - {*r.sample(range(100), 3)} | {1000 + i}) for i in range(60)}  # near copies
    sets |= {i: sorted({*range(30)} | {5000 + 100 * i + k for k in range(70)}) for i in range(60, 120)}  # these meet, but aren't alike
    sets |= {120 + i: [*range(20_000 + 40 * (i // 2), 20_037 + 40 * (i // 2) + i % 2 * 3)] for i in range(20)}  # pairs of their own
    rows = [(k, i, 40) for i in range(60) for k in range(6) if (i + 10 * k) % 60 < 40] + [(10 + i // 20, i, 20) for i in range(60, 120)] + [(20, i, 20) for i in range(120, 140)]
    met = spark.createDataFrame(rows, "key long, rep long, members long")
    table = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    kept, stored = [], linking.stored

    def spy(df):
        out = stored(df)
        if {"a", "b"} <= set(df.columns):
            kept.append(out.count())
        return out

    monkeypatch.setattr(linking, "stored", spy)
    got = {x.node: x.component for x in linked_components(met, table, 80).collect()}
    s, keys = {i: set(v) for i, v in sets.items()}, {i: {k for k, j, _ in rows if j == i} for i in sets}
    links = [(a, b) for a in s for b in s if a < b and keys[a] & keys[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    expected = closure(s, links)
    assert len(set(expected.values())) == 71 and {i: got.get(i, i) for i in s} == expected
    assert sum(kept) < 6 * len(sets), kept


def lines_brute(texts, n=10):
    first, sets = {}, {}
    for d in sorted(texts):
        for k, line in enumerate((texts[d] or "").split("\n")):
            line = line.strip(" ")
            if line:
                first.setdefault(line, (d, k))
                sets[line] = {line[i : i + n] for i in range(len(line) - n + 1)} or {line}
    order = sorted(first, key=first.get)
    number = {x: i for i, x in enumerate(order)}
    links = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order[i + 1 :], i + 1) if 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = closure(range(len(order)), links)
    out = {}
    for d, t in texts.items():
        if t is None:
            out[d] = None
            continue
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (kept[number[x.strip(" ")]] == number[x.strip(" ")] and first[x.strip(" ")] == (d, k)))
    return out


def test_lines_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 70")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines_brute(texts)


def test_lines_edges_of_input(spark):
    rows = [(1, "the same line here\n\nother words", 0), (2, "the same line here\nthe same line hexe of it", 0), (3, None, 0), (4, "", 0), (None, "the same line here", 0), (5, " ab \nab\nÄöü€𝄞 ßßßß zz\nÄöü€𝄞 ßßßß zz", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got[1] == (3, 3, rows[0][1]) and got[2] == (2, 1, "the same line hexe of it")
    assert got[3] == (0, 0, None) and got[4] == (1, 1, "") and got[None] == (1, 1, "the same line here")
    assert got[5] == (4, 2, " ab \nÄöü€𝄞 ßßßß zz")
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_linking_where_few_are_alike_to_the_centre(spark):
    r = random.Random(9)
    base, sets = list(range(60)), {}
    for i in range(150):  # variants of variants, and sets that share a third with all others
        s = set(base) - set(r.sample(base, r.choice([0, 2, 8, 9]))) | {100 + r.randrange(12) for _ in range(r.choice([0, 3, 6]))}
        sets[i] = sorted(s)
    for i in range(150, 230):
        sets[i] = sorted({*base[:20], *r.sample(range(200, 260), 40)} if i % 4 else {*base[:20], *range(200 + i % 3, 238 + i % 3)})
    met = spark.createDataFrame([(k, i, 115) for i in sets for k in (i % 2, 2)], "key long, rep long, members long")
    table = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    s = {i: set(v) for i, v in sets.items()}
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    expected = closure(s, links)
    assert 10 < len(set(expected.values())) < 220
    for rounds in (1, 2, 5):
        got = {x.node: x.component for x in linked_components(met, table, 80, rounds=rounds).collect()}
        assert {i: got.get(i, i) for i in s} == expected


def test_group_of_near_copies_has_few_centres_and_entries(spark, monkeypatch):
    r = random.Random(12)
    sets = {}
    for i in range(240):  # each lacks some items of the base and has as many of its own; few are alike to any other
        gone = r.sample(range(100), r.choice([2, 9, 14, 16]))
        sets[i] = sorted({*range(100)} - {*gone} | {1000 + 20 * i + k for k in range(len(gone))})
    # Six buckets that overlap, so that each could elect a centre of its own.
    met = spark.createDataFrame([(k, i, 120) for i in sets for k in range(6) if (i + 40 * k) % 240 < 120], "key long, rep long, members long")
    table = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    kept, stored = [], linking.stored

    def spy(df):
        out = stored(df)
        if {"item", "place"} <= set(df.columns):
            kept.append((out.select("centre").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(linking, "stored", spy)
    got = {x.node: x.component for x in linked_components(met, table, 80).collect()}
    s = {i: set(v) for i, v in sets.items()}
    share = lambda a, b: any((a + 40 * k) % 240 < 120 and (b + 40 * k) % 240 < 120 for k in range(6))
    links = [(a, b) for a in s for b in s if a < b and share(a, b) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    expected = closure(s, links)
    assert 20 < len(set(expected.values())) < 200 and {i: got.get(i, i) for i in s} == expected
    assert kept and all(centres <= 3 and rows <= 40 * len(sets) for centres, rows in kept), kept


def test_neighbours_across_buckets(spark):
    r = np.random.default_rng(0)
    ids = sorted({int(x) for x in np.concatenate([r.integers(0, 50, 20), r.integers(10**12, 10**12 + 5000, 900)])})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").orderBy(F.rand(1))
    got = {x.doc_id: x.next_text for x in with_next(df, "doc_id", ["text"]).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (2, "c")], "doc_id long, text string")
    assert sorted(x.next_text for x in with_next(ties, "doc_id", ["text"]).collect()) == ["a", "b", "c", "n"]
    assert with_next(ties.limit(0), "doc_id", ["text"]).collect() == []
    assert with_next(ties.where("doc_id = 2"), "doc_id", ["text"]).first().next_text == "c"


def test_long_and_repeating_lines_meet(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(300)]
    lines = []
    for size in (8, 20, 24, 28, 40, 90):  # around the border of the two indexes
        for _ in range(12):
            own = r.choices(words, k=size)
            lines.append(" ".join(own))
            own[r.randrange(size)] = r.choice(words)
            lines.append(" ".join(own))
    phrase = " ".join(r.choices(words, k=12)) + " "
    lines += [(phrase * k).strip() for k in (1, 2, 3, 9)] + ["x" * 5 + "".join(r.choices("abcdefgh", k=400))]
    lines.append(lines[-1] + "ab")
    texts = dict(enumerate(lines))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}
    assert got == lines_brute(texts)


def test_lines_at_the_border_share_a_key(spark):
    r = random.Random(7)
    word = lambda a, b: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(a, b)))
    long = lambda n, a=6, b=14: " ".join(word(a, b) for _ in range(n))[:n]
    cases = {"contained": [], "short words edited": [], "short": []}
    for _ in range(1500):
        line = long(1200)
        cases["contained"].append((line, line[: 9 + -(-(1200 - 9) * 4 // 5)]))
        head, tail = long(560), long(560)
        cases["short words edited"].append(tuple(f"{head} {long(120, 1, 3)} {tail}" for _ in "ab"))
        size = r.randrange(14, 40)
        line = long(size)
        cases["short"].append((line, line[: 9 + -(-(size - 9) * 4 // 5)]))
    for name, pairs in cases.items():
        sets = [[{x[i : i + 10] for i in range(len(x) - 9)} for x in p] for p in pairs]
        assert all(len(a & b) >= 0.8 * len(a | b) for a, b in sets) and sum(len(a & b) <= 0.85 * len(a | b) for a, b in sets) > 1000
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "rep long, a string, b string").repartition(4)
        one, two = (line_dedup.band_keys(df.select("rep", F.col(c).alias("line"))) for c in "ab")
        apart = len(pairs) - one.join(two, ["rep", "key"]).select("rep").distinct().count()
        assert apart <= 1, name

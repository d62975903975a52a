"""Merkle manifest in van Emde Boas order."""

import random
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.llm import merkle as m
from loomsky.llm.oracles import MERKLE_SQL
from loomsky.llm.queries import QUERIES

from ..conftest import SF

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute(docs):
    key = lambda d: (d[0] is not None, d[0] or 0, leaf(*d))
    sources = sorted({d[1] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([leaf(*d) for d in sorted((d for d in docs if d[1] == x), key=key)]) for x in sources}
    over = levels_of([trees[x][-1][0] for x in sources])
    rows = []
    for number, x in enumerate(sources):
        for i, d in enumerate(sorted((d for d in docs if d[1] == x), key=key)):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            low = d[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[4])
            now, proof = leaf(*d[:4], low) if hit else leaf(*d), ""
            for levels, at in ((trees[x], i), (over, number)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    a, b = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    proof, now, at = proof + a + b, h(a, now, b), at // 16
            rows.append((d[0], leaf(*d), trees[x][-1][0], over[-1][0], h(proof), now, now == over[-1][0]))
    return rows


def of(df, **options):
    return [tuple(r[c] for c in COLUMNS) for r in m.manifest(df, m.tampered(F.col("doc_id"), F.col("text")), **options).collect()]


def test_query_against_duckdb(spark):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()]
    want = duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({MERKLE_SQL})").fetchall()
    assert sorted(got) == sorted(want) and 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("height", [1, 2, 3])
def test_against_brute_force(spark, height):
    """Sources of 1 to 600 rows, and 40 sources, so that low blocks take several rounds; a run of one node is hashed too."""
    rng = random.Random(height)
    sizes = {None: 17, "": 1, "é": 16, "hot": 600, "a": 257, "b": 273, **{f"s{i}": 1 + i % 3 for i in range(40)}}
    docs = [(rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Ab", "x", "", None, "ÀZ" * 9])) for s, n in sizes.items() for _ in range(n)]
    docs += [docs[20]] * 3 + [(None, "hot", None, None, "T"), (None, None, None, None, None)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "clash", 1, "clash") for d in docs], SCHEMA)
    assert sorted(of(df, height=height), key=str) == sorted(brute(docs), key=str)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert of(empty) == []
    lone = [(5, None, None, None, None)]
    got = of(spark.createDataFrame([(*lone[0], "", 0, "")], SCHEMA))
    assert got == brute(lone) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("") and got[0][-1]
    long = [(1, "s", "en", 10**6, "Z" * 10**6), (2, "s", "en", 1, "q")]
    assert sorted(of(spark.createDataFrame([(*d, "", 0, "") for d in long], SCHEMA))) == sorted(brute(long))


def test_van_emde_boas_order():
    # two levels of two over each other: the root and its children, then each child's subtree
    for levels in range(1, 6):
        places = [m.address(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(m.nodes_of(levels)))
    root, children, grand, leaves = (m.address(4, d, np.arange(16**d)) for d in range(4))
    assert root.tolist() == [0] and children.tolist() == list(range(1, 17)) and grand[:2].tolist() == [17, 34]
    assert leaves[:17].tolist() == [*range(18, 34), 35]


@pytest.mark.parametrize("n", [1, 15, 16, 17, 255, 257, 4095, 4096])
def test_block(n):
    digests = np.frombuffer(b"".join(sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    block = m.Block.build(digests, 3)
    level = [d.tobytes().hex() for d in digests]
    for _ in range(3):
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    assert block.root.hex() == level[0]
    paths = block.paths([])
    assert len(paths) == n
    for i in {0, n // 2, n - 1}:
        assert m.folded(digests[i].tobytes().hex().encode(), paths[i]).decode() == level[0]
        assert n == 1 or m.folded(b"0" * 64, paths[i]).decode() != level[0]

"""Merkle manifest of a dataset: a hash tree over the leaves of each source, and one over the sources' roots.

Sixteen consecutive nodes become the hash of their digests, as hex text, until one is left. A tree is cut into aligned subtrees of
``HEIGHT`` levels of hashing, its blocks: a task builds one from at most 16 ** HEIGHT leaves, whatever the size of the source, and the
blocks' roots are the leaves of the next round. A block keeps its nodes in one value in van Emde Boas order: the levels are split at half
height, the top part is stored first and then each subtree below it, each part split alike. So a path from a leaf to the root stays
in few neighbouring pieces at every size of a cache line or page. ``address`` tells the place of a node from its depth and number alone; it
serves building and looking up siblings.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_up_to, stored

FAN, HEIGHT = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nodes_of(levels: int) -> int:
    """Nodes of a full tree of ``levels`` levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of nodes of a tree of ``levels`` levels in van Emde Boas order: ``number`` counts the nodes at ``depth`` from the root."""
    place = np.zeros(len(number), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = levels - top
        tree, number = np.divmod(number, FAN ** (depth - top))
        place += nodes_of(top) + tree * nodes_of(below)
        levels, depth = below, depth - top
    return place


class Block:
    """The nodes of a subtree of ``height`` levels of hashing over ``n`` leaves."""

    def __init__(self, n: int, height: int, nodes: np.ndarray):
        self.n, self.height, self.nodes = n, height, nodes

    @classmethod
    def build(cls, leaves: np.ndarray, height: int) -> Block:
        """From digests, a row of 32 bytes each."""
        n, count, below = len(leaves), len(leaves), leaves
        places, digests = [], []
        for depth in range(height, -1, -1):
            places.append(address(height + 1, depth, np.arange(count)))
            digests.append(below)
            if depth:
                text = below.tobytes().hex().encode()
                count = -(-count // FAN)
                runs = [sha256(text[i * 64 * FAN : (i + 1) * 64 * FAN]).digest() for i in range(count)]
                below = np.frombuffer(b"".join(runs), np.uint8).reshape(-1, 32)
        nodes = np.zeros((max(int(p.max()) for p in places) + 1, 32), np.uint8)
        for p, d in zip(places, digests):
            nodes[p] = d
        return cls(n, height, nodes)

    def count(self, depth: int) -> int:
        return -(-self.n // FAN ** (self.height - depth))

    def run(self, depth: int, number: int) -> bytes:
        """Hex digests of the run at ``depth`` that the node with ``number`` lies in."""
        low = number - number % FAN
        return self.nodes[address(self.height + 1, depth, np.arange(low, min(low + FAN, self.count(depth))))].tobytes().hex().encode()

    @property
    def root(self) -> bytes:
        return self.nodes[int(address(self.height + 1, 0, np.zeros(1, np.int64))[0])].tobytes()

    def paths(self, above: list[dict]) -> list[list[dict]]:
        """Each leaf's path to the root, and from there ``above``: at each level its place in its run and the siblings there."""
        upper = [above]
        for depth in range(1, self.height + 1):
            lower = []
            for low in range(0, self.count(depth), FAN):
                run = self.run(depth, low)
                lower += [[{"at": at, "others": run[: 64 * at] + run[64 * at + 64 :]}, *upper[low // FAN]] for at in range(len(run) // 64)]
            upper = lower
        return upper


def folded(leaf: bytes, path: list[dict]) -> bytes:
    """The root, in hex, that ``leaf``, in hex, and the siblings of ``path`` give."""
    for step in path:
        at = 64 * step["at"]
        leaf = sha256(step["others"][:at] + leaf + step["others"][at:]).hexdigest().encode()
    return leaf


def numbered(df: DataFrame, tree: str, *order: str | Column) -> DataFrame:
    """``df``, stored, with ``rank``, the number from 0 of each row in its ``tree`` by ``order``, and ``size``, the tree's rows.

    Rows are dealt by ranges and sorted; a task knows the ranks in its range, and those before are added up from a row for each range and tree.
    """
    keys = [F.col(tree), *(F.col(o) if isinstance(o, str) else o for o in order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = stored(laid.withColumn("at", F.monotonically_increasing_id()))  # the range in the high bits, the row in the low 33
    part = F.shiftright("at", 33).alias("part")
    ranges = laid.groupBy(tree, part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy(tree).orderBy("part")
    ranges = ranges.select(
        F.col(tree).alias("_tree"), F.col("part").alias("_part"), F.sum("rows").over(before).alias("upto"), "rows", "first",
        F.sum("rows").over(Window.partitionBy(tree)).alias("size"),
    ).select("_tree", "_part", (F.col("upto") - F.col("rows") - F.col("first")).alias("shift"), "size")
    joined = laid.join(broadcast_up_to(stored(ranges)), (F.col(tree) == F.col("_tree")) & (F.shiftright("at", 33) == F.col("_part")))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift", "_tree", "_part")


_BLOCKS = "tree string, size long, block long, n int, height int, root binary, nodes binary"
_BLOCKS_ARROW = pa.schema([
    ("tree", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary()),
])


def _sorted_leaves(table: pa.Table, column: str) -> np.ndarray:
    order = np.argsort(table["rank"].to_numpy())
    return np.frombuffer(b"".join(table[column].to_pylist()), np.uint8).reshape(-1, 32)[order]


def _builder(height: int):
    def build(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        own, reach = 0, 1
        while reach < size and own < height:  # the only block of a tree ends where one node is left
            own, reach = own + 1, reach * FAN
        block = Block.build(_sorted_leaves(table, "digest"), own)
        row = {
            "tree": table["tree"][0].as_py(), "size": size, "block": table["block"][0].as_py(), "n": block.n, "height": own, "root": block.root,
            "nodes": block.nodes.tobytes(),
        }
        return pa.Table.from_pylist([row], _BLOCKS_ARROW)

    return build


def forest(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Blocks of each round over ``leaves`` (tree, size, rank, digest), stored; the last round's have the trees' roots.

    A round takes the roots of the trees that the one before left with several blocks; there are log(size) / (height log 16) of them.
    """
    reach = FAN**height
    rounds = []
    while True:
        parts = leaves.select("tree", "size", "rank", "digest", F.expr(f"rank div {reach}").alias("block"))
        rounds.append(stored(parts.groupBy("tree", "block").applyInArrow(_builder(height), _BLOCKS)))
        above = rounds[-1].where(F.col("size") > reach)
        if above.isEmpty():
            return rounds
        leaves = above.select("tree", F.expr(f"(size + {reach - 1}) div {reach}").alias("size"), F.col("block").alias("rank"), F.col("root").alias("digest"))


def roots(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """Each tree's root: ``tree, digest``."""
    parts = [r.where(F.col("size") <= FAN**height).select("tree", F.col("root").alias("digest")) for r in rounds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PATH = "array<struct<at: int, others: binary>>"
_PATH_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))
_PATHS = f"tree string, rank long, path {_PATH}"
_PATHS_ARROW = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("path", _PATH_ARROW)])


def _block(row: dict) -> Block:
    return Block(row["n"], row["height"], np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32))


def _emit_paths(reach: int):
    def emit(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                paths = _block(row).paths(row["path"] or [])
                n = len(paths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n, pa.string()), pa.array(np.arange(n) + row["block"] * reach, pa.int64()),
                        pa.array(paths, _PATH_ARROW),
                    ], schema=_PATHS_ARROW,
                )

    return emit


def block_paths(rounds: list[DataFrame], tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The first round's blocks with the path from each block's root to the top, and their tree's ``subroot``; ``tops`` (tree, path, subroot) has
    the path from the trees' roots."""
    tops = broadcast_up_to(tops)
    upper = None
    for i in range(len(rounds) - 1, -1, -1):
        last = F.col("size") <= FAN**height
        blocks = rounds[i].where(last).join(tops, "tree")
        if upper is not None:
            below = rounds[i].where(~last).join(broadcast_up_to(upper), ["tree", "block"])
            blocks = blocks.unionByName(below.join(tops.drop("path"), "tree"))
        if i:
            upper = stored(blocks.mapInArrow(_emit_paths(FAN**height), _PATHS)).withColumnRenamed("rank", "block")
    return blocks


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, ``:`` and its value."""
    each = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in each]), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """``text``, with A-Z lower-cased where 5 divides the CRC-32 of the decimal ``doc_id``."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


_FOLDED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
_FOLDED_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])


def _folder(reach: int):
    def fold(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        row = {c: blocks[c][0].as_py() for c in blocks.schema.names}
        paths = _block(row).paths(row["path"] or [])
        proofs, ends = [], []
        for place, claimed in zip((leaves["rank"].to_numpy() % reach).tolist(), leaves["claimed"].to_pylist()):
            proofs.append(sha256(b"".join(step["others"] for step in paths[place])).hexdigest())
            ends.append(folded(claimed.hex().encode(), paths[place]).decode())
        digests, subroot = [d.hex() for d in leaves["digest"].to_pylist()], row["subroot"].hex()
        return pa.Table.from_arrays(
            [leaves["doc_id"], *(pa.array(c, pa.string()) for c in (digests, [subroot] * len(proofs), proofs, ends))], schema=_FOLDED_ARROW
        )

    return fold


def verify(leaves: DataFrame, blocks: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Folds each claimed leaf with its original siblings. ``leaves`` (doc_id, tree, rank, digest, claimed), ``blocks`` with ``path`` and ``subroot``."""
    blocks = blocks.select(F.col("tree").alias("of"), F.col("block").alias("nth"), "n", "height", "nodes", "path", "subroot")
    parts = leaves.select("doc_id", "tree", "rank", "digest", "claimed", F.expr(f"rank div {FAN**height}").alias("block"))
    return parts.groupBy("tree", "block").cogroup(blocks.groupBy("of", "nth")).applyInArrow(_folder(FAN**height), _FOLDED)


def manifest(docs: DataFrame, claimed_text: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """The Merkle tree of ``docs`` (doc_id, source, lang, n_chars, text), and what each row's leaf proves if its text were ``claimed_text``.

    ``doc_id, leaf, subroot, root, proof_sha256``: the leaf, its source's root, the root of all, and the hash of the siblings on the way;
    ``folded_root`` from the claimed leaf and the original siblings, ``verified`` where that is the root. Leaves of a source ascend by doc_id,
    those without one first, equal ones by leaf; a null source is a source of its own, before all others. Every row has a leaf. No rows give none.
    Other columns are ignored. The root comes to the driver, and nothing else.
    """
    text = F.col("text")
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), fields[0].alias("doc_id"),
        F.unhex(leaf_digest(*fields, text)).alias("digest"), F.unhex(leaf_digest(*fields, text if claimed_text is None else claimed_text)).alias("claimed"),
    )
    leaves = stored(numbered(rows, "tree", F.asc_nulls_first("doc_id"), "digest"))
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], result)
    rounds = forest(leaves, height)
    subroots = stored(roots(rounds, height).withColumnRenamed("tree", "source"))
    named = stored(numbered(subroots.select(F.lit("").alias("tree"), "source", "digest"), "tree", "source"))
    upper = forest(named, height)
    root = roots(upper, height).first()["digest"].hex()
    whole = stored(docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"), F.unhex(F.lit(root)).alias("subroot")))
    over = stored(block_paths(upper, whole, height).mapInArrow(_emit_paths(FAN**height), _PATHS)).drop("tree")
    tops = stored(named.join(over, "rank").select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot")))
    checked = verify(leaves, block_paths(rounds, tops, height), height)
    return checked.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))

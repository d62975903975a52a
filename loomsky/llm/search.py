"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

The index has a row for each term of each shard: its postings in blocks of ``BLOCK``, ascending by document, with the most occurrences
and the fewest terms of a document in each block, from which follows what a block's documents can score at most. A shard is a run of the
rows that one task read, so that texts aren't shuffled; its documents are numbered by ascending doc_id.

A search walks the documents of a shard in windows. A list's global bound is the largest of its blocks. The lists of least bounds that
together can't pass the threshold, the score of the last of the best so far, aren't essential: what is in none but them can't be
among the best. The essential lists' postings are added up; then the bounds of the blocks that a document would lie in on the other lists
reject it, or let those lists be looked up from the one of the largest bound on, each time with what is left of the bounds. Only blocks that
a document still in question may be in are decompressed. The best of each shard are merged at the end.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_up_to, stored

#: postings of a block, text of a shard, items that are searched for together, first and largest window of documents
BLOCK, SHARD_BYTES, ITEMS, WINDOWS = 128, 32 << 20, 256, (1024, 8192)
#: terms: runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: of a block: first and last document, most occurrences, fewest terms of a document, place in the body, bytes of a gap and of a count
HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("tf", "<u4"), ("n", "<u4"), ("at", "<u4"), ("gap", "u1"), ("count", "u1")])

_INDEX = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("heads", pa.binary()), ("body", pa.binary()),
])
INDEX_SCHEMA = "shard long, term string, n_docs long, n_terms long, heads binary, body binary"


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4)).astype(np.int64)


def _put(body: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """``values`` in ``width`` bytes each, least first, from ``at``."""
    for k in range(4):
        if k:
            some = width > k
            at, values, width = at[some], values[some], width[some]
        body[at + k] = (values >> (8 * k)) & 255


def _binary(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``data`` cut into values of ``sizes`` bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def postings(shard: int, terms: list[bytes], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Index rows of a shard's postings, which come ascending by document: ``term`` counts in ``terms``."""
    order = np.argsort(term, kind="stable")
    doc, tf = doc[order].astype(np.int64), tf[order].astype(np.int64)
    count = np.bincount(term, minlength=len(terms))
    start = np.cumsum(count) - count
    blocks = -(-count // BLOCK)
    owner = np.repeat(np.arange(len(terms)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = start[owner] + BLOCK * nth
    size = np.minimum(BLOCK, count[owner] - BLOCK * nth)
    gap = np.diff(doc, prepend=0)
    gap[at] = 0
    head = np.zeros(len(at), HEAD)
    head["first"], head["last"] = doc[at], doc[at + size - 1]
    head["tf"], head["n"] = np.maximum.reduceat(tf, at), np.minimum.reduceat(lengths[doc], at)
    gap_width, tf_width = _widths(np.maximum.reduceat(gap, at)), _widths(head["tf"])
    head["gap"], head["count"] = gap_width, tf_width
    nbytes = size * (gap_width + tf_width)
    place = np.cumsum(nbytes) - nbytes
    first_block = np.cumsum(blocks) - blocks
    head["at"] = place - place[first_block][owner]
    body = np.zeros(int(nbytes.sum()), np.uint8)
    inside = np.arange(len(doc)) - np.repeat(at, size)
    _put(body, np.repeat(place, size) + inside * np.repeat(gap_width, size), gap, np.repeat(gap_width, size))
    _put(body, np.repeat(place + size * gap_width, size) + inside * np.repeat(tf_width, size), tf, np.repeat(tf_width, size))
    names = np.frombuffer(b"".join(terms), np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(terms), shard)), _binary(names, np.fromiter(map(len, terms), np.int64, len(terms)), pa.string()),
            pa.array(count), pa.array(np.zeros(len(terms), np.int64)), _binary(head.view(np.uint8), blocks * HEAD.itemsize, pa.binary()),
            _binary(body, np.add.reduceat(nbytes, first_block), pa.binary()),
        ],
        schema=_INDEX,
    )


def _indexer(shard_bytes: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        docs: list[tuple[bool, int, int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            docs.sort(key=lambda d: d[:2])
            lengths = np.array([d[2] for d in docs], np.int64)
            ids, known = np.array([d[1] for d in docs], "<i8"), np.array([not d[0] for d in docs], np.uint8)
            yield pa.RecordBatch.from_pylist(
                [{
                    "shard": shard, "term": None, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
                    "heads": ids.tobytes() + known.tobytes(), "body": lengths.astype("<i8").tobytes(),
                }], _INDEX,
            )
            if numbers:
                each = [len(d[3]) for d in docs]
                batch = postings(
                    shard, list(numbers), np.concatenate([d[3] for d in docs]), np.repeat(np.arange(len(docs), dtype=np.int32), each),
                    np.concatenate([d[4] for d in docs]), lengths,
                )
                for low in range(0, len(batch), 20_000):
                    yield batch.slice(low, 20_000)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.translate(_APART).split()
                found = Counter(words)
                docs.append((
                    doc is None, doc or 0, len(words), np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)),
                    np.fromiter(found.values(), np.int32, len(found)),
                ))
                size += len(raw)
                if size >= shard_bytes:
                    yield from flush()
                    shard, size = shard + 1, 0
                    docs.clear()
                    numbers.clear()
        if docs:
            yield from flush()

    return index


def write_index(docs: DataFrame, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all of ``docs`` (doc_id, text), written to the shared folder: a row for each shard and term, and one without a
    term for each shard, with its documents' ids and lengths.

    A null or empty text has no terms; a row without a doc_id is a document as others, and so is each of rows that share one. No rows give
    an empty index. Other columns are ignored. ``shard_bytes`` bounds a shard, but for its last document, and so a task's memory.
    """
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_indexer(shard_bytes), INDEX_SCHEMA))


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of ``n`` terms that has it ``tf`` times."""
    m = 75 + 25 * n * docs // terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Postings:
    """A term's postings in a shard; blocks are decompressed when first asked for."""

    def __init__(self, n: int, heads: bytes, body: bytes, lengths: np.ndarray, docs: int, terms: int):
        self.heads, self.body, self.lengths, self.of = np.frombuffer(heads, HEAD), body, lengths, (docs, terms)
        self.first, self.last = self.heads["first"].astype(np.int64), self.heads["last"].astype(np.int64)
        self.n, self.done = n, np.zeros(len(self.heads), bool)
        self.bounds = impact(self.heads["tf"].astype(np.int64), self.heads["n"].astype(np.int64), docs, terms)
        self.docs = np.repeat(self.last, BLOCK)[:n]  # in order even where a block isn't decompressed yet
        self.impacts = np.zeros(n, np.int64)

    def decompress(self, blocks: np.ndarray) -> None:
        for i in blocks[~self.done[blocks]].tolist():
            h, low = self.heads[i], i * BLOCK
            high = min(low + BLOCK, self.n)
            at, gap, count = int(h["at"]), int(h["gap"]), int(h["count"])
            gaps = np.frombuffer(self.body, f"<u{gap}", high - low, at)
            tf = np.frombuffer(self.body, f"<u{count}", high - low, at + (high - low) * gap).astype(np.int64)
            self.docs[low:high] = np.cumsum(gaps, dtype=np.int64) + self.first[i]
            self.impacts[low:high] = impact(tf, self.lengths[self.docs[low:high]], *self.of)
            self.done[i] = True

    def span(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to before ``high`` and their impacts."""
        a, b = np.searchsorted(self.last, low), np.searchsorted(self.first, high)
        if a >= b:
            return self.docs[:0], self.impacts[:0]
        self.decompress(np.arange(a, b))
        docs, impacts = self.docs[a * BLOCK : b * BLOCK], self.impacts[a * BLOCK : b * BLOCK]
        a, b = np.searchsorted(docs, (low, high))
        return docs[a:b], impacts[a:b]

    def bound(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each of ``docs`` would lie in, and that block's bound; 0 where it lies in none."""
        block = np.searchsorted(self.last, docs)
        inside = block < len(self.last)
        block[~inside] = 0
        inside &= self.first[block] <= docs
        return block, np.where(inside, self.bounds[block], 0)

    def look_up(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of ``docs``, 0 of those that aren't in the list."""
        self.decompress(np.unique(blocks))
        at = np.minimum(np.searchsorted(self.docs, docs), self.n - 1)
        return np.where(self.docs[at] == docs, self.impacts[at], 0)


def best(lists: list[tuple[Postings, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of a shard with the highest scores above 0 and these scores, highest first, equal ones by number. ``lists`` are
    postings with their weights."""
    lists = sorted(lists, key=lambda x: int(x[0].bounds.max()) * x[1])
    within = np.cumsum([int(p.bounds.max()) * w for p, w in lists])
    top, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    low, window = 0, WINDOWS[0]
    while low < n_docs:
        idle = int(np.searchsorted(within, least, side="right"))  # lists that aren't essential
        if idle == len(lists):
            break
        high = min(low + window, n_docs)
        total = np.zeros(high - low, np.int64)
        for p, w in lists[idle:]:
            docs, impacts = p.span(low, high)
            total[docs - low] += impacts * w
        docs = np.flatnonzero(total)
        score, docs = total[docs], docs + low
        if idle:
            some = score + within[idle - 1] > least
            docs, score = docs[some], score[some]
            places, bounds = zip(*[p.bound(docs) for p, _ in lists[:idle]])
            places, bounds = np.array(places), np.array(bounds) * np.array([w for _, w in lists[:idle]])[:, None]
            rest = bounds.sum(axis=0)
            for i in range(idle - 1, -1, -1):
                some = score + rest > least
                docs, score, rest, places, bounds = docs[some], score[some], rest[some], places[:, some], bounds[:, some]
                ask = np.flatnonzero(bounds[i])
                if len(ask):
                    score[ask] += lists[i][0].look_up(docs[ask], places[i, ask]) * lists[i][1]
                    rest -= bounds[i]
        some = score > least
        top, scores = np.concatenate([top, docs[some]]), np.concatenate([scores, score[some]])
        order = np.lexsort((top, -scores))[:k]
        top, scores = top[order], scores[order]
        least = int(scores[-1]) if len(top) == k else 0
        low, window = high, min(2 * window, WINDOWS[1])
    return top, scores


_FOUND = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searcher(docs: int, terms: int, k: int):
    def search(shard: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(shard) or not len(hits):
            return _FOUND.empty_table()
        lengths = np.frombuffer(shard["lengths"][0].as_py(), "<i8")
        raw = shard["ids"][0].as_py()
        ids, known = np.frombuffer(raw, "<i8", len(lengths)), np.frombuffer(raw, np.uint8, len(lengths), 8 * len(lengths)).astype(bool)
        items: dict[tuple[int, int | None], list[tuple[Postings, int]]] = {}
        for i in range(len(hits)):
            p = Postings(hits["n_docs"][i].as_py(), hits["heads"][i].as_py(), hits["body"][i].as_py(), lengths, docs, terms)
            weight = math.floor(1000 * math.log((2 * docs + 2) / (2 * hits["df"][i].as_py() + 1)))
            for x in hits["items"][i].as_py():
                items.setdefault((x["item"], x["item_id"]), []).append((p, weight * x["times"]))
        out = []
        for (item, item_id), lists in items.items():
            top, scores = best(lists, len(lengths), k)
            out.append(pa.Table.from_arrays(
                [
                    pa.array([item] * len(top), pa.int64()), pa.array([item_id] * len(top), pa.int64()),
                    pa.array(ids[top], pa.int64(), mask=~known[top]), pa.array(scores, pa.int64()),
                ], schema=_FOUND,
            ))
        return pa.concat_tables(out)

    return search


def search(index: DataFrame, items: DataFrame, *, k: int = 20) -> DataFrame:
    """The ``k`` documents of ``index`` with the highest scores above 0 for each of ``items`` (item_id, text): ``item_id, rank, doc_id, score``.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), N documents having terms and df of them this one; it adds its weight times
    ``impact`` each time that the item has it. Equal scores go by ascending doc_id, those without one last.
    Items without terms, or of terms that no document has, give no rows. Rows that share an item_id are searched for, and ranked, each by itself.
    Items are dealt to groups of about ``ITEMS``, and a group of a shard takes one call: nothing grows with the number of items but their work.
    """
    spark = index.sparkSession
    shards = index.where("term is null")
    docs, terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text"))
    groups = max(1, -(-asked.count() // ITEMS))
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    words = asked.select("item", "item_id", F.explode(words).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))
    group = F.pmod(F.xxhash64("item"), F.lit(groups)).alias("items_group")
    words = stored(words.groupBy("term", group).agg(F.collect_list(F.struct("item", "item_id", "times")).alias("items")))  # ITEMS or so in each
    known = index.where("term is not null")
    df = known.select("term", "n_docs").join(broadcast_up_to(stored(words.select("term").distinct())), "term")
    df = stored(df.groupBy("term").agg(F.sum("n_docs").alias("df")))
    words = stored(words.join(df, "term"))
    hits = known.select("shard", "term", "n_docs", "heads", "body").join(broadcast_up_to(words), "term").drop("term")
    each = F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("for_group")
    shards = shards.select(F.col("shard").alias("of"), each, F.col("heads").alias("ids"), F.col("body").alias("lengths"))
    found = shards.groupBy("of", "for_group").cogroup(hits.groupBy("shard", "items_group")).applyInArrow(_searcher(docs, terms, k), "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # k rows of a shard, cut to k before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

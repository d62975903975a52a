"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are taken in blocks of bounded size, each held whole by every task; documents are read as they lie, once a block, and
no text is shuffled. Every n-gram of an item is a seed, frequent or rare. Seeds of one item on near diagonals mark a passage, and the
passage and the item are aligned word by word: changed, dropped and added words lower the score and don't end the match. What frequent
n-grams mark in vain is told before it is aligned by a bound that no alignment exceeds: the item's words that occur there at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hash_words, in_chunks, shingles

MATCH, MISS, GAP = 2, -1, -1
#: bytes of test items that a task holds at a time
BLOCK_BYTES = 4 << 20
#: seeds, or words of items, that are looked at together
AT_ONCE = 1 << 20
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long"
_MARKS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def plain(text: str | None) -> str:
    """Lower-cased, with ASCII punctuation as white space."""
    return (text or "").lower().translate(_MARKS)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences with linear gaps, and the place in ``words`` where it ends."""
    slope = -GAP * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        up = row + GAP
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(words == w, MATCH, MISS))
        row = np.maximum(up, 0)
        row = np.maximum.accumulate(row + slope) - slope  # gaps along the row
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def span(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Score as a part of that of the whole item, first and last place in ``words``."""
    best, end = align(item, words)
    _, back = align(item[::-1], words[:end][::-1])
    return best / (MATCH * len(item)), end - back, end - 1


def passages(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Where seeds place an item of ``length`` words: (least, greatest) start of each run of near starts."""
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > max(1, length // 2)) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(starts, cut)]


class Items:
    """The n-grams of a block of test items; items with fewer than ``n`` words have none."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n, self.ids = n, [r[0] for r in rows]
        words, bounds = hash_words([plain(r[1]).encode("utf-8", "surrogatepass") for r in rows])
        self.words = [words[a:b] for a, b in zip(bounds, bounds[1:])]
        grams = [shingles(w, n) if len(w) >= n else w[:0] for w in self.words]
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.vocabulary, self.code = np.unique(flat, return_inverse=True)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.gram & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and bounds of ``texts``; places of n-grams of the items in the words, and the n-grams."""
        words, bounds = hash_words(texts)
        none = np.zeros(0, np.int64)
        if len(words) < self.n or not len(self.gram):
            return words, bounds, none, none.view(np.uint64)
        grams = shingles(words, self.n)
        at = np.flatnonzero(self.maybe[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        at = at[self.gram[near] == grams[at]]
        text = np.searchsorted(bounds, at, side="right") - 1
        at = at[at + self.n <= bounds[text + 1]]
        return words, bounds, at, grams[at]


    def likely(self, words: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, min_score: float) -> np.ndarray:
        """Which pairs of a text and an item have so many of the item's words in the text that ``min_score`` can be reached."""
        apart = np.uint64(len(self.vocabulary))
        of = np.unique(text)
        at = np.repeat(bounds[of] - np.cumsum(np.diff(bounds)[of]) + np.diff(bounds)[of], np.diff(bounds)[of]) + np.arange(np.diff(bounds)[of].sum())
        code = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == words[at]
        held = np.unique(np.repeat(of, np.diff(bounds)[of])[known].astype(np.uint64) * apart + code[known].astype(np.uint64))
        size = self.size[item]
        out = np.zeros(len(text), bool)
        for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1):
            n = size[part]
            heads = np.cumsum(n) - n
            own = self.code[np.repeat(self.start[item[part]] - heads, n) + np.arange(n.sum())].astype(np.uint64)
            key = np.repeat(text[part].astype(np.uint64) * apart, n) + own
            near = np.minimum(np.searchsorted(held, key), len(held) - 1)
            out[part] = np.add.reduceat((held[near] == key).astype(np.int64), heads) >= min_score * n - 1e-9
        return out


def bound(item: np.ndarray, words: np.ndarray) -> float:
    """A score that no alignment of ``item`` with ``words`` exceeds: a word of the item that ``words`` lack is a miss or a gap."""
    total = np.concatenate([[0], np.cumsum(np.where(np.isin(item, words), MATCH, max(MISS, GAP)))])
    return int((total - np.minimum.accumulate(total)).max()) / (MATCH * len(item))


def _matcher(items, min_score: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for start, texts in in_chunks([plain(t) for t in batch.column("text").to_pylist()]):
                words, bounds, at, gram = block.found(texts)
                if not len(at):
                    continue
                first = np.searchsorted(block.gram, gram)
                copies = np.searchsorted(block.gram, gram, side="right") - first
                text_at = np.searchsorted(bounds, at, side="right") - 1
                upto = np.cumsum(np.bincount(text_at, copies, len(texts)).astype(np.int64)) // AT_ONCE
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(upto[text_at])) + 1):
                    rows += aligned(block, words, bounds, at[part], first[part], copies[part], min_score, ids[start:])
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "item_id", "score", "first_word", "last_word"), r)) for r in rows],
                pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]),
            )

    return match


def aligned(block: Items, words: np.ndarray, bounds: np.ndarray, at: np.ndarray, first: np.ndarray, copies: np.ndarray, min_score: float, ids: list) -> list[tuple]:
    """Rows of the result, for seeds at ``at`` in ``words`` that are the block's n-grams from ``first`` on, ``copies`` of them."""
    rows = []
    place = np.repeat(at, copies)
    entry = np.repeat(first - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
    item, begin = block.item[entry], place - block.at[entry]
    text = np.searchsorted(bounds, place, side="right") - 1
    order = np.lexsort([item, text])
    item, begin, text = item[order], begin[order], text[order]
    cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
    heads, ends = np.append(0, cut), np.append(cut, len(text))
    for k in np.flatnonzero(block.likely(words, bounds, text[heads], item[heads], min_score)):
        t, i = text[heads[k]], item[heads[k]]
        lo, hi, own = bounds[t], bounds[t + 1], block.words[i]
        slack = int(MATCH * len(own) * (1 - min_score)) // -GAP + 1  # an alignment of min_score has no more words between its own
        best = (0.0, 0, 0)
        for a, b in passages(begin[heads[k] : ends[k]], len(own)):
            left = max(lo, a - slack)
            near = words[left : min(hi, b + len(own) + slack)]
            if bound(own, near) < max(min_score, best[0]):
                continue
            score, x, y = span(own, near)
            best = max(best, (score, -int(left + x - lo), int(left + y - lo)))
        if best[0] >= min_score:
            rows.append((ids[t], block.ids[i], best[0], -best[1], best[2]))
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, min_score: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Passages of ``docs`` that align with items of ``benchmark``: ``doc_id, item_id, score, first_word, last_word``.

    ``score`` is the best local alignment's part of the score of the whole item: 1 for an exact copy, 0.5 for one with a
    third of its words changed or half of it left out. One row for each document and item that reach ``min_score`` and share a run of ``n`` words
    there; places count the document's words from 0.

    Words are runs between white space and ASCII punctuation, lower-cased. Items with fewer than ``n`` words are too short to be
    told from chance and match nothing; so do null and empty texts. Rows without a doc_id or item_id can't be named in a result and
    are left out. Rows that share a doc_id give their best match. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    tests = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = spark.createDataFrame([], RESULT)
    for b in range(blocks):
        rows = tests.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).orderBy("item_id", "text").collect()  # about block_bytes
        items = Items([tuple(r) for r in rows], n)
        sent = spark.sparkContext.broadcast(items)
        found = found.union(docs.mapInArrow(_matcher(sent, min_score), RESULT))
    best = F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.col2")).alias("first_word"), "best.last_word"
    )

"""Token counts by byte-pair merging, without token ids.

A word's symbols, bytes at first, are a linked list. A heap holds every adjacent pair that the vocabulary merges, by rank and then by place;
the least is popped, its pair becomes one symbol, and the pairs with its two neighbours are pushed. An entry whose symbols have
changed since is passed over. A word of n bytes takes O(n log n) steps, however long it is. Its tokens are its first symbols less the merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pieces that a worker remembers, and the longest of them
REMEMBERED, LONGEST = 500_000, 200
#: White space as the pre-tokenizer has it (the property White_Space): fixed values
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: no word of the pre-tokenizer spans a place before white space that follows anything else
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


class Merges:
    """The merges of a byte-level BPE tokenizer file: ranks of pairs of symbols, and what a pair becomes."""

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        self.symbols = vocabulary
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocabulary[a] << 32 | vocabulary[b], rank)
            self.merged.append(vocabulary[a + b])

    def count(self, word: str) -> int:
        """Tokens of ``word``, one of the pre-tokenizer's, each of whose characters stands for a byte."""
        symbols = list(map(self.symbols.__getitem__, word))
        rank_of, n = self.ranks.get, len(symbols)
        bits = n.bit_length()  # an entry of the heap is a rank and, in the low bits, a place
        found = [rank_of(a << 32 | b) for a, b in zip(symbols, symbols[1:])]
        found.append(None)
        heap = [r << bits | i for i, r in enumerate(found) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        merges, low = 0, (1 << bits) - 1
        while heap:
            entry = heappop(heap)
            rank, i = entry >> bits, entry & low
            # found: the rank of each symbol's pair with the one after it now; None of the last, and of one that is merged
            if found[i] != rank:
                continue
            merges += 1
            symbol = symbols[i] = self.merged[rank]
            j = after[i]
            k = after[i] = after[j]
            found[j] = None
            if k < n:
                before[k] = i
                r = found[i] = rank_of(symbol << 32 | symbols[k])
                if r is not None:
                    heappush(heap, r << bits | i)
            else:
                found[i] = None
            h = before[i]
            if h >= 0:
                r = found[h] = rank_of(symbols[h] << 32 | symbol)
                if r is not None:
                    heappush(heap, r << bits | h)
        return n - merges


class Counter:
    """Counts tokens of texts as the library does, by a byte-level BPE file of the tokenizers library.

    The file's own pre-tokenizer cuts words. Texts are first cut where none of its words can span, and these pieces' counts are remembered
    within bounds. Special tokens that stand in a text count one each, as is the library's default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        model, added = spec["model"], spec["added_tokens"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        plain = isinstance(self.pre, ByteLevel) and not self.pre.add_prefix_space and self.pre.use_regex
        if model["type"] != "BPE" or not plain or spec.get("normalizer") or odd:
            raise ValueError(f"{path} is no plain byte-level BPE file: {odd}")
        self.merges = Merges(model)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each of ``pieces``, which follow each other in a text, others between them left out: so they are cut into words together."""
        counts = dict.fromkeys(pieces, 0)
        ends, at = [], 0
        for p in counts:
            at += len(p)
            ends.append(at)
        every, words = iter(zip(counts, ends)), self.words
        piece, end = next(every)
        for word, (_, stop) in self.pre.pre_tokenize_str("".join(counts)):
            n = words.get(word)
            if n is None:
                n = self.merges.count(word)
                if len(word) <= LONGEST:
                    words[word] = n
            while stop > end:
                piece, end = next(every)
            counts[piece] += n
        self.pieces.update({p: n for p, n in counts.items() if len(p) <= LONGEST})
        return counts

    def _plain(self, text: str) -> int:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        pieces = _PIECE.findall(text)
        counts = list(map(self.pieces.get, pieces))
        if None not in counts:
            return sum(counts)
        new = self._learn([p for p, n in zip(pieces, counts) if n is None])
        return sum(new[p] if n is None else n for p, n in zip(pieces, counts))

    def __call__(self, text: str) -> int:
        """Tokens of ``text``."""
        if self.special is None or not (parts := self.special.split(text))[1:]:
            return self._plain(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """The worker's own counter, which the next task finds with its memory."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of each text of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_tokens, over_limit``, the last where there are more than
    ``limit`` tokens.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has. A null text is an empty one, and has no tokens. One row for each row,
    with a doc_id or without; rows that share one count each. Other columns are ignored. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for batch in batches:
            counts = [tokens(t.as_py()) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Token ids in fixed-width bit-packed files.

A shard is one file, little-endian throughout:

======================  =======================================================================
``4s I I I``            magic ``LTK1``, bits per id, ids per block, documents
``Q``                   ids in all
``documents x q``       doc_id
``documents x B``       1 where the document has a doc_id
``(documents + 1) x Q`` first id of each document, and the end
``(blocks + 1) x Q``    offset of each block in the file, and the end
blocks                  64 ids in ``bits`` words of 64 bits; the last group is padded with zeros
======================  =======================================================================

An id at place p of a block begins at bit ``p * bits``, so any run of ids can be had by reading the blocks that hold it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stored

HEAD = struct.Struct("<4sIIIQ")
BLOCK = 1 << 16
#: ids in a shard before the next is begun, and remembered pieces of a worker
SHARD_IDS, REMEMBERED = 1 << 23, 1_000_000
#: text that a writing task takes, about
PART_BYTES = 256 << 20


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """``ids`` in ``bits`` bits each, as 64-bit words."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, at = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(at)
        if at + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - at)
    return out.ravel()


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``words``."""
    rows = words.reshape(-1, bits)
    out = np.empty((len(rows), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, at = divmod(j * bits, 64)
        value = rows[:, word] >> np.uint64(at)
        if at + bits > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - at))
        out[:, j] = value & mask
    return out.ravel()[:n]


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    """A whole shard."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *map(len, ids)]).astype("<u8")
    blocks = [pack(flat[i : i + BLOCK], bits).astype("<u8").tobytes() for i in range(0, len(flat), BLOCK)]
    head = HEAD.pack(b"LTK1", bits, BLOCK, len(doc_ids), len(flat))
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids) + starts.tobytes()
    at = len(head) + len(index) + 8 * (len(blocks) + 1)
    offsets = (np.cumsum([0, *map(len, blocks)]) + at).astype("<u8").tobytes()
    return b"".join([head, index, offsets, *blocks])


class Shard:
    """Random access to the documents of a shard."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        magic, self.bits, self.block, docs, self.n_ids = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != b"LTK1":
            raise ValueError(f"{path} is no token shard")
        blocks = -(-self.n_ids // self.block)
        at = HEAD.size
        raw = self.file.read_at(docs * 17 + 8 + 8 * (blocks + 1), at)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.known = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 17 * docs + 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places ``start`` to ``end`` of the shard; reads only the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block + 1
        raw = self.file.read_at(self.offsets[last] - self.offsets[first], self.offsets[first])
        words = np.frombuffer(raw, "<u8")
        return unpack(words, self.bits, end - first * self.block)[start - first * self.block :]

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document."""
        return self.ids(self.starts[i], self.starts[i + 1])


#: No token of the byte-level pre-tokenizer spans a place before white space that follows anything else, so the pieces
#: between such places are encoded alone. In a plain text, which prints but for its line ends, they lie between single spaces and line ends.
#: In one with a character of _OPEN, of which the two libraries' notions of white space differ, they aren't sought.
_PIECE = re.compile(r"\s*\S+|\s+")
_OPEN = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: ASCII marks but the apostrophe: behind a word of letters, any number of them is one token of the pre-tokenizer
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: words that are encoded together
_TOGETHER = 2000


def plain(text: str) -> bool:
    """Whether all white space of ``text`` is single spaces and line ends between other characters."""
    return (
        text.replace("\n", "").isprintable() and not text[0].isspace() and not text[-1].isspace()
        and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
    )


class Encoder:
    """A tokenizer from a file of the tokenizers library, with a bounded memory of words and pieces it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.added = any(not t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        #: by pieces only where the pre-tokenizer is known to allow it
        self.by_pieces = self.tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and not self.added
        self.pieces: dict[str, bytes] = {}  # a word behind a space is a piece too
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.led = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a space, as byte-level vocabularies write it
        self.led[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _words(self, words: list[str]) -> None:
        """Remember the ids of each of ``words``, of letters alone, behind a space: many are encoded as one text and parted where a space leads."""
        runs = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for run, raw in zip(runs, self._encode([" " + " ".join(r) for r in runs])):
            cut = (4 * np.flatnonzero(self.led[np.frombuffer(raw, "<u4")])).tolist()
            if len(cut) == len(run):
                self.pieces.update(zip(run, [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)])]))
            else:
                self.pieces.update(zip(run, self._encode([" " + w for w in run])))

    def _learn(self, pieces: list[str]) -> None:
        bare, parted, other = [], [], []
        for p in pieces:
            word = p.rstrip(_MARKS)
            marks = p[len(word) :]
            if not word.isalpha() or (len(marks) > 1 and "<" in marks):
                other.append(p)
            elif marks:
                parted.append((p, word, marks))
            else:
                bare.append(p)
        known = self.pieces
        bare += {w for _, w, _ in parted}.difference(known, bare)
        if bare:
            self._words(bare)
        if new := {m for _, _, m in parted}.difference(self.marks):
            self.marks.update(zip(new, self._encode(list(new))))
        marked = self.marks
        known.update([(p, known[w] + marked[m]) for p, w, m in parted])
        if other:
            known.update(zip(other, self._encode([p if p[:1] == "\n" else " " + p for p in other])))

    def __call__(self, text: str) -> np.ndarray:
        """The ids of ``text``, without special tokens."""
        if not text:
            return np.zeros(0, np.uint32)
        if not self.by_pieces:
            return np.frombuffer(self._encode([text])[0], "<u4")
        if len(self.pieces) + len(self.marks) > REMEMBERED:
            self.pieces.clear()
            self.marks.clear()
        if not plain(text):
            if _OPEN.search(text):
                return np.frombuffer(self._encode([text])[0], "<u4")
            pieces = _PIECE.findall(text)
            found: dict[str, bytes] = dict.fromkeys(pieces)
            found.update(zip(found, self._encode(list(found))))
            return np.frombuffer(b"".join(map(found.__getitem__, pieces)), "<u4")
        # A line end is put before the text, and its id taken away again.
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        if new := set(pieces).difference(self.pieces):
            self._learn(list(new))
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), "<u4")[1:]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's own encoder, which the next task finds with its memory."""
    return Encoder(path)


def _writer(folder: str, tokenizer: str, end_id: int | None, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encode = encoder(tokenizer)
        size = max(encode.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        bits = max(1, (size - 1).bit_length())
        end = np.array([] if end_id is None else [end_id], np.uint32)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        piece, held, ids, n = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            # The name has the attempt: what a lost attempt wrote is never named by the list of shards.
            name = f"shard-{task.partitionId():06d}-{piece:04d}-{task.taskAttemptId()}.bin"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(shard_bytes(held, ids, bits))
            return pa.RecordBatch.from_pylist(
                [{"part": task.partitionId(), "piece": piece, "path": f"{folder}/{name}", "n_docs": len(held), "n_ids": n}],
                pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                one = np.concatenate([encode(text or ""), end])
                held.append(doc)
                ids.append(one)
                n += len(one)
                if n >= shard_ids:
                    yield flush()
                    piece, held, ids, n = piece + 1, [], [], 0
        if held:
            yield flush()

    return write


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, *, end_id: int | None = 2, parts: int | None = None, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode every text of ``docs`` and write the ids to shards, in ascending doc_id order.

    ``tokenizer`` is the path of a tokenizers file that every executor has; ``end_id`` is appended to each document;
    ``folder`` is a new folder that all executors share; ``parts`` tasks write, by default one for each ``PART_BYTES`` of text, and
    ``spark.sql.shuffle.partitions`` at least. Runs at once. Returns the list of shards: ``part, piece, path,
    n_docs, n_ids, start``, where ``start`` counts the ids of all shards before.

    A null text is an empty one. Rows that share a doc_id follow each other by text; rows without one come first. No
    rows give no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = stored(ordered.mapInArrow(_writer(folder, tokenizer, end_id, shard_ids), "part int, piece int, path string, n_docs long, n_ids long"))
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(shards: DataFrame) -> DataFrame:
    """What the shards hold, a row for each document: ``doc_id, start, n_tokens, ids_crc32``, the unsigned CRC-32 of its ids
    as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                crc = []
                for low in range(0, len(shard.doc_ids), 256):
                    bounds = shard.starts[low : low + 257]
                    ids = shard.ids(bounds[0], bounds[-1]).astype("<u4")
                    crc += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=~shard.known), pa.array(shard.starts[:-1] + base, pa.int64()),
                        pa.array(np.diff(shard.starts), pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = shards.select("path", "start")
    shards_a_task = 4
    spread = files.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.count() // shards_a_task))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

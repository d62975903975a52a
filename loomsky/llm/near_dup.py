"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is that of its distinct word shingles. Its signature holds ``chunks * width`` MinHash
values of ``bits`` bits. Two signatures that differ in at most ``chunks * (errors + 1) - 1`` places agree, by
the pigeonhole principle, in some chunk but for at most ``errors`` places. So every chunk is entered into the
index once for each way of leaving out ``errors`` places, and all pairs within that distance meet under a
key; at the default 9 x 6 values and one error that is 17 of 54 places. Most pairs that
are farther apart meet too: at Jaccard 0.8 a pair misses all chunks with probability 0.345 ** 9, 7e-5.

What meets is confirmed on the full sets; ``linking`` says how that is done without giving all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, components, stored
from .linking import linked_components
from .words import C1, C2, hash_words, in_chunks, in_slices, mix, shingles

#: documents whose sets a task holds at once
SETS = 1000
SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, signature array<long>"


def _text_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, distinct shingle hashes, sorted)."""
    for start, texts in in_chunks(in_slices(batch.column("text")), 1 << 18):
        words, bounds = hash_words(texts)
        for i in range(len(texts)):
            yield start + i, np.unique(shingles(words[bounds[i] : bounds[i + 1]], n))


def _prints(hashes: np.ndarray) -> tuple[int, int]:
    """Two numbers by which sets are told apart."""
    return int(hashes.sum(dtype=np.uint64).view(np.int64)), int(mix(hashes ^ C1).sum(dtype=np.uint64).view(np.int64))


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64))
    )


def _signer(n: int, chunks: int, width: int, bits: int):
    places = chunks * width
    flips = mix(np.arange(1, places + 1, dtype=np.uint64) * C1)
    scale = mix(np.arange(1, places + 1, dtype=np.uint64) * C2) | np.uint64(1)
    shift = np.uint64(64 - bits)

    def signature(hashes: np.ndarray) -> np.ndarray:
        low = np.full(places, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 4096):
            np.minimum(low, ((hashes[i : i + 4096, None] ^ flips) * scale).min(axis=0), out=low)
        packed = np.zeros(chunks, np.uint64)
        for values in (mix(low) >> shift).reshape(chunks, width).T:
            packed = (packed << np.uint64(bits)) | values
        return packed

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, signatures = [], [], [], []
            for _, hashes in _text_sets(batch, n):
                size.append(len(hashes))
                for column, value in zip((one, two), _prints(hashes)):
                    column.append(value)
                signatures.append(signature(hashes) if len(hashes) else hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()), _list_array(signatures),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "signature"],
            )

    return sign


def _keys(chunks: int, width: int, errors: int, bits: int) -> Column:
    """The index keys of ``signature``: each chunk without each choice of ``errors`` places, and a number for both."""
    found = []
    for chunk in range(chunks):
        for kept in combinations(range(width), width - errors):
            mask = sum(((1 << bits) - 1) << (bits * p) for p in kept)
            number = len(found) << (bits * width)
            found.append(F.get("signature", F.lit(chunk)).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(number)))
    return F.array(*found)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, SETS) for b in batches for low in range(0, len(b), SETS)):
            parts = [hashes for _, hashes in _text_sets(batch, n)]
            prints = [pa.array([p[k] for p in map(_prints, parts)], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *prints, _list_array(parts)], ["node", "fp1", "fp2", "items"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    shingle_words: int = 5,
    percent: int = 80,
    chunks: int = 9,
    width: int = 6,
    errors: int = 1,
    bits: int = 9,
) -> DataFrame:
    """Class of each document: ``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Documents whose sets share at least ``percent`` hundredths of their union are linked; ``component_id`` is
    the smallest doc_id reachable, and ``kept`` marks the rows that carry it. Words are ``[^\\x20\\x09-\\x0D]+`` with
    A-Z lower-cased; a text with fewer words than a shingle is one shingle.

    Null and empty texts have an empty set, linked with nothing. Rows that share a doc_id are one node with several
    texts. Rows without a doc_id can't be named in a result and are left out. Other columns of ``docs`` are ignored.

    Disk: signatures of all documents, the sets of those that met another in a bucket, and, where these are too many for
    their ids to be broadcast, one shuffle of texts.
    """
    if not 0 <= errors < width or bits * width + (chunks * comb(width, errors) - 1).bit_length() > 63:
        raise ValueError("a key doesn't fit in 63 bits")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    signed = stored(docs.mapInArrow(_signer(shingle_words, chunks, width, bits), SIGNATURE).withColumn("node", F.xxhash64("fp1", "fp2", "n_shingles")))
    #: equal sets are one node, for which the document of the smallest doc_id stands
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    nodes = stored(nodes)
    entries = nodes.select(F.explode(_keys(chunks, width, errors, bits)).alias("key"), F.col("node").alias("rep")).repartition("key")
    # The ends are asked for so that both branches deal the same columns, and share one exchange.
    shared = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").drop("low", "high")
    met = stored(entries.join(shared.hint("shuffle_hash"), "key"))
    ids = met.select(F.col("rep").alias("node")).distinct()
    ids = broadcast_up_to(stored(nodes.select("node", F.col("least").alias("doc_id")).join(ids, "node")))
    sets = docs.join(ids, "doc_id").select("doc_id", "node", "text").mapInArrow(_sets(shingle_words), "node long, fp1 long, fp2 long, items array<long>")
    #: a document that has several texts stands for one of their sets at a time
    sets = sets.where(F.col("node") == F.xxhash64("fp1", "fp2", F.size("items").cast("long"))).select(F.col("node").alias("id"), "items")
    found = linked_components(met, stored(sets.dropDuplicates(["id"])), percent)

    # Texts that share a doc_id are one document.
    several = signed.where("n_shingles > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all"))
    several = stored(several.where("a <> b").select("a", F.explode("all").alias("b")).where("a <> b"))
    if not several.isEmpty():
        found = components(found.toDF("a", "b").union(several))
    named = nodes.select("node", "least").join(stored(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")).where("nodes > 1").drop("nodes")
    named = named.join(broadcast_up_to(stored(least)), "component", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"))
        .withColumn("kept", F.expr("doc_id = component_id"))
    )

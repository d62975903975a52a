"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of characters.

The model is trained on trusted text, of any alphabet. Spark counts its n-grams and joins counts, contexts and shorter n-grams, shuffled by
n-gram, so nothing of the model is ever held whole. Documents are scored by joins too: each block of rows names its distinct n-grams, these are joined
with the model order by order, from the shortest, and what they cost goes back to the block. So text isn't shuffled,
and an n-gram is looked up once however often it occurs. A task holds the n-grams of the block that it scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, shared_dir, stored
from .words import C1, in_slices, mix

ORDER = 5
#: rows of a file that form a block, and characters that are looked at together
BLOCK_ROWS, AT_ONCE = 1 << 17, 1 << 20
#: characters that are hashed together, so that they stay in a core's cache, and bits of a number's place in a table
STRIP, SLOTS = 1 << 14, 20
#: one trusted document in so many is kept from training, to set thresholds
FOLDS = 5
BLOCK, SCORE = "_block_of_rows", "_perplexity"


def _chunks(texts: Iterable[str | None], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, text lengths) of runs of texts, each led by ``order - 1`` line ends."""
    start, held, size = 0, [], 0
    lead = "\n" * (order - 1)

    def points() -> np.ndarray:
        return np.frombuffer("".join(held).encode("utf-32-le", "replace"), np.uint32)

    for i, t in enumerate(texts):
        t = lead + (t or "").lower().replace("\0", "�")
        if held and size + len(t) > AT_ONCE:
            yield start, points(), np.array([len(x) for x in held])
            start, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, points(), np.array([len(x) for x in held])


def hashed(windows: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number for each row of ``windows``, the code points at each place."""
    out = np.zeros(len(windows[0]), np.uint64)
    for at in range(0, len(out), STRIP):
        total = out[at : at + STRIP]
        for points in windows:
            total ^= points[at : at + STRIP]
            total *= C1
            total ^= total >> np.uint64(29)
        total[:] = mix(total)
    return out


class Seen:
    """A set of numbers. A table by their last bits tells most that are in it; the others are sorted and looked up."""

    def __init__(self) -> None:
        self.table = ~np.arange(1 << SLOTS, dtype=np.uint64)  # of numbers that have other last bits than those of their place
        self.sorted = np.zeros(0, np.uint64)

    def new(self, number: np.ndarray) -> np.ndarray:
        """Where the numbers that weren't in the set lie in ``number``, a place for each; they are in it from now on."""
        slot = np.uint64((1 << SLOTS) - 1)
        left = np.flatnonzero(self.table[number & slot] != number)
        other, first = np.unique(number[left], return_index=True)
        self.table[other & slot] = other
        if len(self.sorted):
            fresh = self.sorted[np.minimum(np.searchsorted(self.sorted, other), len(self.sorted) - 1)] != other
            other, first = other[fresh], first[fresh]
        if len(other):
            self.sorted = np.sort(np.concatenate([self.sorted, other]), kind="stable")
        return left[first]


class Costs:
    """The bits of numbers, ``known`` ascending. A table by their last bits tells where most are; the others are looked up."""

    def __init__(self, known: np.ndarray, bits: np.ndarray):
        self.known, self.bits = known, bits
        self.slot = np.uint64((1 << (4 * len(known)).bit_length()) - 1)
        self.table = np.zeros(int(self.slot) + 1, np.int32)
        self.table[known & self.slot] = np.arange(len(known), dtype=np.int32)

    def of(self, number: np.ndarray) -> np.ndarray:
        at = self.table[number & self.slot]
        left = np.flatnonzero(self.known[at] != number)
        at[left] = np.searchsorted(self.known, number[left])
        return self.bits[at]


def grams(points: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams that end at each text's own characters begin, and their numbers."""
    ends = np.cumsum(lengths)
    inside = np.ones(max(0, len(points) - order + 1), bool)
    for e in ends[:-1]:
        inside[e - order + 1 : e] = False
    number = hashed([points[k : k + len(inside)] for k in range(order)])
    return np.flatnonzero(inside), number[inside]


def code_points(grams: pa.ChunkedArray, order: int) -> np.ndarray:
    """The code points of n-grams, a row for each, none of which becomes a Python object; zeros behind shorter ones."""
    text = b"".join(pc.binary_join(pa.ListArray.from_arrays([0, len(c)], c), "").cast(pa.binary())[0].as_py() for c in grams.chunks if len(c))
    flat = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    if len(flat) == order * len(grams):
        return flat.reshape(-1, order)
    return np.array(grams.to_pylist(), f"<U{order}").view(np.uint32).reshape(-1, order)


def spelled(points: np.ndarray, at: np.ndarray, order: int) -> pa.Array:
    """The n-grams that begin at ``at``, as strings."""
    flat = np.ascontiguousarray(points[at[:, None] + np.arange(order)])
    return pa.array(flat.view(f"<U{order}").ravel().tolist(), pa.string())


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points, lengths in _chunks(in_slices(batch.column("text")), order):
                at, number = grams(points, lengths, order)
                _, first, n = np.unique(number, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([spelled(points, at[first], order), pa.array(n, pa.int64())], ["gram", "n"])

    return count


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) of a batch."""
    block = batch.column(BLOCK).to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield int(block[a]), batch.slice(a, b - a)


def _lister(order: int):
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, Seen()
        for batch in batches:
            for block, rows in _runs(batch):
                if block != now:
                    now, seen = block, Seen()
                for _, points, lengths in _chunks(in_slices(rows.column("text")), order):
                    at, number = grams(points, lengths, order)
                    first = seen.new(number)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block), pa.int64()), spelled(points, at[first], order)], [BLOCK, "gram"])

    return distinct


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more (Chen and Goodman, 1998)."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n = [max(1, x or 0) for x in row]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _off(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(trusted: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Counts ``gram, n`` of the n-grams of all texts of ``trusted``, for each order from 1: those of the longest are how often it occurs,
    those of a shorter one how many different characters precede it."""
    counts = trusted.where("text is not null").select("text").mapInArrow(_counter(order), "gram string, n long")
    levels = [stored(counts.groupBy("gram").agg(F.sum("n").alias("n")))]
    for _ in range(order - 1):
        levels.append(stored(levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    return levels[::-1]


def probabilities(levels: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """``gram, p`` of each of ``wanted`` (gram), distinct n-grams of the highest order: the probability of its last character after the others."""
    order = len(levels)
    d = _discounts(levels[0])
    n = F.col("n")
    symbols, total, left = levels[0].agg(F.count("*"), F.sum("n"), F.sum(_off(n, d))).first()
    uniform = 1 / (symbols + 1)  # one more for what no trusted text has
    found = wanted.select(F.expr(f"substring(gram, {order})").alias("gram")).distinct()
    found = found.join(levels[0], "gram", "left")
    share = F.coalesce((n - _off(n, d)) / F.lit(total or 1), F.lit(0.0)) + (left / total if total else 1.0) * uniform
    found = stored(found.select("gram", share.alias("p")))
    for m in range(2, order + 1):
        counts = levels[m - 1]
        d = _discounts(counts)
        keyed = counts.withColumn("context", F.expr(f"left(gram, {m - 1})"))
        contexts = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(_off(n, d)).alias("left"))
        these = wanted.select(F.expr(f"substring(gram, {order - m + 1})").alias("gram")).distinct()
        these = these.select("gram", F.expr(f"left(gram, {m - 1})").alias("context"), F.expr("substring(gram, 2)").alias("rest"))
        these = these.join(found.withColumnRenamed("gram", "rest"), "rest").join(contexts, "context", "left").join(counts, "gram", "left")
        own = F.coalesce((n - _off(n, d)) / F.col("total"), F.lit(0.0))
        found = stored(these.select("gram", (own + F.coalesce(F.col("left") / F.col("total"), F.lit(1.0)) * F.col("p")).alias("p")))
    return found


def in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of each row's block: rows that follow each other in a file. What isn't read from files is stored first."""

    def numbered(df: DataFrame) -> DataFrame:
        return df.select("*", F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {BLOCK_ROWS}")).alias(BLOCK))

    try:
        return numbered(docs)
    except AnalysisException:
        return numbered(stored(docs))


@lru_cache(maxsize=1)
def _costs(folder: str, block: int, order: int) -> Costs:
    """The bits of a block's n-grams; the table is kept until the next block."""
    store, root = fs.FileSystem.from_uri(folder)
    table = pq.read_table(f"{root}/block={block}", filesystem=store, columns=["gram", "bits"])
    number = hashed(list(code_points(table["gram"], order).T))
    by = np.argsort(number)
    return Costs(number[by], table["bits"].to_numpy()[by])


def _scorer(folder: str, order: int, kept: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in _runs(batch):
                found: list[float | None] = []
                for _, points, lengths in _chunks(in_slices(rows.column("text")), order):
                    _, number = grams(points, lengths, order)
                    own = lengths - (order - 1)
                    total = np.zeros(1)
                    if len(number):
                        total = np.concatenate([total, np.cumsum(_costs(folder, block, order).of(number), dtype=np.float64)])
                    ends = np.cumsum(own)
                    with np.errstate(over="ignore"):
                        ppl = np.exp2((total[ends] - total[ends - own]) / np.maximum(own, 1))
                    found += [float(p) if n else None for p, n in zip(ppl, own)]
                columns = [rows.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], [*kept, SCORE])

    return score


def scores(docs: DataFrame, levels: list[DataFrame], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of each row of ``docs`` with its perplexity; null for a null or empty text."""
    order = len(levels)
    placed = in_blocks(docs.select(*dict.fromkeys([*kept, "text"])))
    listed = stored(placed.select(BLOCK, "text").mapInArrow(_lister(order), f"{BLOCK} long, gram string"))
    known = probabilities(levels, listed.select("gram").distinct())
    costs = listed.distinct().join(known, "gram").select(F.col(BLOCK).alias("block"), "gram", (-F.log2("p")).cast("float").alias("bits"))
    folder = shared_dir(docs.sparkSession)
    costs.repartition("block").write.partitionBy("block").parquet(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*kept).schema.fields)
    return placed.mapInArrow(_scorer(folder, order, kept), f"{schema}, {SCORE} double")


def judged(docs: DataFrame, labels: DataFrame, kept: list[str], *, quantile: float, slack: float, order: int) -> DataFrame:
    """The columns ``kept``, ``_perplexity`` and ``threshold`` of each row of ``docs``."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = broadcast_up_to(stored(good.withColumn("spared", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)) == 0)))
    taught = good.where("not spared")
    trusted = docs.select("doc_id", "text").join(good if taught.isEmpty() else taught, "doc_id", "left_semi")
    scored = stored(scores(docs, train(trusted, order), kept))
    known = scored.select("doc_id", "lang", SCORE).where(F.col(SCORE).isNotNull()).join(good, "doc_id")
    at = (F.percentile_approx(SCORE, quantile, 10000) * slack).alias("threshold")
    spared = known.where("spared")
    overall = spared.agg(at).first()[0] or known.agg(at).first()[0] or float("inf")
    by_lang = broadcast_up_to(stored(spared.where("lang is not null").groupBy("lang").agg(at)))
    return scored.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall)))


def quality(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.98, slack: float = 1.5, order: int = ORDER) -> DataFrame:
    """Judge each document: ``doc_id, lang, perplexity, threshold, kept``, one row for each row of ``docs``.

    Trusted texts are those of documents that ``labels`` gives quality 1; one in five of the documents is kept from training, unless none were left. A language's
    threshold is ``slack`` times the ``quantile`` of the perplexities of those; a language without any, or a null one, has that of
    all (of all trusted documents, where none was kept from training). A document is kept up to its threshold.

    Null and empty texts have no perplexity and aren't kept. Rows without a doc_id are judged like others. Rows that share a
    doc_id share a label. A null label is none; if there are no trusted texts, nothing is rejected that has text. Other
    columns are ignored.
    """
    found = judged(docs.select("doc_id", "lang", "text"), labels, ["doc_id", "lang"], quantile=quantile, slack=slack, order=order)
    found = found.select(F.col("doc_id").cast("long"), "lang", F.col(SCORE).alias("perplexity"), "threshold")
    return found.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.98, slack: float = 1.5, order: int = ORDER) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    found = judged(docs, labels, docs.columns, quantile=quantile, slack=slack, order=order)
    return found.where(F.col(SCORE) <= F.col("threshold")).select(*docs.columns)

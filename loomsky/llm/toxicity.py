"""Toxicity by a convolutional text classifier in numpy.

A word's vector is made of one row of each of two hashed embedding tables. Filters of several widths slide over the whole text, the
greatest response of each is kept, and a logistic layer makes the score. The first entry of each row begins as a z-score of
the bucket's share of toxic training documents, so that a few dozen toxic examples are enough to start from; training moves all
the rest. Whatever is after that is learned: the gradient of max pooling reaches only the windows that won.

The model is fitted on a bounded sample of labelled documents (``max_train``); every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .decontaminate import plain
from .words import C1, hash_words, in_chunks, mix

BUCKETS, TABLES, DIM = 1 << 18, 2, 4
WIDTHS, FILTERS = (1, 2, 3), 8
PAD = max(WIDTHS) - 1


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, TABLES) bucket numbers of all words, each text followed by ``PAD`` places of the empty bucket; bounds of the texts."""
    words, bounds = hash_words(texts)
    sizes = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(sizes + PAD)])
    out = np.full((starts[-1], TABLES), BUCKETS, np.int32)
    at = np.arange(len(words)) + np.repeat(np.arange(len(texts)) * PAD, sizes)
    out[at, 0] = words & np.uint64(BUCKETS - 1)
    out[at, 1] = mix(words ^ C1) & np.uint64(BUCKETS - 1)
    return out, starts


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embedding = [np.vstack([r.normal(0, 0.05, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32) for _ in range(TABLES)]
        self.filters = [r.normal(0, 0.1, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weights = r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return np.concatenate([e[buckets[:, k]] for k, e in enumerate(self.embedding)], axis=1)

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """What the filters of the k-th width answer at each window of the rows ``x``."""
        w = WIDTHS[k]
        n = len(x) - w + 1
        out = x[:n] @ self.filters[k][0]
        for j in range(1, w):
            out += x[j : n + j] @ self.filters[k][j]
        return out

    def pooled(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each text, at least 0; windows lie in the text and its padding."""
        parts = []
        for k, w in enumerate(WIDTHS):
            r = self.responses(x, k) + self.offsets[k]
            bounds = np.stack([starts[:-1], np.maximum(starts[1:] - PAD, starts[:-1])], axis=1)
            filled = bounds[:, 1] > bounds[:, 0]
            got = np.zeros((len(starts) - 1, FILTERS), np.float32)
            if filled.any():
                edges = bounds[filled].ravel()
                r = np.concatenate([r, np.zeros((max(0, edges[-1] + 1 - len(r)), FILTERS), np.float32)])
                got[filled] = np.maximum.reduceat(r, edges, axis=0)[::2]
            parts.append(np.maximum(got, 0))
        return np.concatenate(parts, axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        buckets, starts = word_buckets(texts)
        z = self.pooled(self.vectors(buckets), starts) @ self.weights + self.bias if len(buckets) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(texts: list[str], toxic: np.ndarray, *, epochs: int = 6, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> Network:
    """A network for ``texts`` and their 0/1 labels."""
    net = Network(seed)
    docs = [word_buckets([plain(t).encode("utf-8", "surrogatepass")])[0] for t in texts]
    y = np.asarray(toxic, np.float64)
    if not len(docs) or not 0 < y.mean() < 1:
        net.weights[:], net.bias = 0, np.float32(4 if len(y) and y.mean() == 1 else -4)
        return net
    share = y.mean()
    for k in range(TABLES):
        hits, bad = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for d, label in zip(docs, y):
            one = np.unique(d[:, k])
            hits[one] += 1
            bad[one] += label
        z = (bad - hits * share) / np.sqrt(hits * share * (1 - share) + 1)
        net.embedding[k][:, 0] = np.clip(z / 4, -1, 3)
        net.embedding[k][-1] = 0
    for k in range(len(WIDTHS)):
        net.filters[k][0, ::DIM, 0] = 1 / TABLES
        net.weights[k * FILTERS] = 1.0
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # both classes count as much
    weight /= weight.mean()
    moments: dict = {}

    def step(name, value, gradient, t, scale=rate):
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        value -= scale * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) + decay * value)

    order, t = np.random.default_rng(seed), 0
    first = [net.pooled(net.vectors(d), np.array([0, len(d)]))[0, ::FILTERS].max() for d in docs]
    net.bias = np.float32(-np.median(first) - 1)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(docs)), max(1, len(docs) // 32)):
            t += 1
            g_filters, g_offsets = [np.zeros_like(f) for f in net.filters], [np.zeros_like(o) for o in net.offsets]
            g_weights, g_bias, moved = np.zeros_like(net.weights), 0.0, []
            for i in batch:
                d = docs[i]
                if len(d) <= PAD:
                    continue
                x = net.vectors(d)
                pooled, where = [], []
                for k in range(len(WIDTHS)):
                    r = net.responses(x, k)[: len(d) - PAD] + net.offsets[k]
                    at = r.argmax(axis=0)
                    where.append(at)
                    pooled.append(np.maximum(r[at, np.arange(FILTERS)], 0))
                h = np.concatenate(pooled)
                p = 1 / (1 + np.exp(-np.clip(float(h @ net.weights + net.bias), -30, 30)))
                g = weight[i] * (p - y[i]) / len(batch)
                g_weights += g * h
                g_bias += g
                for k, w in enumerate(WIDTHS):
                    back = g * net.weights[k * FILTERS : (k + 1) * FILTERS] * (pooled[k] > 0)
                    g_offsets[k] += back
                    for j in range(w):
                        g_filters[k][j] += x[where[k] + j].T * back
                        moved.append((d[where[k] + j], back[:, None] * net.filters[k][j].T))
            for k in range(len(WIDTHS)):
                step(("f", k), net.filters[k], g_filters[k], t)
                step(("o", k), net.offsets[k], g_offsets[k], t)
            step("w", net.weights, g_weights, t)
            net.bias -= np.float32(rate * g_bias)
            for buckets, gradient in moved:
                for k in range(TABLES):
                    np.subtract.at(net.embedding[k], buckets[:, k], (rate * gradient[:, k * DIM : (k + 1) * DIM]).astype(np.float32))
        for k in range(TABLES):
            net.embedding[k][-1] = 0
    z = np.array([float(net.pooled(net.vectors(d), np.array([0, len(d)]))[0] @ net.weights) for d in docs])
    net.bias = np.float32(_best_bias(z, y))
    return net


def _best_bias(z: np.ndarray, y: np.ndarray) -> float:
    """The bias at which score 0.5 lies in the middle of the gap that parts the labels with fewest errors."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (np.sum(1 - y) - np.concatenate([[0], np.cumsum(1 - y)]))
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gap = np.where(errors == errors.min(), np.diff(edges), -1)
    i = int(gap.argmax())
    return -float(edges[i] + edges[i + 1]) / 2


def _scorer(net):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [net.value.scores(texts) for _, texts in in_chunks([plain(t) for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), pa.array(np.concatenate(got) if got else np.zeros(0))],
                ["doc_id", "lang", "score"],
            )

    return score


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the doc_id as text leaves no remainder; null for null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = 4000, seed: int = 0) -> Network:
    """A network from at most ``max_train`` labelled documents that aren't held out, half of them toxic where there are as many,
    drawn by a hash of the doc_id. Documents with contradicting labels count as toxic; null labels are none."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.xxhash64(F.lit(seed), "doc_id")
    chosen = [r for c in (1, 0) for r in known.where(F.col("toxic") == c).orderBy(drawn, "doc_id").limit(max_train // 2).collect()]
    sample = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").toArrow()  # max_train rows
    known_rows = sorted(zip(rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()], rows["toxic"].to_pylist()))
    return fit([text for _, text, _ in known_rows], np.array([label for _, _, label in known_rows]), seed=seed)


def toxicity(docs: DataFrame, labels: DataFrame, *, max_train: int = 4000, seed: int = 0) -> DataFrame:
    """Score each document: ``doc_id, held_out, score, predicted, threshold, flagged``, one row for each row of ``docs``.

    ``score`` is of the text alone. ``predicted`` is 1 from score 0.5 on. ``threshold`` is that score, in hundredths, at which the
    labelled documents of the language that aren't held out are told apart with the best F1; ``flagged`` uses it. A language without toxic
    examples, or a null one, has 0.5.

    Null and empty texts are scored like any without a word. Rows without a doc_id are scored, and not held out. Without labels
    of both kinds all scores are alike. Other columns are ignored.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train=max_train, seed=seed))
    scored = stored(docs.select("doc_id", "lang", "text").mapInArrow(_scorer(net), "doc_id long, lang string, score double"))
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = (
        scored.where("lang is not null").join(known, "doc_id")
        .groupBy("lang", F.floor(F.col("score") * 100).cast("int").alias("step")).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    )  # at most 101 rows for a language
    counts = counts.withColumn("all_bad", F.sum("bad").over(Window.partitionBy("lang"))).where("step > 0")
    reached = counts.withColumn("at", F.explode(F.sequence(F.lit(1), F.least("step", F.lit(99)))))
    reached = reached.groupBy("lang", "at").agg(F.sum("bad").alias("tp"), F.sum("n").alias("out"), F.first("all_bad").alias("bad")).where("tp > 0")
    f1 = 2 * F.col("tp") / (F.col("out") + F.col("bad"))
    best = reached.groupBy("lang").agg((F.max_by("at", F.struct(f1, -F.abs(F.col("at") - 50))) / 100).alias("threshold"))
    return scored.join(best, "lang", "left").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.coalesce("threshold", F.lit(0.5)).alias("threshold"), (F.col("score") >= F.coalesce("threshold", F.lit(0.5))).alias("flagged"),
    )

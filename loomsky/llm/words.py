"""Vectorised hashing of the words of many texts (runs inside Python tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_coef = mix(np.arange(1, 65, dtype=np.uint64) * C1)


def _coefficients(n: int) -> np.ndarray:
    global _coef
    if len(_coef) < n:
        _coef = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * C1)
    return _coef


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of ``texts`` (A-Z lower-cased), and the
    offsets that bound each text's words in them (one more than there are texts)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SPACE[buf]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    heads = np.flatnonzero(first)
    starts = at[heads]
    sizes = np.diff(np.append(heads, len(at)))
    pos = at - np.repeat(starts, sizes)
    coef = _coefficients(int(sizes.max()))
    value = (_LOWER[buf[at]].astype(np.uint64) + np.uint64(1)) * coef[pos]
    hashes = mix(np.add.reduceat(value, heads) + sizes.astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of the whole sequence where there are fewer; of none, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total * C2 + words[i : len(words) - n + 1 + i])
    return total


def in_slices(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts of ``column``, of which only so many rows are Python's at once."""
    for low in range(0, len(column), rows):
        yield from column.slice(low, rows).to_pylist()


def in_chunks(texts: Iterable[str | None], limit: int = 1 << 20):
    """(first index, encoded texts) with about ``limit`` bytes each, so that buffers stay small; a null is empty."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield start, held

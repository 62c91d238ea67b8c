"""ProbMinHash signatures of weighted word shingles (Ertl), vectorized over a batch of documents.

Every shingle d of weight w starts a Poisson process of rate w; its k-th arrival falls into a register that a hash of (d, k)
picks. A register holds the shingle of its earliest arrival, so two documents agree in a register with a probability that
is their probability Jaccard similarity. A process stops as soon as its next arrival is later than the
latest register of its document: nothing it brings could matter (early termination).
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, on wrapping arithmetic."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of word shingles; remembers word hashes up to a bound."""

    def __init__(self, limit: int = 500_000):
        self.words: dict[str, int] = {}
        self.limit = limit

    def __call__(self, text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes, and how often each occurs. Shorter texts are one shingle; no words, none."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.words
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - size + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(size, len(words))):
            out = mix(out * STEP + h[i : i + n] + np.uint64(i + 1))
        return np.unique(out, return_counts=True)


def signatures(shingles: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of `registers` 64-bit values for each document; documents without shingles have zeros."""
    docs = len(shingles)
    sizes = np.array([len(s) for s, _ in shingles])
    out = np.zeros(docs * registers, np.uint64)
    if not sizes.sum():
        return out.reshape(docs, registers)
    element = np.concatenate([s for s, _ in shingles])
    rate = np.concatenate([c for _, c in shingles]).astype(np.float64)
    doc = np.repeat(np.arange(docs), sizes)
    at = np.zeros(len(element))
    first = np.full(docs * registers, np.inf)
    step = np.zeros(1, np.uint64)  # an array, so that it wraps silently
    while len(element):
        step += STEP
        draw = mix(element + step)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = at - np.log(uniform) / rate
        place = doc * registers + (mix(draw ^ STEP) >> np.uint64(32)).astype(np.int64) * registers // (1 << 32)
        earlier = at < first[place]
        p, t, e = place[earlier], at[earlier], element[earlier]
        np.minimum.at(first, p, t)
        won = first[p] == t
        out[p[won]] = e[won]
        latest = first.reshape(docs, registers).max(axis=1)
        go = at < latest[doc]
        element, rate, doc, at = element[go], rate[go], doc[go], at[go]
    return out.reshape(docs, registers)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` registers; the same registers in another band give another key."""
    cut = signature.reshape(len(signature), -1, rows)
    key = np.zeros(cut.shape[:2], np.uint64) + np.arange(cut.shape[1], dtype=np.uint64) * MIX1
    for i in range(rows):
        key = mix(key * STEP + cut[:, :, i])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity: for each common shingle d, 1 / sum over all shingles x of
    max(a[x] / a[d], b[x] / b[d]). Sorted by a / b, the maximum is the first term before d and the second after it."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    u, v = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    only_a, only_b = a[1].sum() - u.sum(), b[1].sum() - v.sum()
    larger = np.cumsum(u[::-1])[::-1] + only_a  # u / u[d] rules where the ratio is at least that of d
    smaller = np.cumsum(v) - v + only_b
    return float((1 / (larger / u + smaller / v)).sum())

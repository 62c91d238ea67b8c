"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1 is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry resolves in one probe and one
comparison. Tier 2, for misses, merges the linked bytes of the pre-token by rank with a heap.

The hash is built on the driver, by hash and displace: keys fall into buckets, the largest buckets first look for a
displacement that sends all their keys to free slots, and buckets of one key take the slots that are left. Workers get
only the displacements (a quarter of the vocabulary's size) and read the rank file themselves.

Each worker remembers what it has encoded, up to a bound; that only saves work.

Defined cases: a null text is empty, with no ids; an empty table gives an empty result; unknown ids fail to decode.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import slices

LOAD = 4  # keys to a bucket
MEMO = 800_000
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash: n keys to slots 0 to n - 1. Other keys get some slot, so compare the key found there."""

    def __init__(self, n: int, displacements: list[int]):
        self.n, self.displacements = n, displacements
        self.buckets = len(displacements)

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        return (((h ^ (d * STEP)) * STEP & MASK) >> 32) * n >> 32

    @classmethod
    def build(cls, keys: Iterable[bytes]) -> PerfectHash:
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        n = len(hashes)
        buckets: list[list[int]] = [[] for _ in range(max(1, -(-n // LOAD)))]
        for h in hashes:
            buckets[h % len(buckets)].append(h)
        taken, out = bytearray(n), [0] * len(buckets)
        order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            d = 1
            while True:
                slots = {cls._slot(h, d, n) for h in buckets[b]}
                if len(slots) == len(buckets[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            out[b] = d
            for s in slots:
                taken[s] = 1
        free = (s for s in range(n) if not taken[s])
        for b in order:
            if len(buckets[b]) == 1:
                out[b] = -next(free) - 1
        return cls(n, out)

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.displacements[h % self.buckets]
        return -d - 1 if d < 0 else self._slot(h, d, self.n)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, perfect: PerfectHash, memo: int = MEMO):
        import regex

        self.ranks, self.perfect, self.limit = ranks, perfect, memo
        self.split = regex.compile(pattern).findall
        self.slots: list[tuple[bytes, int]] = [(b"", 0)] * perfect.n
        for token, rank in ranks.items():
            self.slots[perfect(token)] = (token, rank)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier 2: the pair of least rank, of equal ones the leftmost, joins until no pair is in the vocabulary."""
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (mid := after[i]) >= n or after[mid] != end:
                continue  # one of its halves has changed
            alive[mid] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (rank := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if (known := self.words.get(word)) is None:
            piece = word.encode("utf-8", "surrogatepass")
            token, rank = self.slots[self.perfect(piece)]
            known = (rank,) if token == piece else self.merge(piece)
            if len(self.words) >= self.limit:  # what came first is mostly what comes often
                self.words = dict(islice(self.words.items(), self.limit // 2))
            if len(word) < 200:
                self.words[word] = known
        return known

    def encode(self, text: str) -> list[int]:
        """The pattern is applied to each chunk between line feeds-free single spaces apart, where its matches never cross."""
        parts = text.split(" ")
        if "" in parts or "\n" in text and (" \n" in text or "\n " in text) or not text.isprintable() and _other_space(text):
            return list(chain.from_iterable(map(self.word, self.split(text))))
        memo, out = self.memo, [self._chunk(parts[0])]
        for p in parts[1:]:
            ids = memo.get(p)
            if ids is None:
                ids = self._chunk(" " + p)
                if len(memo) >= self.limit:
                    self.memo = memo = dict(islice(memo.items(), self.limit // 2))
                if len(p) < 200:
                    memo[p] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.word, self.split(chunk))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


def _other_space(text: str) -> bool:
    """Whether white space other than the space and the line feed occurs."""
    return any(c.isspace() for c in set(text) - {" ", "\n"})


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str, displacements: list[int]) -> ByteBPE:
    """One coder for all tasks of a worker."""
    if (path, pattern) not in _coders:
        ranks = load_ranks(path)
        _coders[path, pattern] = ByteBPE(ranks, pattern, PerfectHash(len(ranks), displacements))
    return _coders[path, pattern]


def _hash_of(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(PerfectHash.build(load_ranks(path)).displacements)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))


def bpe_encode(docs: DataFrame, *, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of every row."""
    table = _hash_of(docs, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern, table.value)
        for rows, texts in slices(batches):
            ids = pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("key"), ids], names=[key, "ids"])

    return _rows(docs, key, text).mapInArrow(run, f"`{key}` long, ids array<int>")


def bpe_decode(encoded: DataFrame, *, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text (as binary) of every row of ids; null ids give null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in load_ranks(vocabulary).items()}
        for rows in batches:
            out = [None if r is None else b"".join(tokens[i] for i in r) for r in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(out, pa.binary())], names=[key, "text"])

    return encoded.select(F.col(key).cast("bigint").alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` long, text binary")


def bpe_digests(docs: DataFrame, *, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids decoded again, in one pass."""
    table = _hash_of(docs, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern, table.value)
        for rows, texts in slices(batches):
            n, of_ids, of_text = [], [], []
            for t in texts:
                ids = bpe.encode(t)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.decimal(ids).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, key, text).mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")

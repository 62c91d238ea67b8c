"""Phrase collocation mining: n-gram counts from word-id suffix arrays, and phrases scored by their weakest cut.

1. Shards. A task reads its texts as words and punctuation (each word an id in the dictionary of the block, each punctuation mark a border) and, whenever a language
   has BLOCK_WORDS of them, sorts the block's suffixes by prefix doubling in numpy. Suffixes that share their first k words stand
   together; an interval whose longest common prefixes are k or more is one k-gram, and its length the k-gram's count in the block.
2. Merge. Counts of equal phrases are added over all blocks, with a combine before the shuffle.
3. Longer phrases go level by level: a k-gram occurs at least min_count times only if both (k-1)-grams in it do. Those make a Bloom filter, of `FILTER_BITS` bits at most; shards
   drop the positions of other words before they sort. False alarms only cost work: counts are exact.
4. Scores. Each cut of a candidate meets the counts of its two parts in joins that split hot keys; counts are multiplied as 38-digit decimals, which
   hold any count up to 10^15.
5. The first rows of each language are taken among salted parts first, then among what these leave.

Blocks hold bounded memory however long a text is: a text that goes on beyond a block leaves its last words to the next, so no phrase is lost or counted twice.

Defined cases: a null or empty text has no words; a null language is UND; repeated rows count each; ties of scores go by count, then phrase; a language without
a candidate gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_to_groups, materialize, quoted, text_or_empty

MIN_COUNT, MAX_WORDS, TOP, COVERED = 10, 3, 2000, 50
UND = "und"
#: Words of a block, and bytes of text that are split together.
BLOCK_WORDS, SLICE = 2_000_000, 1 << 20
#: Bits of the filter for each phrase, and at most.
PHRASE_BITS, FILTER_BITS = 16, 1 << 28
SALTS = 64
SCALE = 1_000_000
BORDERS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of a text as they count: A-Z in lower case, a border as a full stop, a tab as a space.
TABLE = bytes(ord(".") if b in BORDERS else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
NOTHING, BORDER = 0, 1
GRAMS = "lang string, phrase string, words int, n long"
#: Odd multipliers of the filter's probes.
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Vocabulary(dict):
    """Ids of words in the order they come; an empty string and a border have fixed ones."""

    def __init__(self):
        super().__init__({b"": NOTHING, b".": BORDER})

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` ids or more, by prefix doubling: ranks by h ids give ranks by 2h."""
    rank, n, h = ids.astype(np.int64), len(ids), 1
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while h < depth:
        key = rank * (int(rank.max(initial=0)) + 2)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key)
        key = key[order]
        h *= 2
        if h < depth:
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    return order if n else np.zeros(0, np.int64)


def lcp_intervals(ids: np.ndarray, lengths: tuple[int, ...], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length k: the ids of every k-gram without a border that begins before position `first`, and its count."""
    depth = max(lengths)
    order = suffix_array(ids, depth)
    order = order[order < first]
    padded = np.concatenate([ids, np.full(depth, BORDER, ids.dtype)])
    columns = [padded[order + j] for j in range(depth)]
    reach, lcp = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)  # words before a border; of those shared with the suffix before
    for column in columns:
        on = (reach == reach.max(initial=0)) & (column != BORDER)
        same = on.copy()
        same[1:] &= (column[1:] == column[:-1]) & (lcp[1:] == reach[1:])
        same[:1] = False
        lcp += same
        reach += on
    for k in lengths:
        held = np.flatnonzero(reach >= k)
        starts = np.flatnonzero(lcp[held] < k)
        yield np.stack([c[held[starts]] for c in columns[:k]]), np.diff(np.append(starts, len(held)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def phrase_hashes(words: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of phrases from those of their words: one row for each place in the phrase."""
    h = np.full(words.shape[1], xxhash.xxh3_64_intdigest(lang), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(PROBES[0])
        h ^= h >> np.uint64(29)
    return h


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    shift = np.uint64(65 - bits.bit_length())
    for p in PROBES:
        yield (hashes * np.uint64(p)) >> shift


class PhraseFilter:
    """Which phrases may be frequent: a Bloom filter, built on the executors and sent to all."""

    def __init__(self, phrases: DataFrame, count: int):
        self.bits = bits = min(FILTER_BITS, 1 << max(15, (count * PHRASE_BITS).bit_length()))

        def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                    found.append(phrase_hashes(word_hashes(phrase.encode().split(b" "))[:, None], lang)[0])
                for p in probes(np.array(found, np.uint64), bits):
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64) + 1)], names=["place"])

        marked = phrases.select("lang", "phrase").mapInArrow(places, "place long")
        parts = marked.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        self.map = np.zeros(bits // 8, np.uint8)
        for r in parts.collect():  # at most FILTER_BITS / 32,768 rows of 4 KB
            part = np.frombuffer(r["bits"], np.uint8)
            at = (r["bucket"] - 1) * part.size
            self.map[at : at + part.size] = part[: self.map.size - at]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in probes(hashes, self.bits):
            found &= (self.map[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


class Block:
    """The words of one language that a task has read and not yet counted."""

    def __init__(self, lang: str, lengths: tuple[int, ...], known: PhraseFilter | None):
        self.lang, self.lengths, self.known = lang, lengths, known
        self.words, self.ids = Vocabulary(), array("i")

    def add(self, text: bytes) -> None:
        self.ids.extend(map(self.words.__getitem__, text.split(b" ")))

    def count(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The block's phrases. Unless last, the words after the last border that a longer phrase may need stay, and phrases that begin with them wait."""
        ids = np.frombuffer(self.ids, np.int32)
        ids = ids[ids != NOTHING]
        words, self.words, self.ids = list(self.words), Vocabulary(), array("i")
        first = len(ids)
        if not last:
            tail = ids[max(0, len(ids) - max(self.lengths) + 1) :]
            tail = tail[int(np.flatnonzero(tail == BORDER).max(initial=-1)) + 1 :]
            first -= len(tail)
            self.ids.extend(self.words[words[i]] for i in tail.tolist())
        if self.known is not None:
            ids, first = self.promising(ids, first, words)
        texts = pa.array(words, pa.binary())
        for found, n in lcp_intervals(ids, self.lengths, first) if len(ids) else ():
            k = len(found)
            for i in range(0, len(n), 50_000):
                parts = [texts.take(pa.array(row[i : i + 50_000])) for row in found]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" ")
                yield _grams(self.lang, phrase.cast(pa.string()), k, n[i : i + 50_000])
            if k == 1:
                yield _grams(self.lang, pa.array([""]), 0, n.sum(keepdims=True))

    def promising(self, ids: np.ndarray, first: int, words: list[bytes]) -> tuple[np.ndarray, int]:
        """The ids without those that no k-gram holds whose two (k-1)-grams may be frequent."""
        (k,) = self.lengths
        starts = max(0, len(ids) - k + 1)
        hashes = word_hashes(words)[ids]
        shorter = self.known(phrase_hashes(np.stack([hashes[j : starts + 1 + j] for j in range(k - 1)]), self.lang)) if starts else np.zeros(1, bool)
        begins = np.zeros(len(ids) + 1, np.int32)
        hit = np.flatnonzero(shorter[:-1] & shorter[1:])
        np.add.at(begins, hit, 1)
        np.add.at(begins, hit + k, -1)
        inside = np.cumsum(begins)[:-1] > 0
        kept = inside.copy()
        kept[1:] |= inside[:-1]  # the word after a kept run becomes its border
        out = np.where(inside, ids, BORDER)[kept]
        return out, int(kept[:first].sum())


def _grams(lang: str, phrase: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), phrase, pa.array(np.full(len(n), k, np.int32)), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in the form of TABLE with borders as words of their own, in slices that end at a space."""
    text = text.translate(TABLE)
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= SLICE else text.find(b" ", start + SLICE)
        end = len(text) if end < 0 else end
        yield text[start:end].replace(b".", b" . ")
        start = end
    yield b"."


def phrase_counts(texts: DataFrame, lengths: tuple[int, ...], known: Broadcast | None = None) -> DataFrame:
    """lang, phrase, words, n of every phrase of `lengths` words (with length 1, the phrase '' counts all words), for texts (lang, text in bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                block = blocks.get(lang) or blocks.setdefault(lang, Block(lang, lengths, known.value if known else None))
                for part in _parts(text.as_py()):
                    before = len(block.ids)
                    block.add(part)
                    held += len(block.ids) - before
                    if len(block.ids) >= BLOCK_WORDS:
                        held -= len(block.ids)
                        yield from block.count(last=False)
                        held += len(block.ids)
                if held >= 2 * BLOCK_WORDS or len(blocks) > 1000:  # many languages with a little each
                    for b in blocks.values():
                        yield from b.count(last=True)
                    blocks, held = {}, 0
        for b in blocks.values():
            yield from b.count(last=True)

    return texts.mapInArrow(run, GRAMS).groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, phrase, words, n of every phrase of 1 to max_words words with min_count occurrences, and for each language '' with those of all words. A written table."""
    texts = docs.select(F.coalesce(F.col(quoted(lang)), F.lit(UND)).alias("lang"), text_or_empty(quoted(text)).cast("binary").alias("text"))
    often = F.col("n") >= min_count
    levels = [materialize(phrase_counts(texts, tuple(range(1, min(2, max_words) + 1))).where(often | (F.col("words") == 0)), "phrases")]
    for k in range(3, max_words + 1):
        shorter = levels[-1].where(F.col("words") == k - 1)
        known = docs.sparkSession.sparkContext.broadcast(PhraseFilter(shorter, shorter.count()))
        levels.append(materialize(phrase_counts(texts, (k,), known).where(often), "phrases"))
    if len(levels) == 1:
        return levels[0]
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    together = materialize(found, "phrases")
    discard(*levels)
    return together


def _words(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    phrases: DataFrame, *, top: int = TOP, covered: int = COVERED, longest: int = MAX_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, from the counts of frequent_phrases.

    A phrase is dropped if a longer one holds it that occurs at least `covered` per cent as often.
    """
    whole = F.split("phrase", " ")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), whole.alias("_w"))
    counts = phrases.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n"))
    cuts = candidates.select("lang", "phrase", "a", "_w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    for side, part in (("l", _words(F.col("_w"), 1, F.col("cut"))), ("r", _words(F.col("_w"), F.col("cut") + 1, F.col("words") - F.col("cut")))):
        key = F.struct("lang", "part")
        named = counts.select(key.alias("_part"), F.col("n").alias(side))
        cuts = join_to_groups(cuts.withColumn("_part", F.struct("lang", part.alias("part"))), named, "_part").drop("_part")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    score = F.call_function("div", above.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")).cast("bigint")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("_weakest"), F.lit(None).cast("bigint").alias("_longer"))
    for k in range(2, longest):
        parts = F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda start: _words(F.col("_w"), start, F.lit(k)))  # noqa: B023
        part = candidates.where(F.col("words") > k).select("lang", "a", F.explode(parts).alias("phrase"))
        nothing = F.lit(None).cast(scored.schema["_weakest"].dataType)
        scored = scored.unionByName(part.select("lang", "phrase", F.lit(None).cast("bigint").alias("a"), nothing.alias("_weakest"), F.col("a").alias("_longer")))
    judged = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("_weakest").alias("_cut"), F.max("_longer").alias("_longer"))
    kept = judged.where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * covered)).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

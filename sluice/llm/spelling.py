"""Spelling variants by anagram hashing.

Each letter has a value, the fifth power of its code point, and the key of a word is the sum of its letters' values: anagrams share a key, and one letter added,
removed or exchanged changes it by that letter's value or by the difference of two. So two words can be one letter apart only if

* the key of the longer one less the value of one of its letters is the key of the shorter one, or
* both keys less the value of one letter each are the same.

A word has at most as many such values as different letters, however long it is, and words meet in an equi-join on them. Anagrams of many words would
meet in vain, so the letters before or those after the middle, one of which a single change leaves alone, are part of the join key: a change in the
second half is looked for among words of the same first half, and the other way round. Candidates are then verified by letter order.

Each word's form is its near word of most occurrences, if that has at least `ratio` times as many. A step to a form multiplies the occurrences, so chains
are short: their ends are found by doubling, in as many rounds as the logarithm of the longest possible chain.

Defined cases: a null or empty text has no words; very long texts are read in slices and very long words compared in linear time; a null key counts as
the empty text; repeated rows count each; ties of forms go to the first word in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, quoted, text_or_empty

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Words that a task counts before it hands them on, and characters of text that it looks at together.
HELD_WORDS, SLICE = 400_000, 1_000_000
LETTER = "A-Za-zÀ-ÿ"
POWER = 5
NEAR = "key long, half string, role string, word string, n long"


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _slices(text: str, other: re.Pattern) -> Iterator[str]:
    """Parts of a text that don't cut a word."""
    start = 0
    while len(text) - start > SLICE:
        end = other.search(text, start + SLICE)
        if end is None:
            break
        yield text[start : end.start()]
        start = end.start()
    yield text[start:] if start else text


def word_counts(docs: DataFrame, *, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z, of at least min_letters code points and min_count occurrences.

    slip: to plant errors, runs for which it divides the crc32 of '<key>:<run>' lose the letter at that crc32 modulo their length.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, other = re.compile(f"[{LETTER}]{{{min_letters},}}"), re.compile(f"[^{LETTER}]")
        held: Counter[str] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            found = [(w, n) for w, n in held.items() if n and len(w) >= min_letters]
            held.clear()
            for i in range(0, len(found), 50_000):
                words, counts = zip(*found[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                before = zlib.crc32(f"{k}:".encode())
                for part in _slices(t.as_py(), other):
                    words = run.findall(lower_ascii(part))
                    held.update(words)
                    if slip:
                        for w in set(words):
                            h = zlib.crc32(w.encode(), before)
                            if h % slip == 0:
                                n, at = words.count(w), h % len(w)
                                held[w] -= n
                                held[w[:at] + w[at + 1 :]] += n
                    if len(held) > HELD_WORDS:
                        yield from rows()
        yield from rows()

    texts = docs.select(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).alias("key"), text_or_empty(quoted(text)).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_value(letter: str) -> int:
    return ord(letter) ** POWER


def anagram_key(word: str) -> int:
    return sum(n * letter_value(c) for c, n in Counter(word).items())


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def neighbour_keys(word: str) -> Iterator[tuple[int, str, str]]:
    """key, half, role of the rows by which a word meets the words one letter away.

    Roles: x, one letter taken out to be exchanged; l, one letter taken out of the longer word; s, the shorter word as it is. half names the length, whether the first
    or the last letters are meant, and those letters; for l they are those of the shorter word.
    """
    key, size = anagram_key(word), len(word)
    value = {c: letter_value(c) for c in set(word)}
    for role, shorter in (("x", size), ("l", size - 1)):
        middle = shorter // 2
        tail = middle + size - shorter
        mark = "x" if role == "x" else "d"
        for c in set(word[middle:]):
            yield _signed(key - value[c]), f"{mark}{shorter}<{word[:middle]}", role
        for c in set(word[:tail] if role == "l" else word[:middle]):
            yield _signed(key - value[c]), f"{mark}{shorter}>{word[tail:]}", role
    yield _signed(key), f"d{size}<{word[: size // 2]}", "s"
    yield _signed(key), f"d{size}>{word[size // 2 :]}", "s"


def near_pairs(words: DataFrame) -> DataFrame:
    """one, other, one_n, other_n: each pair of different words (word, n) that one inserted, deleted or replaced code point tells apart, once."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*row, w, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True) for row in neighbour_keys(w)]
            for i in range(0, len(found), 50_000):
                columns = list(zip(*found[i : i + 50_000], strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NEAR.split(", ")])

    keyed = materialize(words.select("word", "n").mapInArrow(rows, NEAR), "spelling-keys")
    a, b = keyed.where("role <> 's'").alias("a"), keyed.where("role <> 'l'").alias("b")
    # a letter of a run of equal ones may count as taken from either half; the first half comes first
    middle = F.floor(F.length("b.word") / 2).cast("int")
    first_half = F.substring("a.word", F.lit(1), middle) == F.substring("b.word", F.lit(1), middle)
    once = F.when(F.col("a.role") == "x", (F.col("b.role") == "x") & (F.col("a.word") < F.col("b.word"))).otherwise(
        (F.col("b.role") == "s") & (F.col("a.half").contains("<") | ~first_half)
    )
    near = F.levenshtein("a.word", "b.word", 1) == 1
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.half") == F.col("b.half")) & once & near
    return a.join(b.hint("merge"), met).select(F.col("a.word").alias("one"), F.col("b.word").alias("other"), F.col("a.n").alias("one_n"), F.col("b.n").alias("other_n"))


def _ends(links: DataFrame, steps: int) -> DataFrame:
    """word, root: where the links word -> root of at most `steps` steps end."""
    reached = 1
    while reached < steps:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        doubled = materialize(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
        discard(links)
        links, reached = doubled, 2 * reached
    return links


def spelling_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words (word, n), which differ."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that chains of forms end")
    words = materialize(words, "spelling-words")
    pair = F.explode(F.array(F.struct(F.col("one").alias("word"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("near")),
                             F.struct(F.col("other").alias("word"), F.struct((-F.col("one_n")).alias("n"), F.col("one").alias("word")).alias("near"))))
    best = near_pairs(words).select(pair.alias("_p")).select("_p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("_best"))
    led = -F.col("_best.n") >= ratio * F.col("n")
    forms = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("_best.word")).alias("form"), F.when(led, -F.col("_best.n")).alias("form_n")
        ),
        "spelling-forms",
    )
    discard(words)
    least, most = forms.agg(F.min("n"), F.max("n")).first()
    steps = 0
    while least and least * ratio ** (steps + 1) <= most:
        steps += 1
    links = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    return forms.join(_ends(links, steps), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

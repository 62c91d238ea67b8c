"""Exact deduplication with a Bloom filter of repeated hashes, with DataFrame functions only.

Pass 1 counts, over the whole table, how many rows set each bit of a blocked Bloom filter and keeps the bits that at
least two rows set. Pass 2 tests each row: a row with a bit that no other row set is unique and passes straight
through; only the others shuffle, on their SHA-256, and are decided exactly.

The filter has BITS_PER_ROW bits a row, so about one unique row in twenty is a false alarm at any size. It is broadcast, so its size is
bounded: a table that needs more than `max_bits` is cut into slices by hash, each with a filter of its own and at the same rate.
The rows of a slice are read when its turn comes, so a table of n slices is read n times.

Defined cases: a null text counts as the empty text; of rows with equal text and equal key exactly one stays; a null
key ranks below any other; an empty table gives an empty result; further columns of any name and type pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted, text_or_empty

BITS_PER_ROW = 8
MAX_BITS = 1 << 30
#: Filter words of 64 bits in one row of the broadcast table.
CHUNK = 1024


def _bits(digest: Column) -> list[Column]:
    """Two bit places of a row within its filter word, from bits of the digest that neither word nor slice use."""
    return [F.shiftrightunsigned(digest, s).bitwiseAND(63).cast("int") for s in (40, 46)]


def _word(digest: Column, words: int) -> Column:
    return digest.bitwiseAND(words - 1)


def filter_shape(rows: int, max_bits: int = MAX_BITS) -> tuple[int, int]:
    """Slices, and filter words (a power of two) of each."""
    slices = max(1, -(-rows * BITS_PER_ROW // max_bits))
    words = 1 << max(6, (rows * BITS_PER_ROW // slices // 64).bit_length())
    return slices, words


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """_chunk, _words: every filter word, with the bits that two rows or more of column _h have set."""
    h = F.col("_h")
    places = F.array_distinct(F.array(*[_word(h, words) * 64 + b for b in _bits(h)]))
    repeated = (
        hashes.select(F.explode(places).alias("_place"))
        .groupBy("_place")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.shiftright("_place", 6).alias("_word"), F.expr("shiftleft(1L, cast(_place & 63 as int))").alias("_set"))
    )
    none = hashes.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_set"))
    each = repeated.unionByName(none).groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    chunk = F.floor(F.col("_word") / CHUNK).alias("_chunk")
    return each.groupBy(chunk).agg(F.transform(F.sort_array(F.collect_list(F.struct("_word", "_set"))), lambda x: x["_set"]).alias("_words"))


def flag_possible_repeats(docs: DataFrame, *, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc (the row as a struct), maybe: false only for rows whose text is surely unique. Nothing of docs is shuffled."""
    slices, words = filter_shape(docs.count(), max_bits)
    hashed = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), F.xxhash64(text_or_empty(quoted(text))).alias("_h"))
    h = F.col("_h")
    word = _word(h, words)
    mask = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in _bits(h)])
    own = F.element_at("_words", (word.bitwiseAND(min(CHUNK, words) - 1) + 1).cast("int"))
    flagged = []
    for i in range(slices):
        rows = hashed.where(F.shiftrightunsigned(h, 52) % slices == i) if slices > 1 else hashed
        bits = F.broadcast(repeated_bits(rows.select("_h"), words))  # at most max_bits / 64 words of 8 bytes
        flagged.append(rows.withColumn("_chunk", F.floor(word / CHUNK)).join(bits, "_chunk").select("doc", (own.bitwiseAND(mask) == mask).alias("maybe")))
    return reduce(DataFrame.unionAll, flagged)


def sha256(text: str = "text") -> Column:
    return F.sha2(text_or_empty(text).cast(T.BinaryType()), 256)


def dedup_decisions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row; the row with the largest key stays."""
    flagged = flag_possible_repeats(docs.select(quoted(key), quoted(text)), text=text)
    rows = materialize(
        flagged.select(F.col(f"doc.{quoted(key)}"), sha256(f"doc.{quoted(text)}").alias("text_sha256"), "maybe", F.monotonically_increasing_id().alias("_row")),
        "digests",
    )
    single = rows.where("not maybe").select(
        quoted(key), F.col(quoted(key)).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = rows.where("maybe").withColumn("_sha", F.unhex("text_sha256"))
    groups = (
        maybe.groupBy("text_sha256")
        .agg(F.max(F.struct(F.col(quoted(key)), F.col("_row"))).alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex("text_sha256").alias("_sha"), "_best", "group_size")
    )
    # joined on another form of the digest, so both sides shuffle and adaptive execution may split a hot group
    decided = maybe.join(groups.hint("merge"), "_sha").select(
        quoted(key), F.col(f"_best.{quoted(key)}").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256"
    )
    return single.unionByName(decided)


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each text; columns and texts as they came."""
    flagged = flag_possible_repeats(docs, text=text)
    single = flagged.where("not maybe").select("doc.*")
    best = (
        flagged.where("maybe")
        .select("doc", sha256(f"doc.{quoted(text)}").alias("_sha"), F.monotonically_increasing_id().alias("_row"))
        .groupBy("_sha")
        .agg(F.max_by("doc", F.struct(f"doc.{quoted(key)}", "_row")).alias("doc"))
        .select("doc.*")
    )
    return single.unionByName(best)

"""Sharding by jump consistent hashing, with DataFrame functions only.

`jump_shards` maps a stable 64-bit key to a shard without a ring table (Lamping and Veach). Of the
rows of n shards, the step to n + 1 moves 1 / (n + 1), all of them into the new shard.

Defined cases: a null key counts as key 0; a null text has size `overhead` and the checksum of the
empty text; repeated rows each get a slot of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

#: Multiplier of the published 64-bit linear congruential step; the increment is 1.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Rows of one partition that are numbered together.
CHUNK_BITS = 12


def _times(half: Column, factor: int) -> tuple[Column, Column]:
    """half (32 bits) times a 32-bit factor, as 16-bit partial products that stay below 2**49."""
    return half * F.lit(factor & 0xFFFF), half * F.lit(factor >> 16)


def _lcg(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on 32-bit halves; no step overflows, so ANSI mode is fine."""
    m_low, m_high = MULTIPLIER & LOW32, MULTIPLIER >> 32
    a, b = _times(low, m_low)
    total = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftrightunsigned(total, 32) + F.shiftrightunsigned(b, 16)
    cross = F.lit(0).cast("bigint")
    for half, factor in ((high, m_low), (low, m_high)):
        c, d = _times(half, factor)
        cross = cross + c.bitwiseAND(LOW32) + F.shiftleft(d.bitwiseAND(0xFFFF), 16)
    return (carry + cross).bitwiseAND(LOW32), total.bitwiseAND(LOW32)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of key among `shards`, and among `shards + 1`.

    Both come from one walk: the jumps of a key do not depend on the number of shards.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(LOW32).alias("low"),
        F.lit(0).cast("bigint").alias("next"),
        F.lit(0).alias("shard"),
        F.lit(0).alias("grown"),
    )

    def step(state: Column, _: Column) -> Column:
        at = state["next"]
        high, low = _lcg(state["high"], state["low"])
        jump = (at + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            F.floor(jump).cast("bigint").alias("next"),
            F.when(at < shards, at.cast("int")).otherwise(state["shard"]).alias("shard"),
            at.cast("int").alias("grown"),
        )
        return F.when(at <= shards, moved).otherwise(state)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)
    return F.struct(walk["shard"].alias("shard"), walk["grown"].alias("grown_shard"))


def number_within(rows: DataFrame, group: str, row_id: str, out: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in the order of row_id, though a group may be huge.

    row_id is a stored monotonically_increasing_id; runs of 2**CHUNK_BITS ids are numbered apart and then shifted by
    the counts of the runs before them.
    """
    chunked = rows.withColumn("_chunk", F.shiftright(row_id, CHUNK_BITS))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunked.groupBy(group, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(row_id)) - 1
    return chunked.withColumn("_local", local).join(starts, [group, "_chunk"]).withColumn(out, F.col("_start") + F.col("_local")).drop("_chunk", "_local", "_start")


def shard_documents(
    docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """Key, size, text checksum, shard, grown_shard and slot of every row.

    The text is read once, reduced to its size and checksum, and never shuffled.
    """
    body = text_or_empty(text).cast(T.BinaryType())
    narrow = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("bigint") + overhead).alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shards(F.col(key), shards).alias("_to"),
        F.monotonically_increasing_id().alias("_row"),
    ).select(key, "size", "text_crc32", "_to.*", "_row")
    return number_within(materialize(narrow, "shards"), "shard", "_row", "slot").drop("_row")

"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

1. Targets. Sources in the order of their names take turns in `weights` and share the words of all documents by weight. No target goes beyond
   `max_repeats` times its source; what is above is shared again among the others until none is. Each round is one
   aggregation over the table of sources, of which the driver sees two sums.
2. Sampling. A document of a source is expected target / source size times. The documents of a source are ordered by size and key; the prefix sums of their expected
   copies, plus one random offset of the source, cross an integer for each copy that the mix takes. As all documents of a source expect
   the same, the k-th prefix sum is k times that number: nothing is added up, so nothing drifts. In the order of size the words taken
   differ from the target by about one document at most; where a few long documents hold most words that is much, so of OFFSETS offsets, spread
   evenly from a random one, a source takes the one that comes nearest to its target.

Places in the order come from one range sort over (source, size, key, row): a hot source and equal sizes are cut wherever a partition is full. Counts of
the sorted partitions, one row each, turn places in a partition into places in the whole.

Defined cases: a null or empty text has size 0 and takes 0 words; the null source is one source, the last; repeated rows are sampled each, and rows
alike in source, size and key share their copies in any order; a source without words has target 0; an empty table gives an empty result. The same
rows and seed give the same result, however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_to_groups, materialize, quoted, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix"
OFFSETS = 16
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
ROW_BITS = 33  # of monotonically_increasing_id; the partition stands above


def words_of(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def ordered(rows: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """rows, written in the given order, with their places from 0."""
    placed = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the sort
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = (F.col("_start") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)).alias(out)
    found = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, place)
    found._sluice_path = placed._sluice_path
    return found


def share_by_weight(sources: DataFrame, max_repeats: int) -> Column:
    """The target of each row of sources (source_size, _weight): a double."""
    cap, weight = F.col("source_size") * max_repeats, F.col("_weight")
    total, weights = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = float(total or 0) / (weights or 1)
    while True:
        full = cap <= weight * F.lit(level)
        capped, open_weights = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, weight))).first()
        if not open_weights or (higher := float(total - (capped or 0)) / open_weights) <= level:
            return F.least(cap.cast("double"), weight * F.lit(level))
        level = higher


def offset_of(source: str, seed: str) -> Column:
    """A number from 0 to below 1 for each source."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(source)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _decide(rows: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str) -> DataFrame:
    """_id, _row, _size, source_size, target, copies of the rows (_id, _source, _size, _row), which are a written table."""
    if max_repeats < 1 or min(weights) <= 0:
        raise ValueError("weights must be positive, and a source must be allowed all its words once")
    placed = ordered(rows, [F.asc_nulls_last("_source"), F.col("_size"), F.asc_nulls_last("_id"), F.col("_row")], "_place", "mix-documents")
    per_source = placed.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.min("_place").alias("_first"))
    turns = ordered(per_source, [F.asc_nulls_last("_source")], "_turn", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    turns = turns.withColumn("_weight", weight)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = turns.withColumn("target", share_by_weight(turns, max_repeats)).select(
        "_source", "source_size", "target", "_first", F.floor(expected).alias("_whole"), (expected - F.floor(expected)).alias("_part"), offset_of("_source", seed).alias("_base")
    )
    k = F.col("_place") - F.col("_first")

    def copies(offset: Column) -> Column:
        return (F.col("_whole") + F.floor(F.col("_part") * (k + 1) + offset) - F.floor(F.col("_part") * k + offset)).cast("bigint")

    offsets = [F.col("_base") + i / OFFSETS - F.floor(F.col("_base") + i / OFFSETS) for i in range(OFFSETS)]
    off = [F.struct(F.abs(F.sum(copies(o) * F.col("_size")) - F.max("target")).alias("by"), F.lit(i).alias("i"), F.max(o).alias("offset")) for i, o in enumerate(offsets)]
    chosen = join_to_groups(placed, sources, "_source").groupBy("_source").agg(F.array_min(F.array(*off))["offset"].alias("_offset"))
    named = chosen.select(F.col("_source").alias("_chosen"), "_offset")
    settled = sources.join(named, F.col("_source").eqNullSafe(F.col("_chosen"))).drop("_chosen")
    return join_to_groups(placed, settled, "_source").select("_id", "_row", "_size", "source_size", "target", copies(F.col("_offset")).alias("copies"))


def mix_decisions(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """key, size, source_size, target, copies, taken of every row. Texts are read once, for their sizes, and never shuffled."""
    sized = docs.select(F.col(quoted(key)).alias("_id"), F.col(quoted(source)).alias("_source"), words_of(quoted(text)).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(sized, "mix-sizes")
    decided = _decide(rows, weights, max_repeats, seed)
    discard(rows)
    taken = (F.col("copies") * F.col("_size")).alias("taken")
    return decided.select(F.col("_id").alias(key), F.col("_size").alias("size"), "source_size", "target", "copies", taken)


def mix_documents(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it."""
    stored = materialize(docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("_row")), "mix-texts")
    at = [f"doc.{quoted(c)}" for c in (key, source, text)]
    rows = stored.select(F.col(at[0]).alias("_id"), F.col(at[1]).alias("_source"), words_of(at[2]).alias("_size"), "_row")
    sized = materialize(rows, "mix-sizes")
    copies = _decide(sized, weights, max_repeats, seed).where("copies > 0").select("_row", "copies")
    discard(sized)
    return stored.join(copies, "_row").select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("doc.*")

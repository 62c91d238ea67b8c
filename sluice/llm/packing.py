"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous supersteps.

1. Documents are tokenized where they lie and cut; a piece keeps its length, its checksum and its rank among the pieces of the same
   length in its partition. Token ids go no further.
2. Lengths are integers up to the capacity, so counts by (partition, length) turn local ranks into ranks among all pieces of a
   length. Pieces of one length are a run, and so are sequences of one gap; a run is one row, however many pieces it has.
3. Supersteps, each a job on the table of runs. Pieces and gaps are sorted into ranges of size, and all ranges sweep at once, from large to small: each
   run of pieces takes its successor, the smallest gap of the range that holds it and that no longer piece has taken. Rank resolves
   conflicts: the k-th piece of a run takes the k-th sequence, one sequence as many as fit. Then gaps are updated: what a piece has left of one goes
   to the range of its new size, and gaps that no piece of their range could use go on to the next range below that still has pieces. A gap
   so meets larger ranges first and a piece smaller gaps first, as in one sweep over all.
4. When all gaps have passed the highest range that still has pieces, that range opens the sequences that it needs itself: for sizes of which fewer
   than MIXED fit in one, by number, else by volume. Ranges end at a half, a third and a fourth of the capacity, so shorter pieces then find
   what these have left before they open any. Each range numbers its own sequences.
5. Each piece finds its sequence by its rank, in parallel.

The driver sees how many runs each range has. The rows of a superstep are bounded by the capacity, and so is their number: neither grows with the number of
pieces, and no step brings all ranges together.

Defined cases: a null text is empty and packs as its end id alone; repeated rows are packed each; a null key is kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, text_or_empty
from .tokens import encoder, slices

#: A row of a superstep, in range `at`. piece: a run of n pieces of length `size` from rank `first`. gap: a run of n sequences with `size` left, from number
#: `first`; new: one that this sweep has made. plan: n pieces of `length` from rank `rank`, `fit` to a sequence, from number `first`
#: on, where `size` was left. next: `first` is the number of the next sequence that this range opens.
RUN = "kind string, size long, first long, n long, length long, rank long, fit long, at int"
FIELDS = [c.split()[0] for c in RUN.split(",")][:-1]
#: Ranges hold sizes of more than these shares of the capacity, the last one all below.
SHARES = (2, 3, 4, 8, 16, 64)
MIXED = 4
#: Numbers of sequences that a range may open.
NUMBERS = 1 << 50


def cut_lengths(n: int, capacity: int) -> list[int]:
    """A document longer than the capacity: a first piece of what is left over, then whole ones."""
    whole, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


def sweep(runs: pd.DataFrame) -> pd.DataFrame:
    """One sweep over the runs, from large to small: the top of the stack is the smallest gap not yet taken."""
    order = np.lexsort((runs["first"], runs["kind"] == "piece", -runs["size"]))
    out: list[tuple] = []
    stack: list[list[int]] = []
    for kind, size, first, n, *rest in runs.to_numpy()[order].tolist():
        if kind == "gap":
            stack.append([size, first, n])
            continue
        if kind != "piece":
            out.append((kind, size, first, n, *rest))
            continue
        while n and stack:
            gap, sequence, open_n = stack[-1]
            fit = gap // size
            full = min(open_n, n // fit)
            used = full + (full < open_n and n > full * fit)
            placed = min(n, used * fit)
            out.append(("plan", gap, sequence, placed, size, first, fit))
            out.append(("new", gap - fit * size, sequence, full, 0, 0, 0))
            if used > full:
                out.append(("new", gap - (placed - full * fit) * size, sequence + full, 1, 0, 0, 0))
            first, n = first + placed, n - placed
            if used == open_n:
                stack.pop()
            else:
                stack[-1] = [gap, sequence + used, open_n - used]
        if n:
            out.append(("piece", size, first, n, 0, 0, 0))
    out += [("gap", *g, 0, 0, 0) for g in stack]
    return pd.DataFrame([r for r in out if r[3] and (r[1] or r[0] != "new")], columns=FIELDS)


def superstep(runs: pd.DataFrame, capacity: int, opens: bool) -> pd.DataFrame:
    """Sweeps over one range until its pieces have used all gaps that they can; with `opens`, the range opens sequences for the rest."""
    (at,) = runs["at"].unique()
    runs = runs[FIELDS]
    plans = [runs[:0]]
    while True:
        swept = sweep(runs)
        placed = swept["kind"] == "plan"
        plans.append(swept[placed])
        runs = swept[~placed].copy()
        runs.loc[runs["kind"] == "new", "kind"] = "gap"
        piece, head = runs["kind"] == "piece", runs["kind"] == "next"
        if placed.any() and piece.any():
            continue
        if not (opens and piece.any()):
            break
        n, size = runs["n"][piece], runs["size"][piece]
        fit = capacity // int(size.max())
        need = -(-int(n.sum()) // fit) if fit < MIXED else -(-int((size * n).sum()) // capacity)
        number = int(runs["first"][head].iloc[0])
        runs.loc[head, "first"] = number + need
        runs = pd.concat([runs, pd.DataFrame([("gap", capacity, number, need, 0, 0, 0)], columns=FIELDS)], ignore_index=True)
    out = pd.concat([*plans, runs], ignore_index=True)
    return out.assign(at=np.int32(at))


def match_runs(counts: DataFrame, capacity: int) -> list[DataFrame]:
    """The supersteps for the pieces counted by (length, n): written tables of runs, whose plan rows place all pieces."""
    spark, last = counts.sparkSession, len(SHARES)

    def natural(size: Column) -> Column:
        return reduce(Column.__add__, [(size * share <= capacity).cast("int") for share in SHARES])

    none = [F.lit(0).cast("bigint").alias(c) for c in ("length", "rank", "fit")]
    size = F.col("length").cast("bigint")
    start = counts.select(F.lit("piece").alias("kind"), size.alias("size"), F.lit(0).cast("bigint").alias("first"), "n", *none, natural(size).alias("at"))
    heads = spark.createDataFrame([("next", 0, r * NUMBERS, 1, 0, 0, 0, r) for r in range(last + 1)], RUN)
    steps = [materialize(start.unionByName(heads), "runs")]
    while True:
        # a gap goes on to the range of its size, or past the range that could not use it
        state = steps[-1].where("kind <> 'plan'").withColumn("onward", F.when(F.col("kind") == "gap", F.greatest(natural(F.col("size")), F.col("at") + 1)).otherwise(F.col("at")))
        held = {(r["kind"], r["onward"]) for r in state.select("kind", "onward").distinct().collect()}
        pieces = sorted(at for kind, at in held if kind == "piece")
        if not pieces:
            return steps
        goal = {r: next((p for p in pieces if p >= r), -1) for r in range(last + 2)}
        opens = pieces[0] if all(goal[at] != pieces[0] for kind, at in held if kind == "gap") else -1
        to = F.element_at(F.array(*[F.lit(goal[r]) for r in range(last + 2)]), F.col("onward") + 1)
        moved = state.withColumn("at", F.when(F.col("kind") == "gap", to).otherwise(F.col("at"))).drop("onward").where("at >= 0")

        steps.append(materialize(moved.groupBy("at").applyInPandas(_superstep_of(capacity, opens), RUN), "runs"))


def _superstep_of(capacity: int, opens: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    return lambda key, runs: superstep(runs, capacity, key[0] == opens)


def pack_runs(counts: DataFrame, capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, pieces to a sequence, offset) for the pieces counted by (length, n)."""
    steps = match_runs(counts, capacity)
    plan = [r for made in steps for r in made.where("kind = 'plan'").select("length", "rank", "n", "first", "fit", capacity - F.col("size")).collect()]
    discard(*steps)
    return np.array(plan, np.int64).reshape(-1, 6)


def place(plan: np.ndarray, capacity: int, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    top = int(plan[:, 1].max()) + 1
    row = plan[np.searchsorted(_order(plan, top), length * top + np.minimum(rank, top - 1), side="right") - 1]
    at = rank - row[:, 1]
    return row[:, 3] + at // row[:, 4], row[:, 5] + at % row[:, 4] * length


def _order(plan: np.ndarray, top: int) -> np.ndarray:
    return plan[:, 0] * top + plan[:, 1]


def token_pieces(docs: DataFrame, *, vocabulary: str, joined: bool, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's partition and rank there among pieces of its length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, joined).encode
        part, end, seen = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for rows, texts in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for k, ids in zip(rows.column("key").to_pylist(), encode(texts), strict=True):
                data, start = memoryview(ids + end), 0
                for i, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                    for column, value in zip(out, (k, i, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), part, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                    start += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=["key", "piece", "start", "length", "ids_crc32", "part", "local"]
            )

    rows = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long, part long, local long")


def pack_documents(docs: DataFrame, *, vocabulary: str, joined: bool = True, end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = materialize(token_pieces(docs, vocabulary=vocabulary, joined=joined, end_id=end_id, capacity=capacity, key=key, text=text), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = pack_runs(by_part.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    plan = docs.sparkSession.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = place(plan.value, capacity, b.column("length").to_numpy(), b.column("rank").to_numpy())
                kept = [b.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ranked.select("key", "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

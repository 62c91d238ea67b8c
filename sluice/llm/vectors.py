"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky).

Vectors are split in two halves and each half is quantised by its own codebook, so K centroids a half give K * K cells. A query
walks the cells in ascending order of its summed distance to the two centroids, with a heap over the two sorted centroid
lists, until the cells it has seen hold enough candidates. The entries of those cells are reranked by their exact
cosine in double precision.

* K grows with the square root of the number of entries, up to MAX_CENTROIDS. Codebooks are fitted on a sample of at most FIT_ROWS
  entries (a documented bound); every row is indexed.
* How many candidates are enough is measured: the true neighbours of at most TRIAL_QUERIES queries are found by brute force in one
  pass over the entries, and the count is taken that would have found `target_recall` of them. So clustered vectors cost little, and vectors
  without structure, whose fifth neighbour is hardly nearer than a random vector, cost what they need.
* Vectors of one direction have the same cosines. They are one entry that carries its least `k + 1` ids, which is all that an answer
  can need, so a vector that a third of the rows repeat costs one comparison, and scaled copies tie exactly.
* Cells fill blocks of entries, a large cell several; a query goes only to the blocks that it visits, and a block that many
  queries visit is searched in several tasks.

`recall` measures the share of true neighbours found.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part, nor do rows
without id; of rows that repeat an id the one with the least vector counts; with fewer candidates than k all are returned; equal cosines are
ordered by id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_to_groups, materialize

FIT_ROWS = 16_384
MIN_CENTROIDS, MAX_CENTROIDS = 16, 1024
TARGET_RECALL, TRIAL_QUERIES = 0.95, 200
ENTRY_BLOCK, QUERY_BLOCK = 4096, 1024
#: What the order of matrix products may add to a cosine.
ROUNDING = 1e-9


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = distances(points, centers).argmin(axis=1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, less the squared length of each point where only the order of centers counts."""
    return (centers * centers).sum(axis=1) - 2 * points @ centers.T + (points * points).sum(axis=1)[:, None]


def centroids_for(entries: int) -> int:
    """A power of two, so that a cell holds about three entries until MAX_CENTROIDS is reached."""
    return int(np.clip(2 ** round(np.log2(max(entries, 3) / 3) / 2), MIN_CENTROIDS, MAX_CENTROIDS))


class MultiIndex:
    """The two codebooks, how many entries each cell holds, and the blocks that they fill."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = sample.shape[1] // 2
        k = max(1, min(centroids, len(sample) // 4))
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k, seed=1)]
        self.k = k
        self.count(np.zeros(k * k, np.int64))

    def count(self, sizes: np.ndarray) -> None:
        """Cells in order fill blocks; a cell larger than a block is spread over as many as it needs."""
        self.sizes = sizes
        self.first = (np.cumsum(sizes) - sizes) // ENTRY_BLOCK
        self.spread = np.maximum(-(-sizes // ENTRY_BLOCK), 1)

    def halves(self, unit: np.ndarray) -> list[np.ndarray]:
        return [distances(unit[:, : self.half], self.books[0]), distances(unit[:, self.half :], self.books[1])]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray, wanted: int) -> list[int]:
        """Cells that hold entries, by summed distance, until they hold `wanted` of them (the multi-sequence algorithm)."""
        i_order, j_order = a.argsort().tolist(), b.argsort().tolist()
        a, b, k, sizes = np.sort(a).tolist(), np.sort(b).tolist(), self.k, self.sizes
        heap, out, seen, next_j = [(a[0] + b[0], 0, 0)], [], 0, [0] * self.k
        while heap and seen < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_order[i] * k + j_order[j]
            if n := int(sizes[cell]):
                out.append(cell)
                seen += n
            next_j[i] = j + 1
            # a pair follows once the pairs above and left of it are out
            if i + 1 < k and next_j[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < k and (i == 0 or next_j[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return out

    def needed(self, a: np.ndarray, b: np.ndarray, cell: int) -> int:
        """How many entries a walk has seen once it has seen `cell`."""
        far = a[:, None] + b
        return int(self.sizes[(far <= far.flat[cell]).ravel()].sum())


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit_of(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: the rows that take part. v is the vector divided by its largest magnitude, so its square can't overflow and all
    vectors of one direction are equal."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    one = rows.where(F.size("v") == (length["n"] if length else 0)).groupBy("id").agg(F.min("v").alias("v"))
    largest = F.array_max(F.transform("v", F.abs)).alias("largest")
    return one.select("id", "v", largest).select("id", F.transform("v", lambda x: x / F.col("largest") + 0.0).alias("v"))


def block_search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query (right) its k best entries (left) among those of the cells it visits."""
    out: dict[str, list] = {"query": [], "ids": [], "score": []}
    if len(left) and len(right):
        left = left.sort_values("cell", kind="stable")
        entries, queries = matrix(left["v"]), matrix(right["v"])
        ids, first = left["ids"].to_numpy(), np.array([x[0] for x in left["ids"]])
        score, n = _visited_scores(unit_of(queries), unit_of(entries), left["cell"].to_numpy(), right["cells"]), min(k, len(left))
        least = np.maximum(np.partition(score, -n, axis=1)[:, -n] - ROUNDING, -2)
        lengths = np.sqrt((entries * entries).sum(axis=1))
        for i, query in enumerate(right["query"]):
            at = np.flatnonzero(score[i] >= least[i])
            exact = (entries[at] * queries[i]).sum(axis=1) / lengths[at] / np.sqrt((queries[i] * queries[i]).sum())
            best = np.lexsort((first[at], -exact))[:n]
            out["query"] += [query] * len(best)
            out["ids"] += list(ids[at[best]])
            out["score"] += exact[best].tolist()
    return pd.DataFrame(out)


def _visited_scores(queries: np.ndarray, entries: np.ndarray, cell: np.ndarray, visits: pd.Series) -> np.ndarray:
    """Cosines of every query with the entries, sorted by cell, of the cells that it visits; -inf elsewhere."""
    cells, starts = np.unique(cell, return_index=True)
    ends = np.append(starts[1:], len(cell))
    visitors: list[list[int]] = [[] for _ in cells]
    for i, seen in enumerate(visits):
        for c in np.flatnonzero(np.isin(cells, np.frombuffer(seen, "<i4"), assume_unique=True)):
            visitors[c].append(i)
    score = np.full((len(queries), len(entries)), -np.inf)
    for at, a, b in zip(visitors, starts, ends, strict=True):
        if at:
            score[at, a:b] = queries[at] @ entries[a:b].T
    return score


def enough_candidates(celled: DataFrame, trial: pd.DataFrame, index: MultiIndex, k: int, target: float) -> int:
    """The candidates a query needs so that walks find the share `target` of the k nearest entries of the trial queries."""
    spark = celled.sparkSession
    queries = unit_of(matrix(trial["v"]))
    shared = spark.sparkContext.broadcast(queries)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                score = shared.value @ unit_of(matrix(f["v"])).T
                score[score > 1 - ROUNDING] = -2  # the query itself
                n = min(k, len(f))
                at = np.argpartition(-score, n - 1, axis=1)[:, :n]
                q = np.repeat(np.arange(len(score)), n)
                yield pd.DataFrame({"q": q, "score": score[q, at.ravel()], "cell": f["cell"].to_numpy()[at.ravel()]})

    near = celled.mapInPandas(best, "q long, score double, cell int").where("score > -2")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k)
    a, b = index.halves(queries)
    needed = [index.needed(a[r.q], b[r.q], r.cell) for r in top.collect()]  # at most k rows a trial query
    return int(np.quantile(needed, target, method="higher")) if needed else 0


def nearest(
    rows: DataFrame, is_query, k: int = 5, *, key: str = "vec_id", vector: str = "embedding", target_recall: float = TARGET_RECALL, candidates: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that meets the condition `is_query` on column id.

    candidates: how many entries a query compares at least; none: as many as target_recall needs.
    """
    spark = rows.sparkSession
    vectors = materialize(usable(rows, key, vector), "vectors")
    least = Window.partitionBy("v").orderBy("id")
    entries = vectors.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "entries")
    asked = vectors.where(is_query)
    distinct = asked.groupBy("v").agg(F.min("id").alias("query"))
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).select("v").toPandas()  # at most FIT_ROWS vectors
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = MultiIndex(unit_of(matrix(sample["v"])), centroids_for(entries.count()))
    del sample
    celled = _cells(entries, index)
    sizes = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most K * K rows
    counts = np.zeros(index.k**2, np.int64)
    counts[list(sizes)] = list(sizes.values())
    index.count(counts)
    if candidates is None:
        trial = distinct.orderBy(F.xxhash64("v"), "v").limit(TRIAL_QUERIES).toPandas()
        candidates = enough_candidates(celled, trial, index, k, target_recall) if len(trial) else 0
    found = _search(celled, distinct, index, max(candidates, 16 * (k + 1)), k + 1)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.select("query", F.explode("ids").alias("vec_id"), "score").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    answers = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))
    by_vector = distinct.join(answers, "query").select("v", "best")
    each = join_to_groups(asked, by_vector, "v").select("id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("best"))
    answer = each.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )
    answer = materialize(answer, "nearest")
    discard(vectors, entries, celled)
    return answer


def _cells(entries: DataFrame, index: MultiIndex) -> DataFrame:
    """entries with their cell."""
    shared = entries.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(cell=shared.value.cells(unit_of(matrix(f["v"]))).astype(np.int32))

    return materialize(entries.mapInPandas(run, "v array<double>, ids array<long>, cell int"), "cells")


def _search(celled: DataFrame, queries: DataFrame, index: MultiIndex, wanted: int, k: int) -> DataFrame:
    """query, ids, score: the k best entries of each block that a query visits."""
    shared = celled.sparkSession.sparkContext.broadcast(index)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for f in frames:
            if len(f):
                cell = f["cell"].to_numpy()
                yield f.assign(block=at.first[cell] + np.array([x[0] for x in f["ids"]]) % at.spread[cell])

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for f in frames:
            for query, v, a, b in zip(f["query"], f["v"], *at.halves(unit_of(matrix(f["v"]))), strict=True) if len(f) else ():
                cells = np.array(at.walk(a, b, wanted))
                times = at.spread[cells]
                block = np.repeat(at.first[cells], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                order = np.argsort(block, kind="stable")
                blocks, starts = np.unique(block[order], return_index=True)
                seen = [c.astype("<i4").tobytes() for c in np.split(np.repeat(cells, times)[order], starts[1:])]
                yield pd.DataFrame({"query": query, "v": [v] * len(blocks), "block": blocks, "cells": seen})

    placed = celled.mapInPandas(place, "v array<double>, ids array<long>, cell int, block long")
    walks = 4 * celled.sparkSession.sparkContext.defaultParallelism  # a few bytes of input each, but much work
    visits = materialize(queries.repartition(walks, "query").mapInPandas(visit, "query long, v array<double>, block long, cells binary"), "visits")
    demand = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    left = placed.join(demand, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = visits.join(demand, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    left, right = (d.toDF(*d.columns) for d in (left, right))  # both come from the demand: new column identities
    search = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return search.applyInPandas(lambda a, b: block_search(a, b, k), "query long, ids array<long>, score double")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours (query_id, vec_id) that were found."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, truth.count())

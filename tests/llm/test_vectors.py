import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm.vectors import MultiIndex, nearest, recall


ALL = 1 << 60


def truth(rows, queries, k):
    out = {}
    for q in queries:
        v = np.array(rows[q], float)
        scored = []
        for i, x in rows.items():
            if i != q:
                x = np.array(x, float)
                scored.append((-(v * x).sum() / np.sqrt((v * v).sum()) / np.sqrt((x * x).sum()), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_walk_takes_cells_by_summed_distance():
    rng = np.random.default_rng(3)
    index = MultiIndex(rng.normal(size=(200, 8)), 10)
    index.count(np.ones(100, np.int64))
    a, b = rng.random(10), rng.random(10)
    for wanted in (1, 7, 100):
        got = index.walk(a, b, wanted)
        sums = [a[c // 10] + b[c % 10] for c in got]
        assert len(set(got)) == wanted and np.allclose(sums, np.sort((a[:, None] + b).ravel())[:wanted])


def test_nearest_with_ties_hot_vectors_and_bad_rows(spark):
    rng = random.Random(0)
    rows = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(300)}
    for i in range(100, 220):  # a vector that many rows share, queries among them
        rows[i] = [1.0, 0.5, 0.0, 0.0, -1.0, 2.0]
    bad = [(1000, None), (1050, [0.0] * 6), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1150, [float("nan")] * 6), (1200, [float("inf")] * 6), (1250, [1.0]), (None, rows[3])]
    data = [*rows.items(), *bad, (7, rows[7]), (100, rows[100]), (8, [1e9] * 6)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = nearest(frame, F.col("id") % 50 == 0, 5, candidates=ALL).collect()
    want = truth(rows, [i for i in rows if i % 50 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=1e-12)
    few = nearest(frame.where("vec_id in (0, 50, 51)"), F.col("id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (50, 1), (50, 2)]
    assert nearest(frame.limit(0), F.col("id") % 50 == 0).collect() == []
    assert nearest(frame.where("vec_id = 1050"), F.col("id") % 50 == 0).collect() == []


@pytest.mark.parametrize("folder", ["sf0.1", "check_l"])
def test_recall_on_the_test_tables(spark, folder):
    """2,000 and 51,282 vectors with little structure."""
    path = f"/root/testdata/{folder}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    frame = spark.read.parquet(path)
    got = nearest(frame, F.col("id") % 50 == 0)
    exact = nearest(frame, F.col("id") % 50 == 0, candidates=ALL)
    share = recall(got, exact)
    print(f"recall on {folder}: {share:.3f}")
    assert share >= 0.9


def test_scaled_vectors_tie_and_large_ones_do_not_overflow(spark):
    base = [0.3, -1.1, 0.7, 2.0]
    rows = [(1000 - n, [x * n for x in base]) for n in range(1, 41)] + [(1, [x * 1e155 for x in base]), (2000, [2.0, 0.1, -0.2, 0.4]), (2050, base)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") >= 2000, 5).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (2000, 2050)}
    assert found == {2000: [1, 960, 961, 962, 963], 2050: [1, 960, 961, 962, 963]}
    assert all(abs(r.score - 1) < 1e-12 for r in got if r.query_id == 2050)


def test_orthogonal_vectors_all_tie(spark):
    rows = [(i, [float(j == i % 7) for j in range(8)]) for i in range(70)] + [(100, [0.0] * 7 + [1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 100, 5).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i + 1, i, 0.0) for i in range(5)]

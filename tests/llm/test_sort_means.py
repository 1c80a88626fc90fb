import hashlib

import numpy as np
import pytest

from lexweft.llm import sort_means as sm

SHAPE = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, k, rounds, dims, seed=3, scale=1024):
    """Whole numbers of Python, all distances of all centroids."""
    good = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(good, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), no) for no, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in good]
        for no in range(len(centroids)):
            mine = [v for (_, v), o in zip(good, of) if o == no]
            if mine:
                centroids[no] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in good), centroids


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, np.round(rng.normal(size=dims) / 3, 2).tolist()) for i in range(n)]
    rows += [(i + n, rows[i % 7][1]) for i in range(n // 2)]  # many equal ones
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1])]  # an id that comes again, none at all
    rows += [(9001, None), (9002, [0.1] * (dims - 1)), (9003, [float("nan")] + [0.0] * (dims - 1)), (9004, [None] * dims), (9005, [float("inf")] * dims), (9006, [])]
    return rows


@pytest.mark.parametrize("dims, k", [(4, 8), (2, 12), (64, 3)])
def test_equals_brute_force(spark, dims, k):
    rows = vectors(60, dims, dims)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SHAPE).repartition(3)
    assignment, centroids = sm.sort_means(df, k, 5, dims)
    want, final = brute(rows, k, 5, dims)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in assignment.collect()) == want
    assert centroids.tolist() == final


def test_scan_stops_only_strictly_beyond(spark):
    # Ties at exactly twice the distance, and centroids that are equal, go to the smaller number.
    centroids = np.array([[4, 0], [0, 0], [0, 0], [8, 0]], np.int64)
    x = np.array([[2, 0], [6, 0], [0, 0], [4, 0]], np.int64)
    for last in range(4):
        best, least = sm.nearest(x, np.full(4, last), centroids)
        assert best.tolist() == [0, 0, 1, 0] and least.tolist() == [4, 4, 0, 0]


def test_few_vectors_and_large_ones(spark, tmp_path):
    two = spark.createDataFrame([(1, [0.5, -0.5], "", 0), (2, [1.0, 1.0], "", 0)], SHAPE)
    assignment, centroids = sm.sort_means(two, 8, 2, 2)
    assert len(centroids) == 2 and {r.distance for r in assignment.collect()} == {0}
    assert sm.sort_means(two.limit(0), 8, 2, 2)[0].count() == 0
    two.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = sm.op12_sort_means(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="vector 7 has a component"):
        sm.sort_means(spark.createDataFrame([(7, [1e9, 0.0], "", 0)], SHAPE), 8, 2, 2)


def test_rounds_leave_no_tables_behind(spark, tmp_path):
    gone = []
    keep, sm.discard = sm.discard, lambda s, path: gone.append(path) or keep(s, path)
    try:
        sm.sort_means(spark.createDataFrame([(i, [float(i), 0.0], "", 0) for i in range(9)], SHAPE), 3, 4, 2)
    finally:
        sm.discard = keep
    assert len(gone) == len(set(gone)) == 5

import os

import numpy as np
import pytest

from lexweft.operators import retrieval
from lexweft.plans import queries


def test_blocks_give_what_one_search_gives(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 4 = 0")
    rows = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())
    assert rows(retrieval.top_k_blocks(asked, v, 3, most=7)) == rows(retrieval.top_k(asked, v, 3))
    assert len(rows(retrieval.top_k_blocks(asked, v, 3))) == 150


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_has_no_switch_by_size(spark, monkeypatch):
    want = queries.retrieve_topk(spark, "/root/testdata/sf0.001").count()
    whole = retrieval.top_k_blocks
    monkeypatch.setattr(retrieval, "top_k_blocks", lambda q, v, k: whole(q, v, k, most=2))
    assert queries.retrieve_topk(spark, "/root/testdata/sf0.001").count() == want > 0


def test_equal_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(900, None), (901, []), (902, [1.0]), (903, [1.0, None]), (904, [0.0, 0.0]), (None, [1.0, 2.0]), (905, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = retrieval.top_k(v.where("vec_id IN (0, 7, 905)"), v, 2)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [(0, 1, 1), (0, 2, 2), (7, 1, 0), (7, 2, 1), (905, 1, 0), (905, 2, 1)]


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = []
    whole = retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda q, *a: asked.append(q.count()) or whole(q, *a))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 5 * 16)
    assert retrieval.top_k_blocks(v, v, 1).count() == 20 and max(asked) <= 5 and sum(asked) == 20

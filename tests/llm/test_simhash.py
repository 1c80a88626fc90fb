import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexweft.llm import common
from lexweft.llm.simhash import _one_bit_stars, components, fingerprint, near_duplicates


def _slow(text):
    words = [w for w in text.encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64(g, seed=42).intdigest() >> k & 1 for g in grams) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(grams))


def test_fingerprint_is_brute_force():
    for t in ["", " \n", "a", "a b", "A b C", "É é e", "a b c d a b c d", "x " * 500, "The quick\tbrown\nfox jumps over"]:
        assert fingerprint(t.encode()) == _slow(t)


def _classes(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def _fingerprints():
    rnd = random.Random(3)
    out = [0, 0, 3, (1 << 64) - 1, (1 << 63), 7]
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):  # chains, stars and copies
            out.append(base)
            for _ in range(rnd.randint(0, 3)):
                base ^= 1 << rnd.randrange(64)
    dense = rnd.getrandbits(64)
    for _ in range(200):
        out.append(dense ^ (1 << rnd.randrange(8)) ^ (1 << rnd.randrange(8)) ^ (1 << rnd.randrange(60)))
    return out


def test_components_are_brute_force(spark):
    fps = _fingerprints()
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    want = _classes(fps)
    for limit in (64, 3, 1000):  # few cells, most cells and no cells take the way of hot ones
        got = {r.fp: r.component_id for r in components(df, limit).collect()}
        assert [got[int(np.uint64(f).astype(np.int64))] for f in fps] == want


def test_stars_stay_small(spark):
    df = spark.range(2000).selectExpr("id AS fp")
    assert _one_bit_stars(df).count() < 2000 * 65


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " "), (9, "same text here again"), (9, "same text here again"), (None, "same text here again"), (4, "Same Text here AGAIN")]
    df = spark.createDataFrame([(a, b, 0, 1, 2, 3) for a, b in rows], "doc_id long, text string, fp int, th int, n int, k_id int")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (9, 4), (9, 4)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_hot_keys_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, k, i) for i, k in enumerate([7] * 50 + [8] * 3 + [9] * 2 + [5, None])], "i long, k long, n int")
    values = spark.createDataFrame([(7, "a", 50), (8, "b", 3), (9, "c", 2), (6, "d", 1)], "k long, v string, n long")
    got = common.join_by_key(rows, values, "k", 57).collect()
    assert sorted((r.i, r.v) for r in got) == [(i, "a") for i in range(50)] + [(i, "b") for i in range(50, 53)] + [(53, "c"), (54, "c")]


def test_a_prefix_scan_of_many_elements(spark):
    df = spark.sql("SELECT sequence(1, 1000) AS xs, cast(array() AS array<int>) AS none, array(5) AS one")
    r = df.select(*(common.scanned(F.col(c), F.lit(0), lambda a, b: a + b, 16).alias(c) for c in df.columns)).first()
    assert r.xs == [k * (k + 1) // 2 for k in range(1000)] and r.none == [] and r.one == [0]

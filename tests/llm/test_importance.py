from collections import Counter

import numpy as np
import pytest

from lexweft.llm.importance import AT_ONCE, BUCKET_BITS, MOST_GRAMS, OVERLAP, features, kth_largest, log_ratios, resample


def test_features_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    parts = [b"the ", b"THE ", b"a1 ", b"%%% ", b"\n", "été ".encode(), b"the the "]
    texts = [b"", b" ", b"word"] + [b"".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(1, 60, 40)]
    texts.append(b"many words of text " * (2 * AT_ONCE // 19))
    texts.append(b"x" * (AT_ONCE + 5))
    of, bucket = map(np.concatenate, zip(*features(texts)))
    assert bucket.min() >= 0 and bucket.max() < 1 << BUCKET_BITS
    for i, t in enumerate(texts):
        alone = np.concatenate([b for _, b in features([t])] or [np.zeros(0, int)])
        assert np.array_equal(np.sort(alone), np.sort(bucket[of == i]))
        n = len(t.split())
        assert len(alone) == n + max(0, n - 1) + sum(max(0, n - k) for k in range(1, 9))


def test_kth_largest(spark):
    values = np.random.default_rng(1).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("-inf"),)], "sample_key double")
    ordered = np.sort(values)[::-1]
    for k in (1, 7, 1500, 3000):
        assert kth_largest(df, k, bins=20, few=50) == ordered[k - 1]
    assert kth_largest(df, 3001) is None and kth_largest(df, 0) is None and kth_largest(df.limit(0), 1) is None
    same = spark.createDataFrame([(1.5,)] * 100, "sample_key double")
    assert kth_largest(same, 50, few=10) == 1.5


def _docs():
    rng = np.random.default_rng(5)
    words = ["ali", "bero", "cado", "dune", "emi", "foro", "gati", "hula"]
    good = [" ".join(rng.choice(words, 60)).capitalize() + "." for _ in range(120)]
    bad = [" ".join(w + "%%%" for w in rng.choice(words, 60)) for _ in range(20)] + [" ".join(["dune"] * 60)] * 5
    return good, bad


def test_held_out_accuracy(spark):
    good, bad = _docs()
    rows = [(i, t, 9) for i, t in enumerate(good)] + [(1000 + i, t, 9) for i, t in enumerate(bad)]
    rows += [(2000, None, 9), (2001, "", 9), (None, good[0], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight int")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(10)] + [(5, None), (None, 1)], "doc_id long, quality int")
    kept = [r.doc_id for r in resample(docs, labels).collect()]
    assert set(kept) == set(range(120)) | {None} and len(kept) == 121
    assert len(resample(docs, labels, k=50).collect()) == 50
    again = sorted(r.sample_key for r in resample(docs.repartition(3), labels).collect())
    assert again == sorted(r.sample_key for r in resample(docs, labels).collect())
    assert resample(docs.limit(0), labels).count() == 0
    assert resample(docs, labels.limit(0)).count() == 146  # all weights are 1, blank texts go


def test_ratios():
    counts = np.array([[100, 100, 0], [90, 0, 0]])
    r = log_ratios(counts, 10)
    assert r[0] > 0 > r[1] and r[2] == pytest.approx(0)


def _grams(text):
    """All n-grams of a text as (table, key), in plain Python."""
    import re

    words = text.lower().split()
    data = text.lower().encode()
    shapes = [re.sub(r"(a|A|0)\1+", r"\1", re.sub("[a-z]|[^\x00-\x7f]", "a", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", w)))) for w in text.split()]
    out = [(0, "s", s) for s in shapes] + [(0, "ss", *p) for p in zip(shapes, shapes[1:])]
    for lag in range(1, 9):
        out += [(0, "r", lag, a == b) for a, b in zip(words, words[lag:])]
    out += [(1, "w", w) for w in words] + [(1, "ww", *p) for p in zip(words, words[1:])]
    return out + [(1, "c", data[i : i + 4]) for i in range(len(data) - 3)]


def test_weights_and_sample_are_brute_force(spark):
    """Against dictionaries of whole n-grams; hashing into buckets may move a weight a little."""
    rng = np.random.default_rng(8)
    words = ["ali", "bero", "Cado", "dune", "EMI", "f0r0", "g%%%", "hula", "iso7"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(80)]
    good = set(range(0, 40, 2))
    raw, target = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in enumerate(texts):
        for g in _grams(t):
            raw[g[0]][g] += 1
            target[g[0]][g] += i in good
    weights = []
    for t in texts:
        total = 0.0
        for g in _grams(t):
            k, prior = g[0], (50.0, 500.0)[g[0]]
            total += np.log((target[k][g] + prior) / (raw[k][g] * target[k].total() / raw[k].total() + prior))
        weights.append(total / OVERLAP * min(1, MOST_GRAMS / len(_grams(t))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    rows = {r.doc_id: r for r in resample(docs, labels, k=80).collect()}
    assert len(rows) == 80
    got = np.array([rows[i].log_weight for i in range(80)])
    assert np.abs(got - weights).max() < 0.25 * np.abs(weights).max()
    noise = np.array([rows[i].sample_key - rows[i].log_weight for i in range(80)])
    assert -2.5 < noise.min() and 0 < noise.mean() < 1.2 and noise.std() > 0.8  # Gumbel: mean 0.58, deviation 1.28
    for k in (1, 17, 50):
        best = {int(i) for i in np.argsort(-(got + noise))[:k]}
        assert {r.doc_id for r in resample(docs, labels, k=k).collect()} == best
    chance = 1 / (1 + np.exp(-(got + 6)))
    assert len(resample(docs, labels).collect()) == round(chance.sum())


def test_held_out_labels(spark):
    """Fitted on every other label of the test tables, judged on the rest."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    kept = {r.doc_id for r in resample(docs, half, carry=["doc_id"]).collect()}
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()
    clean = [r.doc_id in kept for r in rest if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id in kept for r in rest if r.quality == 0]
    toxic = [r.doc_id in kept for r in rest if r.toxic == 1]
    print(f"held out: clean kept {sum(clean)} of {len(clean)}, bad kept {sum(bad)} of {len(bad)}, toxic kept {sum(toxic)} of {len(toxic)}")
    assert sum(clean) >= 0.99 * len(clean) and sum(bad) <= 0.02 * len(bad) and sum(toxic) <= 0.7 * len(toxic)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "ali bero", 5, 6, 7, 8)], "doc_id long, text string, good int, good_id int, row int, sample_key int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = resample(docs, labels)
    assert sorted(out.columns) == sorted([*docs.columns, "log_weight"]) and out.first()["row"] == 7 and isinstance(out.first().sample_key, float)

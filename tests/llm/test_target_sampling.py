import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexweft.llm.target_sampling import sampled

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHAPE = "doc_id long, text string, rank string, row int, buckets int, score int"


def grams(text, max_n):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(low)
    return [b" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, max_n, buckets, percent, min_words, seed=2024):
    hashed = lambda t: Counter(zlib.crc32(g) % buckets for g in grams(t, max_n)[0])
    docs, aim = [hashed(t) for _, t in rows], Counter()
    for t in target:
        aim.update(hashed(t))
    raw = sum(docs, Counter())
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)}
    out = []
    for (i, text), own in zip(rows, docs):
        n = sum(own.values())
        weight = sum(gain[b] * c for b, c in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, weight, score, grams(text, max_n)[1] >= min_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(id(r), k + 1) for k, r in enumerate(fit[: percent * len(fit) // 100])]
    place = dict(ranks)
    return sorted(([*r[:4], place.get(id(r))] for r in out), key=repr)


def corpus():
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "GAMMA", "ß", "日本", "a_b", "it's"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n--!"), (203, "\x00nul\x00 in\x7fit " * 9), (204, "word " * 70_000), (205, "w" * 300_000)]
    rows += [(300, rows[3][1]), (301, rows[3][1])]  # copies
    return rows, [rows[5][1], rows[6][1], None, "alpha ALPHA " * 30]


@pytest.mark.parametrize("max_n, buckets, percent, min_words", [(1, 10_000, 10, 20), (3, 50, 60, 5)])
def test_equals_brute_force(spark, max_n, buckets, percent, min_words):
    rows, target = corpus()
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 3) for i, t in rows], SHAPE).repartition(5)
    out = sampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n, buckets, percent, min_words)
    assert out.columns == ["doc_id", "row", "buckets", "n_features", "weight", "score", "rank"]
    got = out.collect()
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in got), key=repr) == brute(rows, target, max_n, buckets, percent, min_words)
    assert {(r["row"], r["buckets"]) for r in got} == {(1, 2)}


@pytest.mark.parametrize("max_n, long_chars, ids", [(3, 40, (0, 30)), (1, 40, (0, 20)), (2, 90_000, (200, 302))])
def test_long_texts_in_parts(spark, max_n, long_chars, ids):
    rows, target = corpus()
    rows = [r for r in rows if ids[0] <= r[0] < ids[1]]
    aim = spark.createDataFrame([(t,) for t in target], "text string").coalesce(1)
    out = sampled(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), aim, max_n, 50, 60, 5, long_chars=long_chars)
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in out.collect()), key=repr) == brute(rows, target, max_n, 50, 60, 5)


def test_ties_nulls_and_empty_tables(spark):
    text = "one two three " * 10
    rows = [(7, text)] * 20 + [(None, text)] * 2 + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("two",)], "text string")
    got = sampled(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12))  # each rank once, though scores are equal
    assert sampled(docs.limit(0), target).count() == 0
    alone = sampled(docs, target.limit(0)).collect()
    assert len(alone) == 23 and len({r.weight for r in alone if r.n_features}) == 1
    assert {r.weight for r in sampled(docs.where("doc_id = 8"), target).collect()} == {0}


def test_ranks_hold_whatever_the_partitions(spark):
    rows, target = corpus()
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, sampled(docs.repartition(n), aim, percent=30).collect()), key=repr) for n in (1, 9))
    assert one == many

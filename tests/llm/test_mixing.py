from collections import Counter, defaultdict

import numpy as np
import pytest

from lexweft.llm import mixing
from lexweft.llm.mixing import Mix, draw_shards, mix_plan, permuted, shard_counts, shares


def targets(sizes, weights, most=3):
    """Shares by weight in exact fractions, none above ``most`` times its size."""
    from fractions import Fraction

    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in free)
        rest = total - sum(most * sizes[i] for i in capped)
        goal = {i: Fraction(rest * weights[i], weight) for i in free}
        over = {i for i in free if goal[i] > most * sizes[i]}
        if not over:
            return [float(goal.get(i, most * sizes[i])) for i in range(len(sizes))]
        capped |= over


def _sizes(spark, rows):
    return spark.createDataFrame([(s, n, 1) for s, n in rows], "source string, n long, docs long")


def test_targets_share_the_excess(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), ("d", 0), (None, 500), ("é", 70), ("Z", 3)]
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    got = {r.source: (r.no, r.target) for r in shares(_sizes(spark, sizes)).collect()}
    goal = targets([n for _, n in order], [1, 2, 3, 1, 2, 3, 1])
    assert [got[s] for s, _ in order] == [(i, pytest.approx(g, rel=1e-12)) for i, g in enumerate(goal)]
    assert [r.target for r in shares(_sizes(spark, [("a", 0), ("b", 0)])).collect()] == [0, 0]
    assert shares(_sizes(spark, [])).count() == 0


def test_permutation():
    for n in (1, 2, 3, 64, 1000):
        p = permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


@pytest.mark.parametrize("n,shards", [(0, 3), (7, 1), (5, 400), (100_000, 400), (40, 3)])
def test_draws_are_whole(monkeypatch, n, shards):
    monkeypatch.setattr(mixing, "AT_ONCE", 64)
    parts = list(shard_counts(n, shards, 3, 9))
    shard, first, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
    assert count.sum() == n and (np.diff(shard) > 0).all() and (first == np.cumsum(count) - count).all()
    if n == 100_000:
        assert len(shard) == shards and abs(count.std() - np.sqrt(n / shards)) < 3


def _docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(int(n))), "hot" if i % 2 else f"s{i % 4}") for i, n in enumerate(rng.integers(0, 300, 300))]
    rows += [(900, None, "hot"), (901, " \n", "s0"), (902, "x " * 4000, None), (903, "same text", "tiny"), (903, "same text", "tiny"), (None, "a b c", "hot")]
    return rows, spark.createDataFrame([(*r, 5, "p", 7) for r in rows], "doc_id long, text string, source string, size int, parts string, _hash int")


@pytest.mark.parametrize("small", [mixing.SMALL_PLAN, 0])
def test_mix(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_PLAN", small)
    rows, docs = _docs(spark)
    mix = Mix(docs, block_words=16, slots_per_shard=100)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    by = {s: 0 for s in size}
    of = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[of[r.doc_id]]
        by[of[r.doc_id]] += r.taken
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([size[s] for s in order], [1, 2, 3] * 3)))
    for s in by:
        assert abs(by[s] - goal[s]) <= max(17, 0.02 * goal[s])
    again = Mix(docs.repartition(5), block_words=16, slots_per_shard=100).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    texts = mix.texts()
    assert texts.columns == docs.columns
    taken, words = Counter(), Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    for r in texts.collect():
        words[r.doc_id] += len(r.text.split())
        assert (r.size, r.parts, r._hash) == (5, "p", 7)
    assert words == +taken


def test_shards_are_brute_force(spark):
    """Every slot holds the block that its number in its source and the permutation name, and documents' texts follow the shards."""
    rows, docs = _docs(spark)
    mix = Mix(docs, block_words=16, slots_per_shard=100)
    plan = {r.no: r for r in mix.plan.collect()}
    out = mix.output().collect()
    assert len(out) == sum(p.slots for p in plan.values()) and {r.shard for r in out} <= set(range(mix.shards)) and mix.shards > 3
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) < 2 * min(map(len, by_shard.values()))
    placed = sorted(mix.placed.collect(), key=lambda r: (r.source_no, r.start, -r.size))
    text = {r[0]: r[1] for r in rows}
    stream = defaultdict(list)
    for r in placed:
        assert r.start == len(stream[r.source_no]) or not r.size
        stream[r.source_no] += (text[r.doc_id] or "").split()
    drawn = {(r.shard, r.source_no): r for r in draw_shards(mix.plan, mix.shards, mix.seed).collect()}
    want = Counter()
    for (shard, no), d in drawn.items():
        n = plan[no].blocks
        for i in range(d.first, d.first + d["count"]):
            key = np.array([(mix.seed << 40) + (no << 8) + i // n], np.uint64)
            block = int(permuted(np.array([i % n]), np.array([n]), key)[0])
            want[shard, no, i // n, block, " ".join(stream[no][16 * block : 16 * block + 16])] += 1
    assert Counter((r.shard, r.source_no, r.round, r.block, r.text) for r in out) == want
    order = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.shard, r.slot)):
        for w in r.text.split():
            if w.startswith("w"):
                order[int(w[1:].split("_")[0])].append(w)
    assert order == {r.doc_id: r.text.split() for r in mix.texts().where("text LIKE 'w%'").collect()}


def test_empty(spark):
    _, docs = _docs(spark)
    for df in (Mix(docs.limit(0)).taken(), Mix(docs.limit(0)).texts(), Mix(docs.limit(0)).output()):
        assert df.count() == 0
    assert mix_plan(_sizes(spark, [("a", 100)]), 64).first().slots == 2

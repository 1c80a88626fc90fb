import random

import numpy as np

from lexweft.llm import minhash, simhash


def _grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _texts():
    rnd = random.Random(5)
    out = []
    for length in (60, 150, 400):
        for _ in range(6):
            words = [f"w{rnd.randrange(5000)}" for _ in range(length)]
            out.append(" ".join(words))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # similarities from 1 down to about 0.6
                out.append(" ".join(f"x{rnd.randrange(5000)}" if rnd.random() < share else w for w in words))
    words = [f"h{i}" for i in range(200)]
    for i in range(150):  # one large group, each with a word of its own changed
        out.append(" ".join([*words[:i], f"own{i}", *words[i + 1 :]]))
    return [*out, "a b", "A  b", "a b c", "", " \n"]


def test_groups_are_brute_force(spark):
    texts = _texts()
    grams = [_grams(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(grams[i], grams[j]) >= 0.8 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == group
    kept = sorted(r.doc_id for r in minhash.dedup_stage(spark, df, "").collect())
    assert kept == sorted(set(group))


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (9, "same text here again"), (9, "same text here again"), (None, "same text here again"), (4, "Same Text here AGAIN")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, fp int")
    assert sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()) == [(1, ""), (4, "Same Text here AGAIN")]
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_bands_follow_similarity(spark):
    rng = np.random.default_rng(1)
    met, apart, sketches = {}, {160: [], 60: []}, []
    for share in (160, 60):  # similarities 0.8 and 0.3
        own = (200 - share) // 2
        met[share] = 0
        for _ in range(400):
            both, a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in (share, own, own))
            x, y = (minhash.minima(np.concatenate([both, z])) for z in (a, b))
            met[share] += bool((minhash.bands(x) == minhash.bands(y)).any())
            apart[share].append(int(((x[:64] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)) != (y[:64] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60))).sum()))
            sketches.append([minhash.sketch(z).tolist() for z in (x, y)])
    assert met[160] >= 396 and met[60] <= 8
    assert max(apart[160]) <= minhash.MOST_APART < min(sorted(apart[60])[20:])
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sketches)], "i int, a array<long>, b array<long>")
    got = [r.d for r in df.select("i", minhash._apart("a", "b").alias("d")).orderBy("i").collect()]
    assert got == apart[160] + apart[60]


def test_odd_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n, own in ((1, 0), (50, 5), (300, 40), (300, 160), (2000, 700)):
        both, a, b = (rng.integers(0, 1 << 64, k, np.uint64) for k in (n, own, own))
        x, y = (minhash.odd_sketch(np.unique(np.concatenate([both, z]))) for z in (a, b))
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert differ <= 2 * own
        if n == 300:  # similarities 0.79 and 0.48
            assert differ > (2 * (n + own)) / 9 if own == 160 else differ >= 0.9 * 2 * own
    assert len(minhash.odd_sketch(np.zeros(1, np.uint64))) == minhash.ODD // 64


def test_a_large_group_that_hardly_links(spark):
    """Copies of one text that are alike to it at most, not to each other: pairs of groups are sorted out before they are rows."""
    rnd = random.Random(8)
    words = [f"b{i}" for i in range(240)]
    texts = []
    for i in range(120):  # about 0.68 alike to each other
        at = set(rnd.sample(range(240), 5))
        texts.append(" ".join(f"c{i}x{k}" if k in at else w for k, w in enumerate(words)))
    texts += [t + " more" for t in texts[:4]]
    grams = [_grams(t) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if _jaccard(grams[i], grams[j]) >= 0.8]
    group = list(range(len(texts)))
    for i, j in alike:
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == group and len(set(group)) > 20


def test_fingerprints_on_the_grid_name_the_first_candidates(spark, monkeypatch):
    """The stage's first groups are those of close fingerprints whose sets are alike, before any band is compared."""
    rnd = random.Random(11)
    texts = []
    for _ in range(8):
        words = [f"w{rnd.randrange(9000)}" for _ in range(700)]
        texts += [" ".join(words), " ".join([*words, "end"]), " ".join([*words[:-3], "other", *words[-2:]])]
    texts += ["a b", "a b c"]
    grams = [_grams(t) for t in texts]
    sets = [minhash.shingle_set(t.encode()) for t in texts]
    prints = [simhash.majority([x]) for x in sets]
    keys = [minhash._set_key(x) for x in sets]
    near = {frozenset((keys[i], keys[j])) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    alike = {frozenset((keys[i], keys[j])) for i in range(len(texts)) for j in range(i) if _jaccard(grams[i], grams[j]) >= 0.8}
    steps, write, grid = [], minhash.materialize, simhash.links

    def written(df, label):
        out = write(df, label)
        steps.append((label, [tuple(r) for r in out.collect()] if label in ("close", "alike-simhash") else None))
        return out

    joined = []
    monkeypatch.setattr(minhash, "materialize", written)
    monkeypatch.setattr(simhash, "links", lambda *a: joined.append(1) or grid(*a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in minhash.dedup_stage(spark, df, "").collect())
    assert kept == [*range(0, 24, 3), 24, 25] and joined
    seen = dict(steps)
    labels = [label for label, _ in steps]
    assert labels.index("alike-simhash") < labels.index("members")
    assert "alike-0" not in labels or labels.index("alike-simhash") < labels.index("alike-0")
    close, found = ({frozenset(p) for p in seen[x]} for x in ("close", "alike-simhash"))
    assert close <= near and found == close & alike and found
    # All that are close are connected by the pairs that are listed, of sizes that may be alike.
    group = {k: k for k in keys}
    for a, b in map(tuple, close):
        x, y = group[a], group[b]
        group = {k: x if g == y else g for k, g in group.items()}
    assert all(group[a] == group[b] for a, b in map(tuple, near & alike))

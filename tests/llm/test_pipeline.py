import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweft.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents").cache()
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name != "tokens":
            assert docs.dtypes == seen["documents"].dtypes
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    for a, b in zip(list(ids), list(ids)[1:]):
        assert set(ids[b]) <= set(ids[a]) and len(set(ids[b])) == len(ids[b])
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, SF, "labels").collect()}
    good = [i for i in ids["documents"] if labels.get(i) == (1, 0)]
    bad = [i for i in ids["documents"] if labels.get(i, (1, 0))[0] == 0]
    assert len(set(good) & set(ids["quality"])) >= 0.97 * len(good)
    assert len(set(bad) & set(ids["quality"])) <= 0.1 * len(bad)
    texts = {r.doc_id: r.text for r in seen["documents"].collect()}
    copies = {texts[i] for i in ids["quality"]}
    assert len({texts[i] for i in ids["dedup"]}) == len(ids["dedup"]) <= len(copies)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    leaks = [i for i in ids["dedup"] if any(t in texts[i] for t in items)]
    assert leaks and not set(leaks) & set(ids["decontaminate"])
    rows = sorted(seen["tokens"].collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert ids["tokens"] == ids["mix"]
    words = {r.doc_id: r.text for r in seen["mix"].collect()}
    assert all(set(words[i].split()) <= set(texts[i].split()) for i in words)


def test_odd_rows_and_clashing_names(spark):
    real = table(spark, SF, "documents")
    extra = {n: F.lit(i) for i, n in enumerate(["good", "k_id", "th", "parts", "row", "own_id", "log_weight", "hash", "size", "node"])}
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", "s", 0), (5001, None, "en", "s", 0), (5001, " \n", None, None, 2), (5002, "x " * 60_000, "en", "s", 120_000)] * 2, real.schema
    )
    docs = real.unionByName(real.limit(20)).unionByName(odd).withColumns(extra).cache()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs, before = stage(spark, docs, SF).cache(), docs
        if name != "tokens":
            assert docs.columns == before.columns
            assert [tuple(r[n] for n in extra) for r in docs.distinct().collect()] == [tuple(range(len(extra)))] * docs.distinct().count()
        if name in ("dedup", "decontaminate", "mix"):
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert docs.count() > 50

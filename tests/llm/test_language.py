import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweft.llm import language as lg

SF = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, lang_pred int, row int"


def learned(spark):
    rng = np.random.default_rng(4)
    own = {"xa": ["the", "and", "thing", "other", "fish"], "xb": ["der", "und", "ding", "ßchen", "Fisch"], "xc": ["que", "ños", "cosa", "otra", "pez"]}
    rows = [(i, " ".join(rng.choice(own[lang], 30)), lang, 1, 2) for i, lang in enumerate(["xa", "xb", "xc", "xa"] * 20)]
    rows += [(500, "junk", None, 1, 2), (501, None, "xa", 1, 2), (None, "the fish", "xa", 1, 2)]
    return spark.createDataFrame(rows, SHAPE)


def said(spark, model, texts):
    out = lg.identify(spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id int, text string, score int, row int"), model)
    assert out.columns == ["doc_id", "text", "row", "lang_pred", "score"]
    return [(r.lang_pred, r.score) for r in out.orderBy("doc_id").collect()]


def test_words_then_n_grams(spark):
    model = lg.fit(learned(spark))
    assert model.langs == ["xa", "xb", "xc"]
    texts = ["The AND", "und", "que", "thinging", "fischdings", "cosita", None, "", " 123 --", "́", "日本語", "ÑOS", "the " * 40_000 + "und", "x" * 50_000]
    got = said(spark, model, texts)
    assert [g[0] for g in got] == ["xa", "xb", "xc", "xa", "xb", "xc", "und", "und", "und", "und", "xa", "xc", "xa", "xa"]
    assert [g[1] for g in got[6:10]] == [0.0] * 4 and all(0 < g[1] <= 1 for g in got[:6])
    assert abs(got[10][1] - 42 / 82) < 1e-9  # nothing is known: the share of the largest language
    assert said(spark, model, texts) == said(spark, model, texts)


def brute_word(word, words, grams, totals, langs):
    """One word's scores by dictionaries of counts."""
    types = len({w for _, w in words})
    if any((x, word) in words for x in langs):
        return [np.log((words.get((x, word), 0) + 0.5) / (totals[x] + 0.5 * types)) for x in langs]
    padded = f" {word} "
    for n in range(5, 0, -1):
        own = [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]
        known = [g for g in own if any((x, g) in grams for x in langs)]
        if known:
            of = {g for _, g in grams if len(g) == n}
            total = {x: sum(c for (y, g), c in grams.items() if y == x and len(g) == n) for x in langs}
            return [sum(np.log((grams.get((x, g), 0) + 0.5) / (total[x] + 0.5 * len(of))) for g in known) / n for x in langs]
    return [0.0] * len(langs)


def test_equals_brute_force(spark):
    df = learned(spark)
    model = lg.fit(df)
    words, grams = {}, {}
    for r in df.where("lang IS NOT NULL AND text IS NOT NULL").collect():
        for w in r.text.lower().split():
            words[r.lang, w] = words.get((r.lang, w), 0) + 1
            p = f" {w} "
            for n in range(1, 6):
                for g in (p[i : i + n] for i in range(len(p) - n + 1)):
                    if g != " ":
                        grams[r.lang, g] = grams.get((r.lang, g), 0) + 1
    totals = {x: sum(c for (y, _), c in words.items() if y == x) for x in model.langs}
    asked = ["the", "und", "thin", "thy", "fische", "oz", "ñ", "日本", "cosaotra", "hex"]
    got = lg.word_scores(pa.array(asked, pa.large_string()), model)
    want = np.array([brute_word(w, words, grams, totals, model.langs) for w in asked])
    assert np.allclose(got, want, atol=1e-9, rtol=0)


def test_bounded_model_and_nothing_learned(spark):
    df = learned(spark)
    small = lg.fit(df, most=12)
    assert len(small.words) <= 12 and len(small.grams) <= 12
    assert {lg.most_frequent(spark.createDataFrame([(n,) for n in (1, 1, 2, 9, 9, 9)], "n long"), k).count() for k in (0, 2)} == {0}
    assert lg.most_frequent(spark.createDataFrame([(n,) for n in (1, 1, 2, 9, 9, 9)], "n long"), 5).count() == 4
    none = lg.fit(df.where("lang IS NULL"))
    assert said(spark, none, ["the", None]) == [("und", 0.0)] * 2
    assert lg.identify(df.limit(0), small).count() == 0 and none.langs == []


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").select("doc_id", lg.held_out(F.col("doc_id")).alias("h"))
    for r in df.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    found = lg.op11_language(spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)

import numpy as np

from lexweft.llm.importance import AT_ONCE, content_features, fit, with_weights


def _texts(rng, words, n):
    return [" ".join(rng.choice(words, 60)) for _ in range(n)]


def _weights(spark, toxic):
    """Mean log weights of plain and of odd texts, whose words have equal shapes, and of texts with other words."""
    rng = np.random.default_rng(3)
    plain, odd = ["alia", "bero", "cado", "dune", "emil", "foro"], ["rixa", "sumo", "tavi", "ulno", "vexi", "wado"]
    texts = _texts(rng, plain, 150) + _texts(rng, odd, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(75)] + [(i, 1, toxic) for i in range(150, 225)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.log_weight for r in with_weights(docs, fit(docs, labels)).collect()}
    return np.mean([rows[i] for i in range(75, 150)]), np.mean([rows[i] for i in range(225, 300)])


def test_words_decide_and_toxic_text_is_no_target(spark):
    plain, odd = _weights(spark, toxic=1)
    assert plain > 1 and odd < -10  # labelled texts of either kind are held out
    plain, odd = _weights(spark, toxic=0)
    assert abs(plain - odd) < 1


def test_content_does_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    texts = [b"", b" ", b"abc", "Été ".encode()] + [bytes(rng.integers(97, 105, n, np.uint8)) for n in (5, 50, AT_ONCE, AT_ONCE + 3, 2 * AT_ONCE + 9)]
    texts += [b"some words of text " * 40, b"A word a WORD"]
    of, bucket = map(np.concatenate, zip(*content_features(texts)))
    for i, t in enumerate(texts):
        alone = np.concatenate([b for _, b in content_features([t])] or [np.zeros(0, int)])
        assert np.array_equal(np.sort(alone), np.sort(bucket[of == i]))
        n = len(t.split())
        assert len(alone) == n + max(0, n - 1) + max(0, len(t) - 3)

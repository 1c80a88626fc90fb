import pytest

from lexweft.llm.token_counts import count_tokens, op1_token_counts

P = pytest.importorskip("public_tokenizers")


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [None, "", "a b", "a b", "It's <|endoftext|> été 12", "the word " * 9000, "x" * 40000, "́" * 100]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(whole.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))
    assert count_tokens(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
    null = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(null, P.path("word_bpe_49k.json")).collect()] == [1, 1]


def test_whole_rows_of_the_query(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [None, "", "word " * 2047, "word " * 2048, "word " * 2049, "Été, " * 9000, "a<|endoftext|>b" * 3000, "x" * 30_000, "字" * 9000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in enumerate(texts):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert sorted(map(tuple, op1_token_counts(spark, str(tmp_path)).collect())) == want

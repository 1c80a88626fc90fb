import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexweft.llm.pieces import PieceEncoder, PieceTable, byte_slices, piece_hashes
from lexweft.llm.rans import Segment, encode_segment
from lexweft.llm.token_counts import resynchronised_ids
from lexweft.llm.token_files import token_rows

P = pytest.importorskip("public_tokenizers")
ODD = [
    "", "a", " a", "a ", "  a  b ", "a\n\nb", "a\nb c", "a \n b", "\ta b", "x<|endoftext|> y <|endoftext|>", "a \t \tb",
    "l'été n'est it's 123 12,5 !!! #$%", "ñandú́ é ́x", "KK ſ", "a\xa0b \xa0 c", "字字字 字", "x\n\n\ny\r\nz",
    "The end.\nThe start of\nit\n", "\x1c \x1d a\x85b", "DON'T 'S", "<|startoftext|>a b<|startoftext|>", "😀😀 a😀",
]


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(name, leading):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(name))
    coder = PieceEncoder(P.path(name), leading, slots=64)
    rng = np.random.default_rng(1)
    parts = [*"abé. \n\t\xa0", " ", "  ", "the", "\n", "<|endoftext|>", "'s", "12", "́", "\r\n", "!!"]
    texts = ODD + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(1500)]
    for some in (texts, texts[::-1]):
        ids, n = coder.encode(pa.array(some))
        ends = np.cumsum(n)
        assert len(ids) == ends[-1] and coder.counts(pa.array(some)).tolist() == n.tolist()
        for t, a, z in zip(some, ends - n, ends):
            assert ids[a:z].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_is_a_map():
    rng = np.random.default_rng(3)
    table, known = PieceTable(256), {}
    for _ in range(40):
        words = list({"".join(rng.choice(list("abé"), rng.integers(0, 7))) for _ in range(20)} | {"x" * 80})
        h1, h2, short = piece_hashes(pa.array(words))
        assert short.tolist() == [len(w.encode()) <= 64 for w in words]
        entry = table.find(h1, h2) * short
        for w, e in zip(words, entry.tolist()):
            assert (w in known) == (e > 0)
            assert not e or table.pool[table.start[e] :][: table.size[e]].tolist() == known[w]
        new = [i for i, e in enumerate(entry) if not e and short[i]]
        ids = [list(words[i].encode()) for i in new]
        room = table.most - table.n
        table.add(h1[new], h2[new], [np.array(x, np.uint16).tobytes() for x in ids])
        known |= {words[i]: x for i, x in list(zip(new, ids))[:room]}
    assert table.n == table.most == len(known)
    table.clear()
    assert not table.find(*piece_hashes(pa.array(["a", "b"]))[:2]).any()


def test_rows_are_sliced_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, "", None, "b" * 50, "c", "d" * 9, "e"])], names=["text"])
    got = [s.column(0).to_pylist() for s in byte_slices(batch.slice(1), 0, 10)]
    assert got == [["", None], ["b" * 50], ["c", "d" * 9], ["e"]]
    assert not list(byte_slices(batch.slice(0, 0), 0))


def test_chunks_resynchronise():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    parts = ["the", " ", " ", "été", "é", "<|endoftext|>", "12", ".", "'s", "\n", "字", "Σς", "!!", "x" * 40]
    texts = ["".join(rng.choice(parts, 900)) for _ in range(30)]
    texts += ["a" * 3000, "́" * 2000, " " * 2000, "字" * 1500, "<|endoftext|>" * 200, "ab " * 1500, ""]
    for t in texts:
        for chunk, overlap in ((400, 80), (200, 150), (5000, 100)):
            assert resynchronised_ids(whole, t, chunk, overlap).tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 65536, 65537, 150_000])
def test_segments_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50256).astype(np.uint16)
    data = encode_segment(ids, [7, None], np.array([n, 0]))
    seg = Segment(data)
    assert (seg.ids() == ids).all() and seg.doc_ids == [7, None] and seg.lengths.tolist() == [n, 0]
    if n > 70_000:
        assert (seg.ids(1, 2) == ids[65536:131072]).all()
        broken = bytearray(data)
        broken[-5] ^= 1
        with pytest.raises(ValueError):
            Segment(bytes(broken)).ids()


def test_all_symbols_round_trip():
    ids = np.random.default_rng(0).permutation(1 << 16).astype(np.uint16)
    assert (Segment(encode_segment(ids, [1], np.array([1 << 16]))).ids() == ids).all()


def _expected(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, {}
    for doc_id, text in sorted(rows):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_files(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (-5, "word " * 5000), (50, ODD[10])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, part int")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_rows(df.repartition(3), P.path("byte_bpe_50k.json")).collect()}
    assert got == _expected([(i, t or "") for i, t in rows])
    assert token_rows(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, "d")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_rows(df, P.path("byte_bpe_50k.json")).collect())
    assert [g[1] for g in got] == [None, 1, 1, 1]
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()

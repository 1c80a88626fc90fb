import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from lexweft.functions import exact, text, unicode

ODD = [
    "", " ", "a", "\x1c\x1d x \x85\xa0 y　", "a\r\nb\rc", "a  \t\n\n\n\n\nb", "```x\ny``` [a](b) ![c](d) 123-2020 **z** `q", "Pensión", "ÑANDÚ ß",
    "Ã±andÃº", "â€œhiâ€\x9d", "château", "x\x00\x0b\x0c\x7fy", "é", "ﬁ ² ø", "word. " * 60, "w" * 300, "Art. 5 " + "x" * 300, "a  b",
]


def _rows(spark, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    return {r.i: r for r in df.select("i", *columns).collect()}


def test_white_space_is_pythons(spark):
    got = _rows(spark, text.ws_strip(F.col("t")).alias("s"), text.ws_collapse(F.col("t")).alias("c"), text.is_blank(F.col("t")).alias("b"))
    for i, t in enumerate(ODD):
        assert (got[i].s, got[i].c, got[i].b) == (t.strip(), re.sub(r"\s+", " ", t), not t.strip())
    every = "".join(chr(c) for c in [*range(1, 0x3100), *range(0xFE00, 0xFFFE)])
    one = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", F.lit(text.WS), F.lit("")).alias("x")).first().x
    assert one == re.sub(r"\s", "", every)


def test_markdown(spark):
    got = _rows(spark, text.normalize_markdown(F.col("t")).alias("m"), text.plain_text(F.col("t")).alias("p"))
    assert got[4].m == "a\nb\nc\n" and got[5].m == "a\n\n\nb\n" and got[0].m == got[1].m == ""
    assert got[6].p == "a 123 2020 z q"
    again = spark.createDataFrame([(r.m,) for r in got.values()], "t string").select("t", text.normalize_markdown(F.col("t")).alias("m")).collect()
    assert all(r.t == r.m for r in again)


def test_labels_and_cleaning(spark):
    got = _rows(
        spark, text.label_key(F.col("t")).alias("k"), text.clean_text(F.col("t")).alias("c"), text.fit_value(F.col("t")).alias("f"), text.metadata_code(F.col("t")).alias("m")
    )
    assert got[7].k == "pension" and got[8].k == "nandu ss" and got[7].m == "pension" and got[0].m == "unknown"
    assert got[9].c == "ñandú" and got[10].c == '"hi"' and got[11].c == "château" and got[12].c == "xy"
    assert got[15].f == "word." and got[16].f == "w" * 253 + "..." and got[17].f == "Art."
    assert all(len(r.f) <= 256 for r in got.values())


def _plain(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()


def test_exact_unicode(spark):
    got = _rows(spark, text.label_key(F.col("t")).alias("k"))
    for i, t in enumerate(ODD):
        assert got[i].k == " ".join(_plain(t).split())
    df = spark.createDataFrame([("é",), ("plain",), (None,)], "t string")
    assert sorted(r.c for r in exact.clean_exact(df, "t", "c").collect()) == ["", "plain", "é"]
    keyed = exact.label_keys_exact(df.withColumn("label", F.lit(1)), "t", "k")
    assert keyed.columns == ["t", "label", "k"] and {r.t: r.k for r in keyed.collect()} == {"é": "e", "plain": "plain", None: None}


def test_normalisation_is_pythons(spark):
    """All assigned code points, and random sequences of a letter, marks and anything."""
    points = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    marks, letters = ([c for c in points if f(c)] for f in (unicodedata.combining, str.isalpha))
    r = random.Random(1)
    mixed = ["".join([r.choice(letters[:3000]), *r.choices(marks, k=r.randint(1, 4)), r.choice(points)]) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in points + mixed] + [(None,)], "t string")
    t = F.col("t")
    made = df.select("t", unicode.compose(t).alias("c"), unicode.decompose_compatible(t).alias("d"), unicode.casefold(t).alias("f"), unicode.fold(t).alias("k"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    for x in made.collect():
        want = (None,) * 4 if x.t is None else (unicodedata.normalize("NFC", x.t), unicodedata.normalize("NFKD", x.t), x.t.casefold(), _plain(x.t))
        assert (x.c, x.d, x.f, x.k) == want, ascii(x.t)


def test_names(spark):
    names = ["Pensión de Alimentos.PDF", "a.b.pdf", ".pdf", "¿?.pdf", "dir/x y.pdf", "noend"]
    df = spark.createDataFrame([(n, b"abc") for n in names], "n string, c binary")
    got = [r.d for r in df.select(text.document_id(F.col("n"), F.col("c")).alias("d")).collect()]
    end = "-" + hashlib.sha256(b"abc").hexdigest()[:12]
    assert got == [x + end for x in ("pensi-n-de-alimentos", "a-b", "pdf", "documento", "x-y", "noend")]
    safe = spark.createDataFrame([("a b/ñ.pdf",), ("",), (None,)], "n string").select(text.safe_filename(F.col("n")).alias("s")).collect()
    assert [r.s for r in safe] == ["a-b-.pdf.error.json", "unknown.pdf.error.json", "unknown.pdf.error.json"]


def test_numbers_fences_pages(spark):
    values = [0.9, 1.0, 0.0, 0.0001, 0.00012, 0.00001, 1.5e-7, 0.001, 0.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(text.float_text(F.col("v")).alias("s")).collect()] == [str(v) for v in values]
    fences = ["```json\n{}\n```", "```\nx```", "x```", " {} ", "```JSON\n{}```"]
    df = spark.createDataFrame([(v,) for v in fences], "v string")
    assert [r.s for r in df.select(text.strip_code_fence(F.col("v")).alias("s")).collect()] == ["{}", "x", "x```", "{}", "JSON\n{}"]
    df = spark.createDataFrame([("ALL", [["a ", ""], []]), ("ALL", []), ("ALL", None)], "full string, pages array<array<string>>")
    got = [r.s for r in df.select(text.ocr_markdown(F.col("full"), F.col("pages")).alias("s")).collect()]
    assert got == ["## Pagina 1\n\na\n\n\n## Pagina 2\n\nALL", "ALL", "ALL"]
    df = spark.createDataFrame([("hello world", [(None, 5), (5, 11)])], "full string, seg array<struct<start: int, end: int>>")
    assert df.select(text.layout_text(F.col("full"), F.col("seg")).alias("s")).first().s == "hello world"
    df = spark.createDataFrame([(" ", [" a ", "", "b"]), (" x ", None)], "t string, p array<string>")
    assert [r.s for r in df.select(text.response_text(F.col("t"), F.col("p")).alias("s")).collect()] == ["a\n\nb", "x"]

import json

from pyspark.sql import functions as F

from lexweft.functions import taxonomy
from lexweft.operators import metadata

G = [{"categoria": "Generales", "subcategorias": ["Otros"]}]


def _extract(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return metadata.extract(spark.createDataFrame(rows, "i int, raw string"))


def _errors(spark, *values):
    return [r.errors for r in _extract(spark, *values).orderBy("i").collect()]


def test_validation(spark):
    ok = {"categorias": G, "confidence": 0.5}
    cases = [
        (ok, []), ("no json", ["json"]), ([1], ["json"]), ({**ok, "confidence": "0.9"}, []), ({**ok, "confidence": True}, []),
        ({**ok, "confidence": 1.5}, ["confidence"]), ({"categorias": G}, ["confidence"]), ({**ok, "confidence": "x"}, ["confidence"]),
        ({**ok, "articulo": 345}, ["articulo"]), ({**ok, "titulo": None}, []), ({**ok, "titulo": "  "}, []), ({**ok, "categorias": []}, ["categorias"]),
        ({"confidence": 1}, ["categorias"]), ({**ok, "categorias": [{"categoria": "Generales", "subcategorias": []}]}, ["categorias"]),
        ({**ok, "categorias": [{"categoria": "Generales"}, {"categoria": "Generales", "subcategorias": ["Otros"]}]}, []),
        ({**ok, "categorias": [{"categoria": " GENERALES", "subcategoria": "otros"}]}, []), ({**ok, "categorias": [{"categoria": "X"}]}, ["categorias"]),
        ({**ok, "categorias": [{"categoria": "Sucesiones y Herencia", "subcategorias": ["any"]}]}, []),
        ({**ok, "categorias": [{"categoria": "Generales", "subcategorias": "Otros"}]}, []),
        ({**ok, "categorias": [{"categoria": "generales", "subcategorias": "Otros"}]}, ["categorias"]),
        ({**ok, "categorias": [5]}, ["categorias"]), ({**ok, "categorias": "x"}, ["categorias"]),
        ({**ok, "categorias": [{"categoria": "Generales", "subcategorias": ["Otros", 5, " ", None]}]}, []),
    ]
    assert _errors(spark, *[c for c, _ in cases]) == [e for _, e in cases]


def test_grouping(spark):
    entries = [
        {"categoria": "generales", "subcategorias": ["OTROS", "Derecho de Familia", "otros"]},
        {"categoria": "Sucesiones y Herencia", "subcategoria": "x"},
        {"categoria": "GENERALES", "subcategoria": "Otros"},
    ]
    row = _extract(spark, {"categorias": entries, "confidence": 1, "titulo": "T"}).first()
    assert [(g.categoria, g.subcategorias) for g in row.categorias] == [("Generales", ["Otros", "Derecho de Familia"]), ("Sucesiones y Herencia", [])]
    assert row.titulo == "T" and row.confidence == 1.0


def _pairs(spark, groups):
    df = spark.createDataFrame([(groups,)], f"c array<{metadata.GROUP}>")
    return [(p.key, p.string_value) for p in df.select(metadata.category_pairs(F.col("c")).alias("p")).first().p]


def test_packing(spark):
    everything = [(c, [s for s, _ in subs]) for c, _, subs in taxonomy.CATEGORIES]
    got = _pairs(spark, everything)
    assert [k for k, _ in got] == ["categorias_count", "categorias_compact_1", "categorias_compact_2"]
    assert got[0][1] == "6" and [len(v) for _, v in got[1:]] == [254, 66]
    assert [len(x) for _, v in got[1:] for x in v.split("|")] == [56, 85, 111, 2, 37, 25]
    assert _pairs(spark, [("Generales", ["Otros"]), (" ", ["x"]), ("Rara Cosa", ["Más"])]) == [("categorias_count", "2"), ("categorias_compact", "gen:otros|rara_cosa:mas")]
    assert _pairs(spark, []) == []


def test_custom_metadata(spark):
    df = _extract(spark, {"titulo": "A  b", "categorias": G, "confidence": 0.9, "observaciones": "o" * 300, "fuente": "u"})
    pairs = metadata.custom_metadata(df, "p").first().p
    assert [(p.key, p.string_value) for p in pairs] == [
        ("titulo", "A b"), ("fuente", "u"), ("categorias_count", "1"), ("categorias_compact", "gen:otros"), ("confidence", "0.9"), ("observaciones_resumen", "o" * 253 + "..."),
    ]
    over = spark.createDataFrame([([("k", "x" * 257), ("l", "y")],)], "p array<struct<key: string, string_value: string>>")
    assert [(o["index"], o.key, o.length) for o in over.select(metadata.oversized(F.col("p")).alias("o")).first().o] == [(0, "k", 257)]


def test_catalog():
    lines = taxonomy.catalog_text().split("\n")
    assert len(lines) == 6 and lines[3] == "- Sucesiones y Herencia: sin subcategoria" and len(taxonomy.pair_rows()) == 18

"""Inputs derived from the driver's tables, in SQL that Spark and DuckDB both read.

The tables hold none of the dirt that text cleaning is for, so it is put in by
doc_id; labels, job events, responses and model outputs are made likewise.
"""

from pyspark.sql import DataFrame, SparkSession

from lexweft.functions.taxonomy import pair_rows
from lexweft.sources.files import read_table

DIRTY = """
SELECT doc_id, source, CASE doc_id % 8
  WHEN 0 THEN concat(text, '  ', chr(13), chr(10), 'cola', chr(9), chr(10))
  WHEN 1 THEN concat(chr(10), chr(10), text, chr(10), chr(10), chr(10), chr(10), chr(10), 'fin')
  WHEN 2 THEN concat('```', chr(10), 'codigo', chr(10), '```', text)
  WHEN 3 THEN concat('![img](http://x/y.png) [Ley 1](http://x/ley)', text)
  WHEN 4 THEN concat('# Exp. 123-2020 **', source, '** `a` ~b~ > ', text)
  WHEN 5 THEN concat(chr(160), text, chr(160), 'x', chr(160))
  WHEN 6 THEN concat(chr(1), text, chr(127), chr(13), 'z')
  ELSE text END AS md
FROM documents"""


def _sql(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


PAIRS = (
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(map(_sql, (i, *row))) + ")" for i, row in enumerate(pair_rows()))
    + ") AS t(k, category, cat_ord, cat_code, subcategory, sub_ord, sub_code, childless)"
)

#: Three labelled entries for each document, in varied spelling.
LABELS = f"""
SELECT d.doc_id, e.pos, CASE (d.doc_id + e.pos) % 6
    WHEN 0 THEN p.category WHEN 1 THEN upper(p.category) WHEN 2 THEN replace(p.category, 'a', chr(225))
    WHEN 3 THEN concat('  ', p.category, ' ') WHEN 4 THEN lower(p.category) ELSE replace(p.category, ' ', '  ') END AS categoria,
  CASE (d.doc_id * 3 + e.pos) % 8
    WHEN 0 THEN upper(p.subcategory) WHEN 1 THEN replace(p.subcategory, 'o', chr(243)) WHEN 2 THEN concat(' ', p.subcategory)
    WHEN 3 THEN NULL WHEN 4 THEN 'Otra cosa' WHEN 5 THEN ' ' ELSE p.subcategory END AS subcategoria
FROM documents d
CROSS JOIN (SELECT * FROM (VALUES (0, 1, 0), (1, 7, 3), (2, 5, 1)) AS t(pos, a, b)) e
JOIN ({PAIRS}) p ON p.k = (d.doc_id * e.a + e.b) % 18"""

JOB_EVENTS = """
SELECT concat('job-', cast(user_id AS varchar(20))) AS job_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  concat(event_type, ' ', cast(user_id AS varchar(20)), '.pdf') AS filename
FROM events"""

#: Model outputs: valid, fenced with a pair and a numeric string, no JSON, a number for text, out of bounds, no legal pair.
OUTPUTS = """
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN concat('{"titulo": "T ', source, '", "fuente": " ", "categorias": [{"categoria": "generales", "subcategorias": ["OTROS", "Otros"]}], "confidence": 0.9}')
  WHEN 1 THEN concat('```json', chr(10), '{"materia": "', lang, '", "categorias": [{"categoria": "Generales", "subcategoria": "Otros"}], "confidence": " 0.5 "}', chr(10), '```')
  WHEN 2 THEN 'no json here'
  WHEN 3 THEN '{"articulo": 345, "categorias": [{"categoria": "Generales", "subcategorias": ["Otros"]}], "confidence": 1}'
  WHEN 4 THEN '{"categorias": [{"categoria": "Sucesiones y Herencia", "subcategorias": []}], "confidence": 1.5}'
  WHEN 5 THEN '{"categorias": [{"categoria": "Generales", "subcategorias": []}], "confidence": true}'
  ELSE '{"titulo": null, "categorias": [{"categoria": "Sucesiones y Herencia", "subcategorias": ["x"]}], "confidence": true}' END AS raw
FROM documents"""

RESPONSES = """
SELECT doc_id % 97 AS resp_id, cast(doc_id % 3 AS int) AS cand_pos, cast(doc_id AS int) AS chunk_pos,
  concat('Titulo ', lang) AS title, text AS body, source
FROM documents"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over ``tables`` of a data folder, without leaving views of their names behind."""
    names = {t: read_table(spark, sf_dir, t) for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql.replace("{", "{{").replace("}", "}}") if not tables else _escape(sql, tables), **names)


def _escape(sql: str, tables: tuple[str, ...]) -> str:
    out = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        out = out.replace("{{" + t + "}}", "{" + t + "}")
    return out

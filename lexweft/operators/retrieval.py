"""Retrieval: prompts, hints, top-k by cosine similarity, answers and their citations."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweft.functions import exact, taxonomy, text
from lexweft.operators.documents import source_hint
from lexweft.sources.shared import shared_path

CLIP = 180_000
#: What an invalid response is answered with.
RETRY = "Reintenta con una consulta mas amplia que incluya la pregunta original, la categoria canonica y terminos juridicos alternativos."
NO_ANSWER = "La busqueda no devolvio una respuesta sustantiva; orienta con prudencia usando la categoria legal y la pregunta original."
#: The prompt for extraction, around the catalog, the file's name, its source and its text.
EXTRACT_RULES = """Eres un extractor juridico para documentos peruanos de derecho de familia.

Devuelve solamente JSON valido. No incluyas markdown ni explicaciones.

Reglas:
- No inventes datos. Si un campo no tiene evidencia clara, usa null.
- Puede haber una o varias categorias por documento.
- Cada categoria debe aparecer una sola vez.
- Si una categoria aplica a varias subcategorias, agrupalas en el arreglo subcategorias de esa categoria.
- Cada categoria/subcategoria debe salir exactamente del catalogo.
- Si una categoria no tiene subcategoria, usa [] en subcategorias.
- Devuelve al menos una categoria. Usa Generales con subcategorias ["Otros"] si no hay una clasificacion juridica clara.
- Mantener fechas como aparecen en el documento o en formato ISO si es inequivoco.
- confidence debe ser un numero entre 0 y 1.

Catalogo cerrado:
"""
EXTRACT_SCHEMA = """

Schema exacto:
{
  "titulo": string|null,
  "identificador": string|null,
  "entidad": string|null,
  "fecha": string|null,
  "materia": string|null,
  "expediente": string|null,
  "articulo": string|null,
  "norma": string|null,
  "pleno": string|null,
  "protocolo": string|null,
  "fuente": string|null,
  "categorias": [
    {
      "categoria": string,
      "subcategorias": string[]
    }
  ],
  "confidence": number,
  "observaciones": string|null
}

Archivo: """
#: The rules at the end of a search prompt.
SEARCH_RULES = """

Usa File Search para recuperar contexto legal peruano relevante.
Responde solo con informacion sustentada por el contexto recuperado.
Si el contexto recuperado es debil o incompleto, responde la pregunta de Derecho de Familia con la mejor orientacion general prudente que puedas dar, aclarando los limites sin solicitar mas detalles solo por falta de respaldo.
No inventes articulos, fuentes ni enlaces."""


def extraction_prompt(filename: Column, markdown: Column, source: Column) -> Column:
    parts = [
        F.lit(EXTRACT_RULES + taxonomy.catalog_text() + EXTRACT_SCHEMA), filename, F.lit("\nFuente sugerida: "), source_hint(source, filename),
        F.lit("\n\nDocumento Markdown:\n---\n"), F.substring(markdown, 1, CLIP), F.lit("\n---"),
    ]
    return F.concat(*parts)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Fixed values in the two prompts below: the labels of their lines.
def search_prompt(query: Column, message: Column, legal: Column, category: Column, subs: Column, hints: Column, terms: Column) -> Column:
    parts = [
        F.lit("Consulta del usuario: "), F.coalesce(F.nullif(message, F.lit("")), query), F.lit("\nConsulta de busqueda: "), query,
        F.lit("\nCategoria legal: "), _or_empty(legal), F.lit("\nCategoria canonica: "), _or_empty(category),
        F.lit("\nSubcategorias canonicas: "), F.array_join(subs, ", "), F.lit("\nMetadata preferida: "), F.array_join(hints, " "),
        F.lit("\nTerminos de busqueda: "), F.array_join(terms, ", "), F.lit(SEARCH_RULES),
    ]
    return text.ws_strip(F.concat(*parts))


def enriched_query(message: Column, legal: Column, category: Column, subs: Column, hints: Column, terms: Column) -> Column:
    """A user's question with its retrieval hints, a line each."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Consulta del usuario: "), message),
        F.concat(F.lit("Categoria legal: "), _or_empty(legal)),
        F.concat(F.lit("Categoria canonica: "), _or_empty(category)),
        F.concat(F.lit("Subcategorias canonicas: "), F.array_join(subs, ", ")),
        F.concat(F.lit("Metadata preferida: "), F.array_join(hints, " ")),
        F.concat(F.lit("Terminos de busqueda: "), F.array_join(terms, ", ")),
    )


def retrieval_hints(questions: DataFrame, label: str) -> DataFrame:
    """``questions`` with the canonical category, subcategories and hints that a legal label names (a category or a subcategory)."""
    pairs = F.broadcast(taxonomy.taxonomy_pairs(questions.sparkSession))
    keyed = questions.select(F.struct(*questions.columns).alias("row"), text.label_key(questions[label]).alias("_key"))
    by_sub = pairs.where("sub_key IS NOT NULL").select(
        F.col("sub_key").alias("_k1"), F.col("category").alias("c1"), F.col("subcategory").alias("s1"), F.concat_ws(":", "cat_code", "sub_code").alias("h1")
    )
    by_cat = pairs.select(F.col("cat_key").alias("_k2"), F.col("category").alias("c2"), F.col("cat_code").alias("h2")).distinct()
    joined = keyed.join(F.broadcast(by_sub), F.col("_key") == F.col("_k1"), "left").join(F.broadcast(by_cat), F.col("_key") == F.col("_k2"), "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in questions.columns if c not in ("canonical_category", "canonical_subcategories", "metadata_hints")],
        F.coalesce("c1", "c2").alias("canonical_category"),
        F.array_compact(F.array("s1")).alias("canonical_subcategories"),
        F.array_compact(F.array(F.coalesce("h1", "h2"))).alias("metadata_hints"),
    )


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 10_000) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: exact nearest vectors by cosine similarity, ties by id, a vector not its own.

    For at most ``most`` queries (more are an error; see ``top_k_blocks``). They go
    to every task as one matrix, and each Arrow batch of vectors is scored by one
    matrix product, of which only the best k a query leave the batch. Vectors that
    are null, of no length, or not as long as the queries have no score.
    """
    q = check_bounded(queries.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")), most).toArrow()
    asked, matrix = _matrix(q)
    vectors = vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    shape = f"query_id long, `{id_col}` long, score double"
    if not len(asked):
        return vectors.sparkSession.createDataFrame([], f"{shape}, rank int")

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                ids, own = _matrix(batch.slice(at, VECTORS_AT_ONCE))
                if not len(ids) or own.shape[1] != matrix.shape[1]:
                    continue
                for first in range(0, len(asked), QUERIES_AT_ONCE):
                    some = asked[first : first + QUERIES_AT_ONCE]
                    scores = matrix[first : first + QUERIES_AT_ONCE] @ own.T
                    scores[some[:, None] == ids[None, :]] = -np.inf
                    least = np.partition(scores, -k, axis=1)[:, -k, None] if k < len(ids) else np.full((len(some), 1), -np.inf)
                    row, col = np.nonzero((scores >= least) & (scores > -np.inf))
                    # Ties at the last place by id: of very many equal vectors no more than k go on.
                    order = np.lexsort((ids[col], -scores[row, col], row))
                    row, col = row[order], col[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col = row[best], col[best]
                    columns = [pa.array(some[row]), pa.array(ids[col]), pa.array(scores[row, col])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", id_col, "score"])

    scored = vectors.mapInArrow(score, shape)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Rows of the two sides of a matrix product.
VECTORS_AT_ONCE, QUERIES_AT_ONCE = 4096, 256


def _matrix(batch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have one of the usual length, that of the first."""
    table = pa.table({"id": batch.column(0), "v": batch.column(1)}).combine_chunks()
    table = table.filter(pc.and_(pc.is_valid(table["id"]), pc.greater(pc.fill_null(pc.list_value_length(table["v"]), 0), 0)))
    table = table.combine_chunks()
    flat = pc.list_flatten(table["v"])
    if flat.null_count:
        parent = pc.list_parent_indices(table["v"]).filter(pc.is_null(flat))
        keep = np.ones(len(table), bool)
        keep[np.unique(parent.to_numpy())] = False
        table = table.filter(pa.array(keep))
    sizes = pc.list_value_length(table["v"]).to_numpy()
    table = table.filter(pa.array(sizes == sizes[0])) if len(sizes) else table
    ids = table["id"].to_numpy().astype(np.int64)
    own = pc.list_flatten(table["v"]).to_numpy().astype(float).reshape(len(ids), -1 if len(ids) else 0)
    norm = np.sqrt((own * own).sum(1))
    there = norm > 0
    return ids[there], own[there] / norm[there, None]


#: Bytes of the matrix of queries that a task gets.
QUERY_BYTES = 32 << 20


def top_k_blocks(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 10_000) -> DataFrame:
    """``top_k`` for any number of queries, at most ``most`` of them, and QUERY_BYTES, at a time.

    Blocks are by a hash of the id. Where there is more than one, each is searched
    and written to the shared folder before the next is sent out.
    """
    longest = queries.agg(F.max(F.size(vec_col))).first()[0] or 1
    most = max(1, min(most, QUERY_BYTES // (8 * max(1, longest))))
    block = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n))
    found, n = queries.limit(most + 1).count(), 1
    if found <= most:
        return top_k(queries, vectors, k, id_col, vec_col, most)
    while queries.groupBy(block(n)).count().agg(F.max("count")).first()[0] > most:
        n *= 2
        if n > 1 << 40:
            raise ValueError(f"more than {most} queries share an id")
    spark = queries.sparkSession
    path = shared_path(spark, "topk")
    for i in range(n):
        part = top_k(queries.where(block(n) == i), vectors, k, id_col, vec_col, most)
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def citation_fields(chunks: DataFrame) -> DataFrame:
    """``chunks`` (title, text, ``_m``: a map of its metadata) with file_id, file_name, snippet and file_url, all clean."""
    get = lambda k: F.try_element_at("_m", F.lit(k))
    raw = {"_id": get("identificador"), "_titulo": get("titulo"), "_title": F.col("title"), "_text": F.col("text"), "_url": get("fuente")}
    row = F.struct(*[c for c in chunks.columns if c != "_m"]).alias("row")
    clean = exact.clean_columns(chunks.select(row, *[c.alias(n) for n, c in raw.items()]), list(raw))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    named = {
        "file_id": F.coalesce(some("_id"), some("_title"), F.lit("")),
        "file_name": F.coalesce(some("_titulo"), some("_title"), F.lit("Fuente legal")),
        "snippet": F.col("_text"),
        "file_url": F.col("_url"),
    }
    kept = [c for c in chunks.columns if c not in (*named, "_m")]
    return clean.select(*[F.col("row").getField(c).alias(c) for c in kept], *[c.alias(n) for n, c in named.items()])


def metadata_map(entries: Column) -> Column:
    """Key/value entries as a map; the last of a repeated key wins, entries without a key go, a null value reads None."""
    kept = F.filter(entries, lambda e: F.coalesce(e["key"], F.lit("")) != "")
    pairs = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["string_value"], F.lit("None")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def citations(chunks: DataFrame) -> DataFrame:
    """Distinct citations of each response, the first of equals kept.

    ``chunks``: resp_id, cand_pos, chunk_pos, title, text, custom_metadata; a row
    whose title, text and metadata are all null had no context and is skipped.
    """
    there = chunks.where("title IS NOT NULL OR text IS NOT NULL OR custom_metadata IS NOT NULL")
    none = F.expr("cast(array() AS array<struct<key: string, string_value: string>>)")
    mapped = there.select("resp_id", "cand_pos", "chunk_pos", "title", "text", metadata_map(F.coalesce("custom_metadata", none)).alias("_m"))
    fields = citation_fields(mapped).select("resp_id", "cand_pos", "chunk_pos", "file_id", "file_name", "snippet", "file_url")
    key = F.concat_ws("|", "file_name", "file_url", F.substring("snippet", 1, 120))
    first = F.row_number().over(Window.partitionBy("resp_id", key).orderBy("cand_pos", "chunk_pos"))
    return fields.withColumn("_n", first).where("_n = 1").drop("_n")


def responses(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """``answers`` (resp_id, answer) with the number of citations, validity and what replaces an empty answer."""
    counts = cited.groupBy("resp_id").agg(F.count("*").alias("n_citations"))
    joined = answers.join(counts, "resp_id", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    valid = (F.col("answer") != "") & (F.col("n_citations") > 0)
    return joined.select(
        "resp_id",
        F.when(F.col("answer") == "", F.lit(NO_ANSWER)).otherwise(F.col("answer")).alias("answer"),
        "n_citations",
        valid.alias("valid"),
        F.when(~valid, F.lit(RETRY)).alias("retry_suggestion"),
    )


def check_bounded(queries: DataFrame, most: int = 10_000) -> DataFrame:
    """``queries`` if there are at most ``most`` of them, which is what may be broadcast."""
    n = queries.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{n} queries are too many to broadcast; search in blocks of {math.floor(most)}")
    return queries

"""The closed legal taxonomy as static dimensions, and its lookups as columns and joins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.functions import text

#: Categories in order with their codes and their subcategories with theirs.
CATEGORIES = (
    ("Vinculos Conyugales y Patrimoniales", "vcp", (
        ("Divorcio y Separacion", "divorcio_separacion"),
        ("Union de Hecho", "union_hecho"),
        ("Sociedad de Gananciales", "sociedad_gananciales"),
    )),
    ("Relaciones Paterno-Filiales y Menores", "rpfm", (
        ("Filiacion e Identidad", "filiacion_identidad"),
        ("Patria Potestad", "patria_potestad"),
        ("Tenencia y Custodia", "tenencia_custodia"),
        ("Pension de Alimentos", "pension_alimentos"),
        ("Adopcion", "adopcion"),
    )),
    ("Proteccion a Personas Vulnerables", "ppv", (
        ("Violencia Familiar", "violencia_familiar"),
        ("Centro Emergencia Mujer", "centro_emergencia_mujer"),
        ("Proteccion de Ninos y Adolescentes", "proteccion_ninos_adolescentes"),
        ("Tutela y Curatela", "tutela_curatela"),
        ("Capacidad Juridica", "capacidad_juridica"),
    )),
    ("Sucesiones y Herencia", "sh", ()),
    ("Procesos Legales y Resolucion Alternativa", "plra", (
        ("Conciliacion", "conciliacion"),
        ("Procedimiento Civil", "procedimiento_civil"),
    )),
    ("Generales", "gen", (
        ("Derecho de Familia", "derecho_familia"),
        ("Otros", "otros"),
    )),
)

PAIR_SCHEMA = "category string, cat_ord int, cat_code string, subcategory string, sub_ord int, sub_code string, childless boolean"


def pair_rows() -> list[tuple]:
    """One row for each legal (category, subcategory), null for a category that has none."""
    rows = []
    for i, (category, code, subs) in enumerate(CATEGORIES):
        if not subs:
            rows.append((category, i, code, None, None, None, True))
        rows += [(category, i, code, sub, k, sub_code, False) for k, (sub, sub_code) in enumerate(subs)]
    return rows


def taxonomy_pairs(spark: SparkSession) -> DataFrame:
    """The 18 legal pairs, with keys for lookups by label."""
    pairs = spark.createDataFrame(pair_rows(), PAIR_SCHEMA)
    return pairs.withColumn("cat_key", text.label_key(F.col("category"))).withColumn("sub_key", text.label_key(F.col("subcategory")))


def taxonomy(spark: SparkSession) -> DataFrame:
    """The six categories."""
    return taxonomy_pairs(spark).select("category", "cat_ord", "cat_code", "cat_key", "childless").distinct()


def catalog_text() -> str:
    """The catalog as prompts show it, a line for each category."""
    return "\n".join(f"- {c}: {', '.join(s for s, _ in subs) or 'sin subcategoria'}" for c, _, subs in CATEGORIES)


def _map(rows) -> Column:
    return F.create_map(*[F.lit(x) for row in rows for x in row])


def category_of(label: Column) -> Column:
    """Canonical category for a label in any case and accents; null if it has none.

    A literal map, as the dimension is 6 rows: no join, no shuffle.
    """
    keyed = [(c.lower(), c) for c, _, _ in CATEGORIES]
    return F.try_element_at(_map(keyed), text.label_key(label))


def subcategory_of(category: Column, label: Column) -> Column:
    """Canonical subcategory of a canonical category; null if it has none of that label."""
    keyed = [(f"{c}|{s.lower()}", s) for c, _, subs in CATEGORIES for s, _ in subs]
    return F.try_element_at(_map(keyed), F.concat_ws("|", category, text.label_key(label)))


def is_childless(category: Column) -> Column:
    return category.isin(*[c for c, _, subs in CATEGORIES if not subs])


def is_category(category: Column) -> Column:
    return category.isin(*[c for c, _, _ in CATEGORIES])


def category_code(category: Column) -> Column:
    """The code of a canonical category, else a slug of the label."""
    return F.coalesce(F.try_element_at(_map([(c, code) for c, code, _ in CATEGORIES]), category), text.metadata_code(category))


def subcategory_code(subcategory: Column) -> Column:
    rows = [(s, code) for _, _, subs in CATEGORIES for s, code in subs]
    return F.coalesce(F.try_element_at(_map(rows), subcategory), text.metadata_code(subcategory))


def valid_pair(category: Column, subcategory: Column) -> Column:
    """Whether a pair is in the catalog: a category that has subcategories needs one, one that has none takes none."""
    listed = F.concat_ws("|", category, subcategory).isin(*[f"{r[0]}|{r[3]}" for r in pair_rows() if r[3]])
    return F.coalesce(F.when(is_childless(category), subcategory.isNull()).otherwise(subcategory.isNotNull() & listed), F.lit(False))


def canonical_category(label: Column) -> Column:
    """The canonical category of a label, the label itself if unknown."""
    return F.coalesce(category_of(label), label)


def canonical_subcategory(category_label: Column, label: Column) -> Column:
    """The canonical subcategory under the category that ``category_label`` names: raw where unknown, null where it takes none."""
    category = category_of(category_label)
    return F.when(category.isNull(), label).when(is_childless(category), None).otherwise(F.coalesce(subcategory_of(category, label), label))


def canonicalize_by_join(labels: DataFrame, category: str = "categoria", subcategory: str = "subcategoria") -> DataFrame:
    """The same canonical pair by joins to the dimension, with ``cat_code``, ``sub_code`` and ``valid``.

    The dimension is 18 constant rows, so both sides of it are broadcast.
    """
    spark = labels.sparkSession
    pairs = taxonomy_pairs(spark)
    cats = F.broadcast(taxonomy(spark).select("category", F.col("cat_code").alias("c_code"), "cat_key", "childless"))
    subs = F.broadcast(pairs.where("sub_key IS NOT NULL").select(F.col("category").alias("s_cat"), "sub_key", "subcategory", F.col("sub_code").alias("s_code")))
    keyed = labels.withColumn("_ck", text.label_key(F.col(category))).withColumn("_sk", text.label_key(F.col(subcategory)))
    joined = keyed.join(cats, F.col("_ck") == F.col("cat_key"), "left")
    joined = joined.join(subs, (F.col("category") == F.col("s_cat")) & (F.col("_sk") == F.col("sub_key")), "left")
    sub = F.when(F.col("childless"), None).otherwise(F.coalesce(joined["subcategory"], labels[subcategory]))
    return joined.select(
        *[labels[c] for c in labels.columns],
        F.coalesce("category", labels[category]).alias("canonical_category"),
        sub.alias("canonical_subcategory"),
        F.coalesce("c_code", text.metadata_code(labels[category])).alias("cat_code"),
        F.when(sub.isNotNull(), F.coalesce("s_code", text.metadata_code(sub))).alias("sub_code"),
        F.when(F.col("childless"), True).otherwise(F.col("category").isNotNull() & joined["subcategory"].isNotNull()).alias("valid"),
    )

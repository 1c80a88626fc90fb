"""Extracted metadata: JSON to validated columns, grouped categories, compact key/value pairs.

All of it is columns within a row: parsing by VARIANT, validation as a list of
errors, grouping by array functions (a document has a handful of categories, so
no shuffle is needed), and packing as a fold. Rows are split into valid and
rejected ones by ``errors``.

Of a key that a JSON object repeats, the last counts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweft.functions import exact, taxonomy, text

#: The string fields in their order.
STRING_FIELDS = ("titulo", "identificador", "entidad", "fecha", "materia", "expediente", "articulo", "norma", "pleno", "protocolo", "fuente")
NOTES = "observaciones"
GROUP = "struct<categoria: string, subcategorias: array<string>>"
_NONE = "cast(array() AS array<string>)"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
#: What Python's float reads.
_NUMERIC = rf"(?i)\A[+-]?(?:inf(?:inity)?|nan|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)\z"


def parse_json(raw: Column) -> Column:
    """The JSON within optional fences as VARIANT, null if it is none."""
    return F.try_parse_json(text.strip_code_fence(raw))


def _kind(v: Column) -> Column:
    """STRING, VOID (JSON null), BIGINT, DOUBLE, DECIMAL, BOOLEAN, ARRAY or OBJECT; null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def number(v: Column) -> Column:
    """A JSON number, boolean or numeric string as double, null if it is none."""
    kind = _kind(v)
    word = text.ws_strip(F.try_variant_get(v, "$", "string"))
    # Spark casts "1d" and the like, too, but no underscores between digits.
    numeric = F.regexp_like(word, F.lit(_NUMERIC))
    return (
        F.when(kind == "STRING", F.when(numeric, F.replace(word, F.lit("_"), F.lit(""))).try_cast("double"))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0))
        .when(kind.isin("BIGINT", "DOUBLE", "DECIMAL"), F.try_variant_get(v, "$", "double"))
    )


def _entries(v: Column) -> Column:
    """Category entries with what grouping asks of them."""

    def entry(e):
        subs, sub = _get(e, "$.subcategorias", "variant"), _get(e, "$.subcategoria", "variant")
        listed = F.coalesce(_get(e, "$.subcategorias", "array<variant>"), F.expr("cast(array() AS array<variant>)"))
        words = F.filter(F.transform(listed, lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
        return F.struct(
            (_kind(e) == "OBJECT").alias("is_object"),
            F.when(_kind(_get(e, "$.categoria", "variant")) == "STRING", _get(e, "$.categoria", "string")).alias("categoria"),
            subs.isNotNull().alias("has_list"),
            _kind(subs).alias("list_kind"),
            F.filter(words, lambda x: ~text.is_blank(x)).alias("words"),
            F.when(_kind(subs) == "STRING", _get(e, "$.subcategorias", "string")).alias("one"),
            _kind(sub).alias("pair_kind"),
            F.when(_kind(sub) == "STRING", _get(e, "$.subcategoria", "string")).alias("pair"),
        )

    return F.transform(_get(v, "$.categorias", "array<variant>"), entry)


def _canonical_subs(category: Column, words: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words, lambda s: taxonomy.canonical_subcategory(category, s)), lambda s: s.isNotNull()))


def group_categories(entries: Column) -> Column:
    """One group for each canonical category in order of first mention, its subcategories in order and once.

    ``entries`` are ``array<struct<categoria, subcategorias>>`` with strings only.
    """
    named = F.transform(
        entries,
        lambda e: F.struct(
            taxonomy.canonical_category(e["categoria"]).alias("categoria"),
            _canonical_subs(e["categoria"], F.filter(F.coalesce(e["subcategorias"], F.expr(_NONE)), lambda s: s.isNotNull() & ~text.is_blank(s))).alias("subs"),
        ),
    )
    return F.transform(F.array(named), lambda all_: F.transform(
        F.array_distinct(F.transform(all_, lambda e: e["categoria"])),
        lambda c: F.struct(
            c.alias("categoria"),
            F.array_distinct(F.flatten(F.transform(F.filter(all_, lambda e: e["categoria"] == c), lambda e: e["subs"]))).alias("subcategorias"),
        ),
    ))[0]


def _as_listed(entries: Column) -> Column:
    """Groups as they stand, for input that isn't grouped: lists are made canonical, other shapes must match exactly."""

    def one(e):
        lists = e["has_list"] & (e["list_kind"] == "ARRAY")
        cat = F.when(lists, taxonomy.canonical_category(e["categoria"])).otherwise(e["categoria"])
        empty = F.expr(_NONE)
        single = F.when(e["has_list"], F.when(text.is_blank(F.coalesce(e["one"], F.lit(""))), empty).otherwise(F.array(e["one"])))
        subs = F.when(lists, _canonical_subs(e["categoria"], e["words"])).when(e["has_list"], single)
        pair = F.when(F.coalesce(e["pair_kind"], F.lit("VOID")) == "VOID", empty).otherwise(F.array(e["pair"]))
        return F.struct(cat.alias("categoria"), F.coalesce(subs, pair).alias("subcategorias"))

    return F.transform(entries, one)


def valid_group(g: Column) -> Column:
    """Whether a group's pairs are all in the catalog; an empty group counts as the pair with no subcategory."""
    none = F.lit(None).cast("string")
    all_ = F.forall(g["subcategorias"], lambda s: taxonomy.valid_pair(g["categoria"], s))
    return F.when(F.size(g["subcategorias"]) == 0, taxonomy.valid_pair(g["categoria"], none)).otherwise(F.coalesce(all_, F.lit(False)))


def assignment(group: Column) -> Column:
    """A group as one pair, ``struct<categoria, subcategoria, valid>``: its first subcategory or null, valid if both are spelt exactly as in the catalog."""
    category, first = group["categoria"], F.get(group["subcategorias"], F.lit(0))
    return F.struct(category.alias("categoria"), first.alias("subcategoria"), F.coalesce(taxonomy.valid_pair(category, first), F.lit(False)).alias("valid"))


def extract(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with the metadata fields, ``categorias``, ``confidence`` and ``errors`` (empty: valid)."""
    # Read when the expression is made: the last of repeated keys counts instead of an error.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Materialised between steps by distinct projections; each is used more than once.
    mine = (*STRING_FIELDS, NOTES, "confidence", "categorias", "errors")
    row = F.struct(*[df[c] for c in df.columns if c not in mine]).alias("_row")
    v = df.select(row, parse_json(df[raw]).alias("_v")).withColumn("_entries", _entries(F.col("_v")))
    fields, errors = [], []
    is_object = F.coalesce(_kind(F.col("_v")) == "OBJECT", F.lit(False))
    for name in (*STRING_FIELDS, NOTES):
        kind = _kind(_get(F.col("_v"), f"$.{name}", "variant"))
        value = _get(F.col("_v"), f"$.{name}", "string")
        fields.append(F.when((kind == "STRING") & ~text.is_blank(value), value).alias(name))
        errors.append(F.when(kind.isNotNull() & ~kind.isin("STRING", "VOID"), F.lit(name)))
    bail = F.exists(
        "_entries", lambda e: ~F.coalesce(e["is_object"], F.lit(False)) | e["categoria"].isNull() | (e["has_list"] & ~e["list_kind"].isin("ARRAY", "VOID"))
    )
    simple = F.transform(
        "_entries",
        lambda e: F.struct(
            e["categoria"].alias("categoria"),
            F.when(e["has_list"], e["words"]).when(e["pair"].isNotNull(), F.array(e["pair"])).otherwise(F.expr(_NONE)).alias("subcategorias"),
        ),
    )
    broken = F.exists(
        "_entries",
        lambda e: ~F.coalesce(e["is_object"], F.lit(False)) | e["categoria"].isNull()
        | (e["has_list"] & ~e["list_kind"].isin("ARRAY", "VOID", "STRING"))
        | (~e["has_list"] & ~F.coalesce(e["pair_kind"], F.lit("VOID")).isin("STRING", "VOID")),
    )
    confidence = number(_get(F.col("_v"), "$.confidence", "variant"))
    step = v.select(
        "_row",
        *fields,
        F.when(bail, F.when(~broken, _as_listed(F.col("_entries")))).otherwise(group_categories(simple)).alias("categorias"),
        confidence.alias("confidence"),
        is_object.alias("_ok"),
        F.array_compact(F.array(*errors)).alias("_bad"),
    )
    in_bounds = F.coalesce((F.col("confidence") >= 0) & (F.col("confidence") <= 1) & ~F.isnan("confidence"), F.lit(False))
    legal = F.coalesce((F.size("categorias") >= 1) & F.forall("categorias", valid_group), F.lit(False))
    found = F.when(~F.col("_ok"), F.array(F.lit("json"))).otherwise(
        F.concat(
            "_bad",
            F.when(legal, F.expr(_NONE)).otherwise(F.array(F.lit("categorias"))),
            F.when(in_bounds, F.expr(_NONE)).otherwise(F.array(F.lit("confidence"))),
        )
    )
    return step.withColumn("errors", found).select("_row.*", *mine)


def encode_entry(group: Column) -> Column:
    """``code`` or ``code:sub,sub`` of a group; empty for a blank category."""
    name = text.ws_strip(F.coalesce(group["categoria"], F.lit("")))
    subs = F.filter(F.coalesce(group["subcategorias"], F.expr(_NONE)), lambda s: s.isNotNull() & ~text.is_blank(s))
    codes = F.array_join(F.transform(subs, taxonomy.subcategory_code), ",")
    code = taxonomy.category_code(name)
    return F.when(name == "", F.lit("")).when(codes == "", code).otherwise(F.concat(code, F.lit(":"), codes))


def pack_entries(entries: Column, most: int = text.MAX_VALUE) -> Column:
    """Entries joined by ``|`` into chunks of at most ``most`` characters, greedily and in order."""

    def add(acc, e):
        longer = F.when(acc["now"] == "", e).otherwise(F.concat(acc["now"], F.lit("|"), e))
        full = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        fits = F.char_length(longer) <= most
        return F.struct(F.when(fits, acc["done"]).otherwise(full).alias("done"), F.when(fits, longer).otherwise(e).alias("now"))

    start = F.struct(F.expr(_NONE).alias("done"), F.lit("").alias("now"))
    fitted = F.transform(entries, lambda e: text.fit_value(e, most))
    return F.aggregate(fitted, start, add, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def category_entries(groups: Column) -> Column:
    return F.filter(F.transform(groups, encode_entry), lambda e: e != "")


def category_pairs(groups: Column) -> Column:
    """The key/value pairs of a document's categories: their number, and the compact codes in one chunk or several."""
    entries = category_entries(groups)
    pair = lambda k, v: F.struct(k.cast("string").alias("key"), v.alias("string_value"))
    chunks = F.transform(F.array(pack_entries(entries)), lambda all_: F.transform(
        all_, lambda c, i: pair(F.when(F.size(all_) == 1, F.lit("categorias_compact")).otherwise(F.concat(F.lit("categorias_compact_"), i + 1)), c)
    ))[0]
    count = F.array(pair(F.lit("categorias_count"), F.size(entries).cast("string")))
    none = F.expr("cast(array() AS array<struct<key: string, string_value: string>>)")
    return F.when(F.size(entries) > 0, F.concat(count, chunks)).otherwise(none)


def custom_metadata(df: DataFrame, out: str = "custom_metadata") -> DataFrame:
    """``df`` with ``out``: all key/value pairs of a document in field order, values clean and at most 256 characters."""
    keys = {f: f for f in STRING_FIELDS} | {"observaciones_resumen": NOTES}
    row = F.struct(*df.columns).alias("row")
    clean = exact.clean_columns(df.select(row, *[df[name].alias(f"_{key}") for key, name in keys.items()]), [f"_{key}" for key in keys])
    of = lambda name: F.col("row").getField(name)
    none = F.expr("cast(array() AS array<struct<key: string, string_value: string>>)")

    def pair(key, value, there):
        return F.when(there, F.array(F.struct(F.lit(key).alias("key"), value.alias("string_value")))).otherwise(none)

    fitted = {key: pair(key, text.fit_tidy(F.col(f"_{key}")), F.coalesce(of(name) != "", F.lit(False))) for key, name in keys.items()}
    number = text.float_text(of("confidence"))
    parts = [*(fitted[f] for f in STRING_FIELDS), F.coalesce(category_pairs(of("categorias")), none), pair("confidence", number, number.isNotNull()), fitted["observaciones_resumen"]]
    return clean.select(*[of(c).alias(c) for c in df.columns if c != out], F.concat(*parts).alias(out))


def oversized(pairs: Column, most: int = text.MAX_VALUE) -> Column:
    """``(index, key, length, value)`` of values above the limit, which an upload must reject."""
    listed = F.transform(pairs, lambda p, i: F.struct(i.alias("index"), p["key"].alias("key"), F.char_length(p["string_value"]).alias("length"), p["string_value"].alias("value")))
    return F.filter(listed, lambda p: p["length"] > most)

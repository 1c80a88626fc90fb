"""Conversion of source files to documents: gates, identity, fallback chain, outputs."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweft.functions import text
from lexweft.sources.shared import materialize

MAX_UPLOAD_MB = 75
MIN_NATIVE_CHARS = 800

#: A converter takes (filename, content) and gives (markdown, pages or None); it may raise.
Converter = Callable[[str, bytes], tuple[str, int | None]]


def upload_error(filename: Column, size: Column, max_mb: int = MAX_UPLOAD_MB) -> Column:
    """Why an upload is refused, null if it isn't; the name is judged before the size."""
    named = F.coalesce(F.endswith(F.lower(filename), F.lit(".pdf")), F.lit(False))
    return F.when(~named, F.lit("INVALID_FILE_TYPE")).when(size > max_mb * 1024 * 1024, F.lit("FILE_TOO_LARGE"))


def needs_ocr(plain: Column, least: int = MIN_NATIVE_CHARS) -> Column:
    return F.char_length(plain) < least


def source_hint(source: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), filename)


def _stage(df: DataFrame, converter: Converter, name: str) -> DataFrame:
    """``df`` with ``markdown``, ``pages`` and ``warning`` of one converter over (filename, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for filename, content in zip(pdf["filename"], pdf["content"]):
                try:
                    rows.append((*converter(filename, bytes(content)), None))
                except Exception as e:  # noqa: BLE001  a document's failure is a warning, not the job's
                    rows.append((None, None, text.warning(name, e)))
            out = pd.DataFrame(rows, columns=["markdown", "pages", "warning"]).astype({"pages": "Int32"})
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, markdown string, pages int, warning string")


def convert(
    files: DataFrame, primary: Converter, fallback: Converter, ocr: Converter, least: int = MIN_NATIVE_CHARS, keep_native: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """``(filename, document_id, markdown, plain_text, pages, ocr_used, warnings, error)`` for ``files`` (filename, content, and columns to ``carry``).

    Each stage runs only for the rows that need it, so rows are split before it
    and not within a CASE, and is written to the shared folder before they are
    split again, so no converter runs twice for a document. With
    ``keep_native``, OCR that yields less than the native text had doesn't
    replace it.
    """
    carry = carry or []
    named = files.select(*carry, "filename", "content", text.document_id(F.col("filename"), F.col("content")).alias("document_id"))
    first = materialize(_stage(named, primary, "docling_failed"), "primary")
    ok = first.where("warning IS NULL").withColumn("warnings", F.expr("cast(array() as array<string>)"))
    failed = first.where("warning IS NOT NULL").select(*carry, "filename", "content", "document_id", F.col("warning").alias("w1"))
    second = _stage(failed, fallback, "pymupdf4llm_failed").withColumn("warnings", F.array_compact(F.array("w1", "warning")))
    native = ok.drop("warning").unionByName(second.drop("warning", "w1").withColumn("pages", F.lit(None).cast("int")))
    shaped = materialize(_shape(native), "native")
    long_enough = shaped.where(~needs_ocr(F.col("plain_text"), least)).withColumn("ocr_used", F.lit(False))
    short = shaped.where(needs_ocr(F.col("plain_text"), least)).withColumnRenamed("markdown", "native").withColumnRenamed("plain_text", "native_plain")
    kept_pages = short.withColumnRenamed("pages", "native_pages")
    seen = _stage(kept_pages, ocr, "ocr_skipped_or_failed").withColumn("pages", F.col("native_pages"))
    seen = _shape(seen)
    use = F.col("warning").isNull()
    if keep_native:
        use = use & (F.char_length("plain_text") >= F.char_length("native_plain"))
    seen = seen.select(
        *carry, "filename", "document_id", "pages",
        F.array_compact(F.concat("warnings", F.array("warning"))).alias("warnings"),
        F.when(use, F.col("markdown")).otherwise(F.col("native")).alias("markdown"),
        F.when(use, F.col("plain_text")).otherwise(F.col("native_plain")).alias("plain_text"),
        F.col("warning").isNull().alias("ocr_used"),
    )
    error = F.when(F.col("markdown") == "", F.lit("ValueError: No se pudo extraer contenido Markdown del PDF"))
    columns = (*carry, "filename", "document_id", "markdown", "plain_text", "pages", "ocr_used", "warnings")
    # Written as well: a reader that asks twice must not run OCR twice.
    return materialize(long_enough.select(*columns).unionByName(seen.select(*columns)).select("*", error.alias("error")), "converted")


def _shape(df: DataFrame) -> DataFrame:
    done = df.withColumn("markdown", text.normalize_markdown(F.coalesce("markdown", F.lit(""))))
    return done.withColumn("plain_text", text.plain_text(F.col("markdown")))


def configured_ocr(ocr: Converter, ready: bool) -> Converter:
    """``ocr``, or what says that none is configured, which becomes a document's warning."""

    def unconfigured(filename: str, content: bytes):
        raise RuntimeError("Document AI OCR no esta configurado")

    return ocr if ready else unconfigured


def output_names(document_id: Column) -> list[Column]:
    return [F.concat(document_id, F.lit(end)).alias(name) for name, end in (("markdown_name", ".md"), ("metadata_name", ".metadata.json"), ("review_name", ".review.json"))]


def pretty(struct: Column) -> Column:
    return F.to_json(struct, {"pretty": "true", "ignoreNullFields": "false"})


def review_package(converted: DataFrame, metadata: DataFrame) -> DataFrame:
    """Conversion and metadata of a document, joined by document_id, with names and texts of its output files."""
    fields = [c for c in metadata.columns if c not in ("document_id", "errors")]
    meta = metadata.select("document_id", F.struct(*fields).alias("metadata"))
    both = converted.join(meta, "document_id")
    review = F.struct("filename", "document_id", "pages", "ocr_used", "warnings", "metadata")
    return both.select("*", *output_names(F.col("document_id")), pretty(F.col("metadata")).alias("metadata_json"), pretty(review).alias("review_json"))

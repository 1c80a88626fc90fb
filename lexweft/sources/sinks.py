"""Sinks: output files in order, error records, logs by status, the document store.

Each takes a ``batch`` name and writes a folder of its own for it, as a whole: a
batch that runs again replaces what it left, so nothing is doubled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweft.operators.metadata import oversized


def _write(df: DataFrame, folder: str, batch: str | int, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/batch={batch}")


#: Folders of a package's outputs in their order, and the columns with a file's name and text.
OUTPUTS = (("markdown", "markdown_name", "markdown"), ("metadata", "metadata_name", "metadata_json"), ("review", "review_name", "review_json"))


def write_outputs(packages: DataFrame, root: str, batch: str | int) -> None:
    """Markdown, then metadata, then review rows (name, value); each only when the one before is committed.

    The input is read three times; it is meant to be a written table or cached.
    """
    for folder, name, value in OUTPUTS:
        _write(packages.select(F.col(name).alias("name"), F.col(value).alias("value")), f"{root}/{folder}", batch)


def write_errors(records: DataFrame, root: str, batch: str | int) -> None:
    _write(records, f"{root}/errors", batch)


def write_logs(logs: DataFrame, root: str, batch: str | int) -> None:
    """One row for each document, by ``status`` (uploaded, skipped, error)."""
    _write(logs, f"{root}/logs", batch, "status")


def upload(documents: DataFrame, root: str, batch: str | int, enabled: bool = True) -> DataFrame:
    """Writes documents (filename, markdown, custom_metadata, store) to the store table; gives a log row for each.

    Documents with a value above the limit are refused with what was to be sent;
    unless ``enabled``, all others are skipped.
    """
    checked = documents.withColumn("_over", oversized(F.col("custom_metadata")))
    good = checked.where("size(_over) = 0")
    rows = good.select("store", F.col("filename").alias("display_name"), F.lit("text/markdown").alias("mime_type"), "markdown", "custom_metadata")
    if enabled:
        _write(rows, f"{root}/store", batch, "store")
    message = F.concat(F.lit("custom_metadata contiene string_value mayor a 256 caracteres: "), F.to_json("_over"))
    refused = checked.where("size(_over) > 0").select("filename", F.lit("error").alias("status"), message.alias("message"))
    return good.select("filename", F.lit("uploaded" if enabled else "skipped").alias("status"), F.lit(None).cast("string").alias("message")).unionByName(refused)


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as one JSON object in order of names; it is made in one executor task, as it is one value, and holds all stores."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    line = F.concat(F.lit("  "), quoted("display_name"), F.lit(": "), quoted("store"))
    lines = registry.select(F.struct("display_name", line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["line"]), ",\n")
    whole = F.when(F.size("all") > 0, F.concat(F.lit("{\n"), body, F.lit("\n}"))).otherwise(F.lit("{}"))
    lines.select(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)
